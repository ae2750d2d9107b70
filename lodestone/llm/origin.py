"""Files that nobody here wrote by hand: generated, minified, vendored, or data saved as code.

Header and layout rules judge each file by itself. Vendored code is what unrelated repositories share: a Merkle tree is built
bottom-up, one aggregation per depth, in which a file's digest is that of its text and a directory's that of its children's
digests (not of their names: copies are often renamed, `lib.js` to `lib-1.2.js`). A file or subtree with the same digest under another owner is a copy, and a directory most of whose files are copies
takes the edited rest with it. Children's hashes are added up, so aggregates combine before they shuffle and no directory's children
are ever gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexing
from lodestone.session import cut

#: Lock files by name (lower case).
LOCK_NAMES = (
    "package-lock.json", "npm-shrinkwrap.json", "composer.lock", "composer-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "pipfile.lock",
    "poetry.lock", "pdm.lock", "uv.lock", "cargo.lock", "gemfile.lock", "go.sum", "podfile.lock", "cartfile.resolved", "package.resolved", "pubspec.lock",
    "mix.lock", "flake.lock", "packages.lock.json", "gradle.lockfile", "deno.lock",
)
#: Licences by their short names.
LICENCES = r"(?:MIT|ISC|BSD(?:-[23]-Clause)?|Apache(?:-2\.0| 2\.0)?|MPL-2\.0|L?GPL(?:-?v?[23](?:\.[01])?)?(?:-only|-or-later)?|Unlicense|Zlib|0BSD|CC0-1\.0)"

_TOOL = re.compile(
    r"(?i)\bcode generated\b|@generated\b|<auto-?generated|\bauto-?gener|\bgenerated (?:code|file|source)\b|\bdo not (?:edit|modify)\b\W*(?:written|generated|created|by hand\b|manually|this file)"
    r"|\bautomatically (?:created|generated|produced|written)\b|^\W*(?:this file (?:is|was) )?(?:generated|produced|emitted) (?:from|by|with|using)\b|\b(?:this|the) file (?:is|was) (?:auto\w*[- ]?)?generated\b|\bchanges (?:made )?here will be (?:lost|overwritten)\b|\bregenerate with\b"
)
#: The same said in other languages: that the file is made by a tool, or that it isn't to be edited.
_TOOL_ABROAD = re.compile(
    r"(?i)\bdies[er]?e? (?:datei|quelltext|code)\b[^.!?]{0,200}?\b(?:erzeugt|generiert|erstellt)\b|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)\b"
    r"|\bce (?:fichier|code)\b[^.!?]{0,200}?\b(?:généré|produit|créé)\b|\b(?:généré|produit|créé)e? automatiquement|\bne pas (?:modifier|éditer)\b"
    r"|\best[ea] (?:archivo|fichero|código|arquivo|ficheiro)\b[^.!?]{0,200}?\b(?:generado|creado|producido|gerado|criado)\b|\b(?:generado|creado|gerado|criado) autom[aá]tica\w*|\bno (?:editar|modificar|edite|modifique)\b|\bnão (?:editar|modificar|edite|modifique)\b"
    r"|\bquesto (?:file|codice)\b[^.!?]{0,200}?\b(?:generato|creato|prodotto)\b|\b(?:generato|creato) automaticamente|\bnon modificare\b"
    r"|\b(?:dit bestand|deze code)\b[^.!?]{0,200}?\b(?:gegenereerd|aangemaakt)\b|\bautomatisch gegenereerd|\bniet (?:bewerken|aanpassen)\b|\bden? (?:här )?fil(?:en)?\b[^.!?]{0,200}?\b(?:genererad|generert|genereret)\b"
    r"|\bwygenerowan\w+ (?:automatycznie|przez)|\bnie edytowa[cć]\b|\bсгенерирован\w*|\bне редактир\w+|自動生成|自动生成|編集しないで|请勿(?:编辑|修改)|자동 ?생성"
)
_HAND_ABROAD = re.compile(r"(?i)\bnicht (?:automatisch |maschinell )?(?:erzeugt|generiert)|\b(?:ursprünglich|anfangs|einmal|früher) (?:automatisch )?(?:erzeugt|generiert)|\bvon hand (?:geschrieben|gepflegt|erstellt)|\b(?:écrit|maintenu) à la main|\b(?:escrit[oa]|mantenid[oa]) a mano|\bscritto a mano|\bescrito à mão")
#: Ends of the names that code generators give to their output. A hand-written file has them only if it says so in its header.
OUTPUT_NAMES = re.compile(
    r"(?:\.pb(?:\.gw|\.validate|\.micro)?\.go|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|d\.ts|rb)|\.pb\.(?:cc|h|swift|dart|ts|rs)|\.pb(?:enum|json|server|grpc)\.dart|\.(?:g|freezed|gr|mocks|config|chopper|mapper)\.dart"
    r"|[._](?:generated|gen|autogen)\.(?:go|py|ts|tsx|js|java|kt|swift|dart|rs|cs|cpp|h|rb)|\.(?:g|g\.i|designer)\.cs|^zz_generated\.[\w.]+\.go|\.graphql\.(?:ts|swift|dart|kt))$"
)
_HAND = re.compile(r"(?i)\bnot (?:auto\w*[- ]?)?generated\b|\b(?:once|originally|initially|formerly|previously|first) (?:auto\w*[- ]?)?generated\b|\bmaintained by hand\b|\bsince rewritten\b|\bedit freely\b|\bedited by hand\b|\bhand-?written\b|\bno longer generated\b")
_NOTICE = re.compile(
    rf"(?i)\bSPDX-License-Identifier\s*:\s*\S+|\bcopyright \(c\)[^\r\n]{{0,120}}(?:authors|contributors|project|foundation)\b|\breleased under the {LICENCES}\b|\blicensed under\b"
    rf"|^\W*[\w@./-]+ v?\d+\.\d+(?:\.\d+)?\s*\|\s*{LICENCES}\b"
)
_UPSTREAM = re.compile(r"(?i)\bupstream (?:copy|source|version)\b|\bvendored\b|\bpart of [\w@./-]+ v?\d+\.\d+|^\W*[\w@./-]+ v\d+\.\d+(?:\.\d+)?\W*$|\|\s*https?://|\bthird[- ]party\b|\bthe [\w-]+ (?:authors|contributors)\b")
_BUNDLE = re.compile(r"^/\*![^\r\n]*\*/")
_EOL = re.compile(r"\r\n|\n|\r")
_CODE_LINE = re.compile(r"\s*(?:#|//|/\*|\*|--|<!--|;|$)")
_DOC_OPEN = re.compile(r"[rRuU]?(\"\"\"|''')")
_MARKS = re.compile(r"^(?:[rRuU]?(?:\"\"\"|'''))?[\s/*#;!<-]*")
_LITERAL = re.compile(r'"(?:[^"\\\r\n]|\\.)*"|\'(?:[^\'\\\r\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|(?<![\w.])-?\d[\w.]*')
_DOC3 = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'', re.S)
_LINE_NOTE = re.compile(r"(?m)(?:^|(?<=\s))(?://|#)[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/")
_STATEMENT = re.compile(r"\b(?:def|function|func|fun|return|if|for|while|class \w+.*:|import|switch|void|=>)\b")
_CODE_EXT = frozenset(lexing.BY_EXTENSION) | {"jsx", "tsx", "mjs", "cjs", "c", "h", "cc", "cpp", "hpp", "cs", "rs", "rb", "php", "scala", "m", "css"}


def header(text: str) -> list[str]:
    """The comment lines before the first line of code, and those of an opening docstring."""
    out, close, at = [], "", 0
    while at < len(text):
        m = _EOL.search(text, at)
        line = text[at : m.start() if m else len(text)]
        at = m.end() if m else len(text)
        s = line.strip()
        opened = _DOC_OPEN.match(s)
        if close:
            if close in s:
                if close != "*/":
                    out.append(s)
                    break  # code begins after the docstring
                close = ""
        elif s.startswith("/*"):
            close = "" if "*/" in s[2:] else "*/"
        elif opened:
            close = opened.group(1)
            if close in s[opened.end() :]:
                out.append(s)
                break
        elif s and not _CODE_LINE.match(s):
            break
        if s:
            out.append(s)
    return out


def judge(path: str, text: str) -> str:
    """'lock', 'generated', 'minified', 'data', 'vendored' (by its notice), or '' for a file by itself."""
    name = path.rsplit("/", 1)[-1].lower()
    if name in LOCK_NAMES:
        return "lock"
    if not text or not text.strip():
        return ""
    head = header(text)
    if not any(_HAND.search(x) or _HAND_ABROAD.search(x) for x in head):
        bare = [_MARKS.sub("", x) for x in head]
        if any(_TOOL.search(x) or _TOOL_ABROAD.search(x) for x in bare):
            return "generated"
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext in _CODE_EXT:
        kind = _layout(text)
        if kind:
            return kind
    if any(_NOTICE.search(x) for x in head) and any(_UPSTREAM.search(x) for x in head):
        return "vendored"
    return ""


def output_of_tool(path: str, text: str) -> bool:
    """Whether a file bears a name that generators reserve for their output and nothing in its header says that it was written by hand.

    Such names (`order.pb.go`, `order.freezed.dart`) are made by a tool's build step, which overwrites the file; names that just
    begin with a word (`generated_report.ts`) say nothing.
    """
    return OUTPUT_NAMES.search(path.rsplit("/", 1)[-1]) is not None and bool(text.strip()) and not any(_HAND.search(x) or _HAND_ABROAD.search(x) for x in header(text))


def _tabular(text: str) -> bool:
    """Whether the literals are a table or a blob: a version or a path alone is a constant, not data."""
    sizes = [m.end() - m.start() for m in _LITERAL.finditer(text)]
    return len(sizes) >= 12 or max(sizes, default=0) >= 256


def _layout(text: str) -> str:
    bare = _LITERAL.sub("", text)
    solid, literals = len(bare) - sum(map(bare.count, " \t\r\n,[]{}()")), len(text) - len(bare)
    if solid < 0.45 * (solid + literals):  # mostly literals: documentation strings and comments aside, is there anything else?
        rest = _LINE_NOTE.sub("", _DOC3.sub('""', text))
        bare = _LITERAL.sub("", rest)
        solid = len(re.sub(r"[\s,\[\]{}()]", "", bare))
        if solid < 0.12 * len(re.sub(r"\s", "", rest)) and len(_STATEMENT.findall(bare)) <= 2 and len(rest) >= 0.5 * len(text) and _tabular(rest):
            return "data"
    if len(text) >= 110 * (1 + text.count("\n") + text.count("\r")) or len(max(_EOL.split(text), key=len)) >= 110:
        code = _LITERAL.sub("0", _DOC3.sub("0", text))
        lines = [x for x in _EOL.split(code) if x.strip() and not _BUNDLE.match(x) and not _CODE_LINE.fullmatch(x)]
        size = sum(map(len, lines))
        # long lines, hardly a blank, and several statements on each
        if size and size / len(lines) >= 110 and sum(x.count(" ") + x.count("\t") for x in lines) < 0.12 * size and sum(x.count(";") + x.count("}") + x.count(",") for x in lines) >= 3 * len(lines):
            return "minified"
    return ""


_NAME = re.compile(r"^\s*(?://|#|\*|/\*)[^\r\n]*|([^\W\d]\w*)", re.M)


def told_apart(text: str, least_words: int) -> bool:
    """Whether a file has so many different words, outside of whole-line comments, that a copy is no coincidence."""
    words: set[str] = set()
    for m in _NAME.finditer(text):
        if m.group(1):
            words.add(m.group(1))
            if len(words) >= least_words:
                return True
    return False


def _digest(text: str) -> tuple[int, int]:
    d = hashlib.blake2b(text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\n").encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def leaves(files: DataFrame, least_words: int = 5) -> DataFrame:
    """file_id, repo_name, path, kind, d1, d2, known: the rules' verdict, the digest (line ends aside) and whether a file has words enough to be known again.

    A null content counts as empty, a null path as ''. A file_id that comes twice counts once per content.
    """
    schema = "file_id bigint, repo_name string, path string, kind string, d1 bigint, d2 bigint, known boolean"
    types = pa.schema([("file_id", pa.int64()), ("repo_name", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, repos, paths, texts = (b.column(i).to_pylist() for i in range(4))
            digests = [_digest(t or "") for t in texts]
            columns = [ids, repos, [p or "" for p in paths], [judge(p or "", t or "") or ("generated" if output_of_tool(p or "", t or "") else "") for p, t in zip(paths, texts)], [d for d, _ in digests], [d for _, d in digests], [told_apart(t or "", least_words) for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return files.select("file_id", "repo_name", "path", "content").mapInArrow(run, schema)


def _owner(repo: str = "repo_name"):
    return F.coalesce(F.split_part(F.col(repo), F.lit("__"), F.lit(1)), F.lit(""))


def _parent(path: str = "path"):
    """The directory of a path; null at the top."""
    return F.when(F.instr(F.col(path), "/") > 0, F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1))


def subtrees(leaf: DataFrame) -> DataFrame:
    """repo_name, path, d1, d2, files, known, copied: the Merkle digest of every directory, its files, those with words enough
    to be known again, and the copies among them.

    `leaf` has repo_name, path, d1, d2, known, copied (flags). Directories come bottom-up: those of one depth are made by one
    aggregation over the files and directories right below them. A directory's digest hashes its children's digests.
    """
    kids = leaf.select("repo_name", "path", "d1", "d2", F.lit(1).cast("bigint").alias("files"), F.col("known").cast("bigint").alias("known"), F.col("copied").cast("bigint").alias("copied"), F.size(F.split("path", "/")).alias("depth"))
    depth = kids.agg(F.max("depth")).first()[0] or 0
    above, out = None, []
    for at in range(depth, 1, -1):
        here = kids.where(F.col("depth") == at).drop("depth")
        here = here if above is None else here.unionByName(above)
        # sums of the 32-bit halves of each child's hash: order doesn't matter, and two equal children don't cancel
        halves = [F.sum(part).alias(f"h{i}{j}") for i in (1, 2) for j, part in enumerate((F.xxhash64(F.lit(i), "d1", "d2").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.xxhash64(F.lit(i), "d1", "d2"), 32)))]
        made = here.groupBy("repo_name", _parent().alias("path")).agg(*halves, *(F.sum(c).alias(c) for c in ("files", "known", "copied")))
        above = cut(made.select("repo_name", "path", F.xxhash64("h10", "h11", "files").alias("d1"), F.xxhash64("h20", "h21", "files").alias("d2"), "files", "known", "copied"))
        out.append(above)
    if not out:
        return kids.drop("depth").limit(0)
    return reduce(DataFrame.unionByName, out)


def _shared(nodes: DataFrame) -> DataFrame:
    """d1, d2 of the nodes that occur under two owners or more; two extremes per digest, so a hot one needs no list."""
    g = nodes.groupBy("d1", "d2").agg(F.min(_owner()).alias("lo"), F.max(_owner()).alias("hi"))
    return g.where(F.col("lo") != F.col("hi")).select("d1", "d2")


def not_hand_written(files: DataFrame, least_words: int = 5, least_files: int = 4, majority: float = 0.75) -> DataFrame:
    """file_id, kind for each file that a tool wrote, that is minified, vendored or data saved as code.

    Vendored are files whose text another owner has too (unrelated repositories: the part of repo_name before `__` differs), all
    files in a directory whose subtree another owner has too, and all files in a directory (but for the top) of at least `least_files` known
    files of which the share `majority` are copies, so that edited copies stay with theirs. Files of fewer than `least_words` different
    words (empty __init__ files and the like) are equal by chance: they count only within such directories. Ties between
    kinds: the rules' verdict wins over the tree's. An empty table gives no rows.
    """
    leaf = cut(leaves(files, least_words).distinct())  # a few dozen bytes per file; the texts are read once
    copied = _shared(leaf.where("known")).withColumn("copied", F.lit(True))
    marked = cut(leaf.join(copied, ["d1", "d2"], "left").withColumn("copied", F.col("known") & F.col("copied").isNotNull()))
    trees = subtrees(marked)
    whole = trees.where((F.col("known") > 0) & (F.col("files") > 1))
    same = whole.join(_shared(whole), ["d1", "d2"], "left_semi").select("repo_name", "path")
    most = trees.where((F.col("known") >= least_files) & (F.col("copied") >= majority * F.col("known")) & F.contains("path", F.lit("/"))).select("repo_name", "path")
    vendored = same.unionByName(most).distinct().withColumnRenamed("path", "dir")
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rest = marked.where(~F.col("copied") & (F.size(parts) > 1)).select("file_id", "repo_name", F.explode(above).alias("dir"))
    inside = rest.join(vendored, ["repo_name", "dir"], "left_semi").select("file_id", F.lit("vendored").alias("kind"))
    copies = marked.where("copied").select("file_id", F.lit("vendored").alias("kind"))
    own = marked.where(F.col("kind") != "").select("file_id", "kind")
    return own.unionByName(copies).unionByName(inside).groupBy("file_id").agg(F.min(F.struct((F.col("kind") == "vendored").alias("v"), "kind")).alias("k")).select("file_id", F.col("k.kind").alias("kind"))
