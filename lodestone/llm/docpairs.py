"""Functions paired with their documentation.

A string- and comment-aware state machine blanks strings and comments, declarations are matched in what is left,
braces (or indentation) delimit the function, and the documentation comment that belongs to it is attached unless it is trivial.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexing

#: Words that look like a call or a name before a bracket but declare nothing.
_CONTROL = frozenset("if for while switch catch return new throw else do try await yield typeof delete void in of case function func fun super this assert when guard defer go select with sizeof instanceof".split())

_PY = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M)
_JS = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)[ \t]*(?:<[^()]*>)?\("
    r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<a>[\w$]+)[ \t]*(?::[^=\r\n]+)?=[ \t]*(?:async\b[ \t]*)?(?:function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*\(|(?:<[^()]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?::[^=;{]+)?=>)|[\w$]+[ \t]*=>)"
    r"|^[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)[ \t]+)*(?P<m>[#\w$]+)[ \t]*(?:<[^()]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)[ \t\r\n]*(?::[^={};]+)?\{)"
    r"|^[ \t]*(?:(?:public|private|protected|static|readonly)[ \t]+)*(?P<f>[#\w$]+)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?:\([^()]*\)|[\w$]+)[ \t]*=>",
    re.M,
)
_JAVA = re.compile(
    r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>()]*>[ \t]*)?(?P<t>[\w.]+(?:<[^(){};=]*>)?(?:\[\])*)[ \t]+(?P<n>\w+)[ \t]*\((?=[^(){};]*\)[ \t\r\n]*(?:throws[^{};]+)?[{;])"
    r"|^[ \t]*(?:(?:public|private|protected)[ \t]+)(?P<k>[A-Z]\w*)[ \t]*\((?=[^(){};]*\)[ \t\r\n]*(?:throws[^{};]+)?\{)",
    re.M,
)
_GO = re.compile(r"^[ \t]*func[ \t]*(?:\([^()]*\)[ \t]*)?(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M)
_KT = re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|open|override|abstract|final|suspend|inline|operator|infix|tailrec|external|actual|expect)[ \t]+)*fun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w.<>?]+\.)?`?(?P<n>\w+)`?[ \t]*\(", re.M)
_SWIFT = re.compile(r"^[ \t]*(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|convenience|required|async)[ \t]+)*func[ \t]+(?P<n>\w+)[ \t]*(?:<[^>]*>)?[ \t]*\(", re.M)
_DART = re.compile(
    r"^[ \t]*(?:(?:static|external|abstract|final|late|covariant)[ \t]+)*(?P<t>[\w.?]+(?:<[^(){};=]*>)?\??)[ \t]+(?:get[ \t]+|set[ \t]+)?(?P<n>\w+)[ \t]*(?:<[^()]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)[ \t\r\n]*(?:async\*?|sync\*)?[ \t\r\n]*(?:\{|=>|;))"
    r"|^[ \t]*(?P<m>\w+)\((?=[^()]*\)[ \t\r\n]*(?:async\*?|sync\*)?[ \t\r\n]*(?:\{|=>))",
    re.M,
)
DECLARATION = {"python": _PY, "javascript": _JS, "typescript": _JS, "java": _JAVA, "go": _GO, "kotlin": _KT, "swift": _SWIFT, "dart": _DART}

_ANNOTATION = re.compile(r"(?:^|(?<=[\r\n]))[ \t]*@[\w.:]+(?:\([^\r\n]*\))?(?:[ \t]+@[\w.]+(?:\([^\r\n]*\))?)*[ \t]*\Z")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_MARK = re.compile(r"^\s*(?:///?!?|/\*\*?!?|\*/|\*(?!\*)|#+!?|--)?\s?")
_END = re.compile(r"\s*\*+/\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?:param|return|returns|throws?|exception|see|since|author|version|deprecated|type|typedef|template|private|public|protected|internal|override|example|property|property|arg|argument|yields?|raises?|todo|link|code|inheritdoc|api|async|class|constructor|memberof|method|name|nodoc|suppress|constructs?|receiver|sample|hide|ignore|category|category|default|readonly|static|function|fileoverview|module|namespace|access)\b|\{@\w+[^}]*\}\s*$|:\w+(?:\s+[\w.]+)*:|-\s*(?:Parameters?|Returns?|Throws|Note|Complexity)\b.*:|@\w+\b)", re.I)
_SECTION = re.compile(r"^(\s*)(?:Args|Arguments|Parameters?|Params|Returns?|Raises?|Yields?|Throws|Keyword Args|Other Parameters|Attributes|Example[s]?|See Also|References)\s*:?\s*$", re.I)
_DIRECTIVE = re.compile(r"(?i)^\s*(?:NOLINT\w*|noqa\b|type:\s*ignore|pylint\s*:|mypy\s*:|flake8\s*:|pragma\b|nosec\b|yapf\s*:|fmt\s*:|isort\s*:|ruff\s*:|eslint(?:-\w+)*|tslint\s*:|@ts-\w+|prettier-ignore|istanbul\b|c8\s+ignore|jshint\b|global\s+\w|go:\w+|\+build\b|nolint\b|lint:|ktlint\b|swiftlint:|swift-format-ignore|detekt\b|noinspection\b|suppress\w*\b|ignore(?:_for_file)?\s*:|sourcery\b|clang-format|spell-?checker\s*:|cspell\s*:|region\b|endregion\b|MARK\s*:|checkstyle\s*:|CHECKSTYLE|coverage\s*:|-\*-|vim\s*:|!/|codacy\b|sonar\w*\b|NOSONAR|@formatter:|language=|dart\s+format|coverage:ignore\S*)")
_RULE = re.compile(r"^[\s\W_]*$|^\s*[-=*#~_+/.]{3,}.*[-=*#~_+/.]{3,}\s*$")
_PENDING = re.compile(
    r"(?i)^\W*(?:todo|fixme|tbd|tbc|xxx|hack)\b"
    r"|\b(?:docs?|docstrings?|documentation|description|summary|comments?|javadoc|kdoc)\b[\w\s,]*\b(?:pending|missing|needed|required|wanted|later|soon|to (?:be|come|do|follow)|still|todo|tbd|coming)\b"
    r"|\b(?:missing|needs?|pending|add|write|no|lacks?|insert|undocumented|awaiting)\s+(?:a |an |the |some |proper |better |real )*(?:docs?|docstrings?|documentation|description|summary|comments?|javadoc)\b"
    r"|^\W*(?:insert|add|write|provide|enter|put|give)\b.*\b(?:docs?|docstrings?|documentation|description|summary)\b|\bplaceholder\b"
    r"|\b(?:to be|still to be|not yet|needs to be|should be|will be|must be)\s+(?:documented|described|written|explained|filled)\b|\b(?:document|describe|explain)\s+(?:this|me|it|here)\b|\bundocumented\b|\bwrite me\b|\bfill (?:me |this )?in\b"
)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[\w.$\[\]\"']+\s*(?::=|[-+*/|&]?=(?!=))\s*\S|^\s*(?:(?:const|let|var|val|final|int|auto|return|import|from|public|private|static|await|yield|throw|raise|del|pass|else|elif|try|except|finally|break|continue)\b)(?:\s+[\w.$\"'\[\](]+\s*(?:=|\(|;|\[|$|[-+*/]\s)|\s*[:;{]?\s*$)"
    r"|^\s*(?:if|for|while|switch|with|elif|def|class|func|fun|function|catch|except|guard|when)\b.*[:{)]\s*$|^\s*[\w.$]+\((?:[^()]|\([^()]*\))*\)\s*;?\s*$|^\s*@\w+(?:\(.*\))?\s*$|^\s*<[^>]+>\s*$|^\s*\}"
)
_LONE_CR = re.compile(r"\r(?!\n)")
_ARTICLES = {"a", "an", "the"}
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def prose(doc: str) -> str:
    """What is left of a documentation text without marks, tags, parameter lines, directives, rules and code."""
    kept, section, fence = [], None, False
    for raw in re.split(r"\r\n|\n|\r", doc):
        line = _END.sub("", raw)
        line = _MARK.sub("", line, count=1) if re.match(r"\s*(?:/|\*|#|--)", line) else line
        line = re.sub(r"^\s*\*+\s?(?=\S)", "", line)
        if line.strip().startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            continue
        indent = len(line) - len(line.lstrip())
        if section is not None:
            if line.strip() and (indent > section or re.match(r"^[-:]", line.strip())) or not line.strip():
                continue
            section = None
        if m := _SECTION.match(line):
            section = len(m.group(1))
            continue
        if not line.strip() or _TAG.match(line) or _DIRECTIVE.match(line) or _RULE.match(line) or _CODE.search(line) and not re.search(r"[.!?]\s*$", line) or re.match(r"^\s*(?:>>>|\.\.\.)", line):
            continue
        kept.append(line.strip())
    return "\n".join(kept)


def trivial(doc: str, name: str) -> bool:
    """Whether a documentation says nothing: under five words, the name again, or a note that it's still to be written."""
    rest = []
    for part in re.split(r"(?<=[.!?。])\s+|\n", prose(doc)):
        if not _PENDING.search(part):
            rest.append(part)
    text = " ".join(rest)
    words = [w.lower() for w in _WORD.findall(_CJK.sub(" ", text))]
    if len(words) + len(_CJK.findall(text)) < 5:
        return True
    own = {p.lower() for p in _SPLIT.findall(name)}
    own |= {p + "s" for p in own} | {p + "es" for p in own} | {p[:-1] + "ies" for p in own if p.endswith("y")}
    return not _CJK.search(text) and all(w in own or w in _ARTICLES for w in words)


def _close(code: str, at: int) -> int:
    """The position after the bracket that closes the one at `at`; the end if none does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _python(text: str) -> Iterator[tuple[str, str, int]]:
    code, _, strings = lexing.scan("python", text)
    starts = {a: b for a, b in strings}
    for m in _PY.finditer(code):
        i = _close(code, m.end() - 1)
        colon = re.compile(r"\s*(?:->[^:\x01]*(?:\[[^\]]*\])?[^:]*)?:").match(code, i)
        if not colon:
            continue
        body = re.compile(r"[ \t\r\n\f;\\]*").match(code, colon.end()).end()
        doc = ""
        if body in starts:
            end = starts[body]
            tail = re.compile(r"[ \t]*(?=[\r\n;]|\Z)").match(code, end)  # no expression goes on
            raw = text[body:end]
            prefix = re.match(r"[rRuUbBfF]*", raw).group().lower()
            if tail and "b" not in prefix and "f" not in prefix:
                quote = 3 if raw[len(prefix) :].startswith(('"""', "'''")) else 1
                doc = raw[len(prefix) + quote : -quote]
        yield m.group("n"), doc, m.start()


def _before(text: str, code: str, at: int, comments: dict[int, int]) -> str:
    """The comment directly before position `at` (annotations may stand between); no blank line may."""
    parts = []
    while True:
        head = code[:at].rstrip(" \t")
        gap = re.compile(r"(?:\r\n|\n|\r)?\Z").search(head).start()
        line = max(head.rfind("\n", 0, gap), head.rfind("\r", 0, gap)) + 1
        end = len(text[:gap].rstrip(" \t"))
        if end in comments:
            start = comments[end]
            first = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1
            if code[first:start].strip():
                break  # it follows code on its line
            parts.append(text[start:end])
            at = first
            continue
        if gap > line and (_ANNOTATION.search(code[line:gap].replace("\x01", "s"))):
            at = line
            continue
        if gap > line and code[line:gap].strip().endswith(")") and "\x01" not in code[line:gap]:  # an annotation over several lines
            back = code.rfind("@", 0, gap)
            if back >= 0 and re.fullmatch(r"@[\w.]+\s*", code[back : code.find("(", back)] or "-") and _close(code, code.find("(", back)) == len(code[:gap].rstrip()):
                at = max(code.rfind("\n", 0, back), code.rfind("\r", 0, back)) + 1
                continue
        break
    return "\n".join(reversed(parts))


def functions_of(language: str, text: str) -> Iterator[tuple[str, str, int]]:
    """(name, documentation, position) of each function declared in a text; documentation is '' where there is none."""
    if language not in DECLARATION or not text:
        return
    text = _LONE_CR.sub("\n", text)  # of the same length, so positions hold
    if language == "python":
        yield from _python(text)
        return
    code, comments, _ = lexing.scan(language, text)
    by_end = {b: a for a, b in comments}
    by_end |= {len(text[:b].rstrip(" \t")): a for a, b in comments}
    for m in DECLARATION[language].finditer(code):
        name = next(v for k, v in m.groupdict().items() if v and k != "t")
        kind = m.groupdict().get("t")
        if name in _CONTROL or kind in _CONTROL - {"void"} or kind in ("class", "interface", "enum", "record", "import", "package", "export", "extends", "implements", "const", "final", "var", "let"):
            continue
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        yield name.lstrip("#"), _before(text, code, at, by_end), at


#: Chunk types that declare functions.
TYPES = ("function", "method", "class")


def pairs(chunks: DataFrame) -> DataFrame:
    """chunk_id, symbol_name, language, documentation, code: one row per function with non-trivial documentation.

    Null or empty content, other chunk types and other languages give no rows; null languages neither. Re-delivered
    rows count once. A name declared twice in a chunk gives one row (the first that is documented). Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"chunk_id": [], "symbol_name": [], "language": [], "documentation": [], "code": []}
            for cid, language, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen = set()
                found = list(functions_of(language, text))
                for i, (name, doc, at) in enumerate(found):
                    if doc and name not in seen and not trivial(doc, name):
                        seen.add(name)
                        nxt = found[i + 1][2] if i + 1 < len(found) else len(text)
                        for k, v in zip(rows, (cid, name, language, doc, _body(language, text, at, nxt))):
                            rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.string()) for k in rows]))

    wanted = chunks.where(F.col("content").isNotNull() & F.col("chunk_type").isin(*TYPES))
    # what holds no comment or string opener can't hold documentation: dropped before Python sees it
    wanted = wanted.where(F.col("content").rlike("//|/\\*|[\"']"))
    found = wanted.select("chunk_id", F.lower("language").alias("language"), "content").mapInArrow(run, "chunk_id string, symbol_name string, language string, documentation string, code string")
    return found.dropDuplicates(["chunk_id", "symbol_name"])


def _body(language: str, text: str, at: int, nxt: int) -> str:
    """The function's text: to its closing brace, or in Python to the end of its block."""
    if language == "python":
        line = text.rfind("\n", 0, at) + 1
        first = text[at:].lstrip("\r\n \t")
        at = len(text) - len(first) if first else at
        indent = at - (max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1)
        stop = re.compile(rf"^(?=[^\s#\)\]}}])|^[ \t]{{0,{indent}}}(?=[^\s#\)\]}}])", re.M)
        m = next((x for x in stop.finditer(text, text.find("\n", at) + 1 or len(text)) if x.start() > at), None)
        return text[min(at, len(text)) : m.start() if m else len(text)] if line <= at else text[at:nxt]
    code, _, _ = lexing.scan(language, text[at:])
    brace = code.find("{")
    stop = code.find(";")
    if brace < 0 or 0 <= stop < brace:
        return text[at : at + stop + 1] if stop >= 0 else text[at:nxt]
    return text[at : at + _close(code, brace)]
