"""Files to chunks, end to end: a module chunk, one per symbol, parts of long ones, windows over what is left, and their links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines, uuid5
from lodestone.operators import chunking, parsers
from lodestone.operators.chunking import module_end

#: Chunk types by kind of symbol; what is not here becomes a block.
TYPES = ("function", "method", "class_head", "class", "import", "interface", "constant", "block")
#: Lines of a window and of the overlap, of the longest function in one piece, and of the least gap that is filled.
WINDOW, OVERLAP, LONGEST, GAP = 60, 15, 150, 20
#: How far from the limit a part may end to do so at a blank line.
AROUND = 10

_EOL = re.compile(r"\r\n|\n|\r")


class Piece(NamedTuple):
    kind: str
    name: str
    start: int
    end: int
    content: str
    parent: str | None = None


def located(path: Column, start_line: Column, content: Column) -> Column:
    """A chunk's content under a line that says where it stands."""
    return F.concat(F.lit("# "), path, F.lit(":"), start_line.cast("string"), F.lit("\n"), content)


def module_chunks(files: DataFrame) -> DataFrame:
    """The module chunk of each file (repo_name, path, language, content): its preamble under a header. Null content counts as empty."""
    text = F.coalesce("content", F.lit(""))
    end = module_end(text)
    header = F.concat(F.lit("# File: "), "path", F.lit("\n# Language: "), "language", F.lit("\n# Lines: "), F.size(lines(text)).cast("string"), F.lit("\n\n"))
    body = F.array_join(F.slice(lines(text), F.lit(1), end.cast("int")), "\n")
    return files.select("repo_name", F.col("path").alias("file_path"), "language", F.lit("module").alias("chunk_type"), F.col("path").alias("symbol_name"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), end.cast("int")).alias("end_line"), F.concat(header, body).alias("content"))


def _windows(ls: list[str], start: int, end: int) -> Iterator[Piece]:
    for a in range(start, end + 1, WINDOW - OVERLAP):
        b = min(a + WINDOW - 1, end)
        text = "\n".join(ls[a - 1 : b])
        if text.strip():
            yield Piece("block", f"block_{a}_{b}", a, b, text)


def _parts(ls: list[str], s: parsers.Symbol) -> Iterator[Piece]:
    """A long symbol in parts that end at the blank line nearest to the limit, if one is near; neighbours overlap."""
    a, last = s.start, min(s.end, len(ls))
    while a <= last:
        limit = min(a + LONGEST - 1, last)
        b = limit
        if limit < last:
            near = (limit + d * sign for d in range(AROUND + 1) for sign in (-1, 1))
            b = next((x for x in near if a <= x < last and not ls[x - 1].strip()), limit)
        yield Piece("block", f"{s.name}_block_{a}", a, b, "\n".join(ls[a - 1 : b]), s.parent)
        if b >= last:
            return
        a = max(b - OVERLAP + 1, a + 1)


def pieces(language: str, path: str, text: str) -> list[Piece]:
    """What a file is cut into besides its module chunk: symbols, parts of long functions, and windows over gaps, or over all if there is no symbol."""
    ls = _EOL.split(text)
    if ls and ls[-1] == "":
        ls.pop()
    found = parsers.parse(language, text)
    if not found:
        return list(_windows(ls, 1, len(ls)))
    out: list[Piece] = []
    for s in found:
        kind = s.kind if s.kind in TYPES else "block"
        if s.end - s.start + 1 > LONGEST and kind in ("function", "method"):
            out += _parts(ls, s)
            continue
        source = "\n".join(ls[s.start - 1 : s.end])
        out.append(Piece(kind, s.name, s.start, s.end, source if kind == "import" else f"# {path}:{s.start}\n{source}", s.parent))
    reach = 0
    for a, b in [*sorted((p.start, p.end) for p in out), (len(ls) + 1, len(ls) + 1)]:
        if a - reach - 1 >= GAP:
            out += _windows(ls, reach + 1, a - 1)
        reach = max(reach, b)
    return out


def chunks_of(files: DataFrame) -> DataFrame:
    """repo_name, file_path, language, seq, chunk_type, symbol_name, start_line, end_line, content, parent_symbol of every file's pieces.

    `files` has repo_name, path, language, content. A text is cut where it is read, so only chunks leave the task. Null content has no pieces.
    """
    types = pa.schema([("repo_name", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("seq", pa.int32()), ("chunk_type", pa.string()), ("symbol_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("parent_symbol", pa.string())])
    registry = dict(parsers.REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers.REGISTRY.update(registry)
        for b in batches:
            rows = []
            for repo, path, language, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows += [(repo, path, language, seq, p.kind, p.name, p.start, p.end, p.content, p.parent) for seq, p in enumerate(pieces(language or "", path or "", text))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(types), types)], schema=types)

    ddl = "repo_name string, file_path string, language string, seq int, chunk_type string, symbol_name string, start_line int, end_line int, content string, parent_symbol string"
    return files.where(F.col("content").isNotNull()).select("repo_name", "path", "language", "content").mapInArrow(run, ddl)


def identified(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id (a version 5 UUID of repository, path, type, name and line) and content_hash (MD5)."""
    return chunks.withColumns({"chunk_id": uuid5(F.col("repo_name"), F.col("file_path"), F.col("chunk_type"), F.col("symbol_name"), F.col("start_line")), "content_hash": F.md5("content")})


def chunked(files: DataFrame) -> DataFrame:
    """All chunks of files (repo_name, path, language, content): module chunks and pieces, with ids and hashes."""
    own = module_chunks(files).withColumns({"seq": F.lit(-1), "parent_symbol": F.lit(None).cast("string")})
    return identified(own.unionByName(chunks_of(files)))


def linked(chunks: DataFrame) -> DataFrame:
    """chunk_id, prev_id, next_id, parent_id: neighbours by first line (then order of emission) and methods' class heads, without the texts."""
    slim = chunks.select("chunk_id", "repo_name", "file_path", "chunk_type", "symbol_name", "parent_symbol", "start_line", "seq")
    file = ["repo_name", "file_path"]
    near = chunking.neighbours(slim, file, ["start_line", "seq"]).select("chunk_id", "prev_id", "next_id")
    return near.join(chunking.parents(slim, file), "chunk_id", "left")


def with_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_id, symbol_seq: the symbol each chunk was made of, found by repository, path, kind, qualified name and line; null for others.

    `symbols` has repo_name, file_path, seq, kind, name, parent, start_line.
    """
    name = lambda parent, own: F.concat_ws(".", parent, own)
    s = symbols.select("repo_name", "file_path", F.col("kind").alias("chunk_type"), name("parent", "name").alias("qualified"), "start_line", F.col("seq").alias("symbol_seq"))
    c = chunks.select("chunk_id", "repo_name", "file_path", "chunk_type", name("parent_symbol", "symbol_name").alias("qualified"), "start_line")
    return c.join(s, ["repo_name", "file_path", "chunk_type", "qualified", "start_line"], "left").select("chunk_id", "symbol_seq")
