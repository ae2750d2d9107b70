"""Oversized items cut into pieces at natural boundaries, with a range-maximum index over boundary strengths."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINES = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z")
_EOL = re.compile(r"\r\n|\n|\r")
_DECLARATION = re.compile(r"\s*(?:@\w|(?:export |public |private |protected |static |async |abstract |final |override |open |internal )*(?:def|class|func|fun|function|interface|enum|struct|impl|extension|object|type|trait)\b)")
#: Where a line that is too long may be cut, best first.
_INSIDE = (re.compile(r"[;}]"), re.compile(r"[,)\]]"), re.compile(r"\s"))


class RangeMaximum:
    """Sparse table: the position of the greatest value in any range in constant time, the rightmost among equals."""

    def __init__(self, values: list[int]):
        n = len(values)
        row = np.asarray(values, dtype=np.int64) * (n + 1) + np.arange(n, dtype=np.int64)
        self.n, self.rows, step = n, [row], 1
        while 2 * step <= n:
            row = np.maximum(row[:-step], row[step:])
            self.rows.append(row)
            step *= 2

    def at(self, lo: int, hi: int) -> int:
        """Of the positions lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k) + 1]) % (self.n + 1))


def line_count(text: str) -> int:
    """Lines of a text; a final line end starts no new line."""
    n = len(_EOL.findall(text))
    return n + (1 if text and text[-1] not in "\r\n" else 0)


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _segments(line: str, most: int) -> list[str]:
    """A line as segments of at most `most` bytes each, cut after statements, else commas, else blanks, else characters."""
    out = []
    while _bytes(line) > most:
        # the longest head that fits; 4 bytes a character at most
        head = line[:most] if line[:most].isascii() else line.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")
        low, end = len(head) // 2, len(head)
        for p in _INSIDE:
            last = None
            for m in p.finditer(head, low):
                last = m.end()
            if last:
                end = last
                break
        end = max(end, 1)
        out.append(line[:end])
        line = line[end:]
    return [*out, line] if line else out


def strengths(lines: list[str]) -> list[int]:
    """How natural a cut after each line is: 0 within brackets, 1 any line end, 2 after a statement, 3 at a blank line, 4 before a declaration after one."""
    out, depth = [], 0
    indents = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    for i, x in enumerate(lines):
        s = x.strip()
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", s)
        depth = max(0, depth + sum(map(bare.count, "([")) - sum(map(bare.count, ")]")))
        nxt = next((j for j in range(i + 1, min(i + 4, len(lines))) if indents[j] >= 0), None)
        if depth:
            out.append(0)
        elif not s and nxt is not None and _DECLARATION.match(lines[nxt]):
            out.append(5 if indents[nxt] == 0 else 4)
        elif not s:
            out.append(3)
        elif nxt is not None and nxt == i + 1 and indents[nxt] < indents[i] or s[-1] in ";}" or nxt == i + 1 and _DECLARATION.match(lines[nxt]):
            out.append(2)
        else:
            out.append(1)
    return out


def pieces(text: str, max_lines: int = 150, max_bytes: int = 8000, overlap: int = 15) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each piece, lines counted from 0; the text whole if it is within the limits."""
    if not text:
        return [(0, 0, "")]
    lines = _LINES.findall(text)
    if len(lines) <= max_lines and _bytes(text) <= max_bytes:
        return [(0, len(lines) - 1, text)]
    units, line_of, strength = [], [], []
    for i, (x, s) in enumerate(zip(lines, strengths(lines))):
        parts = [x] if _bytes(x) <= max_bytes else _segments(x, max_bytes)
        units += parts
        line_of += [i] * len(parts)
        strength += [-1] * (len(parts) - 1) + [s]
    total = [0, *accumulate(map(_bytes, units))]
    index, n, out, start, done = RangeMaximum(strength), len(units), [], 0, 0
    while True:
        # the last unit that still fits, by bytes and by lines
        last = min(bisect_right(total, total[start] + max_bytes) - 2, bisect_right(line_of, line_of[start] + max_lines - 1) - 1)
        if last >= n - 1:
            out.append((line_of[start], line_of[n - 1], "".join(units[start:])))
            return out
        first = max(done, start + (last - start) // 2)  # beyond what the piece before ended with, and not too short
        cut = index.at(min(first, last), last)
        out.append((line_of[start], line_of[cut], "".join(units[start : cut + 1])))
        done, back = cut + 1, cut + 1
        # step back by whole lines while the shared part and one more unit fit
        while back - 1 > start and line_of[cut] - line_of[back - 1] < overlap and total[cut + 2] - total[back - 1] <= max_bytes and line_of[cut + 1] - line_of[back - 1] < max_lines:
            back -= 1
        while back <= cut and back > 0 and line_of[back] == line_of[back - 1]:  # a shared line is shared whole
            back += 1
        start = back


def split(items: DataFrame, max_lines: int = 150, max_bytes: int = 8000, overlap: int = 15, key: str = "chunk_id", keep_small: bool = False) -> DataFrame:
    """key, piece_no, start_line, end_line, n_lines, n_bytes, content: the pieces of each item over a limit.

    With keep_small, items within the limits come out whole as piece 0. Lines end at LF, CRLF or a lone CR. A null
    content has no pieces; an empty one is within the limits. A null start_line counts as 1. Repeated rows (same key) count
    once. A line over max_bytes is cut within, never inside a character. Cuts of equal strength: the rightmost.
    """
    content = F.col("content")
    # an upper bound of the number of lines: CRLF counts twice here, the exact count follows
    over = (F.octet_length(content) > max_bytes) | (F.length(content) - F.length(F.translate(content, "\r\n", "")) >= max_lines)
    schema = f"{key} string, piece_no int, start_line int, end_line int, n_lines int, n_bytes int, content string"
    types = pa.schema([(key, pa.string()), *((k, pa.int32()) for k in ("piece_no", "start_line", "end_line", "n_lines", "n_bytes")), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in types.names}
            for k, first, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = pieces(text, max_lines, max_bytes, overlap)
                if len(found) == 1 and not keep_small:
                    continue
                for no, (a, z, t) in enumerate(found):
                    for name, v in zip(rows, (k, no, (1 if first is None else first) + a, (1 if first is None else first) + z, z - a + 1, _bytes(t), t)):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=types)

    wanted = items.where(content.isNotNull()).where(F.lit(keep_small) | over)
    return wanted.select(F.col(key).cast("string"), "start_line", "content").mapInArrow(run, schema).dropDuplicates([key, "piece_no"])
