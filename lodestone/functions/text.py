"""Column functions on text: lines, tokens, hashes, names and small renderings. All run in the JVM unless they say otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What ends a line for splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Parts of identifiers, as camel case, acronyms and digits.
TOKEN = r"[A-Za-z][a-z]+|[A-Z]{2,}(?=[A-Z][a-z]|\d|\b)|[A-Z][a-z]*|\d+"
#: The namespace of chunk ids.
CHUNK_NAMESPACE = "3fce2cb4-697d-488a-a9ac-8e4916aeb3f7"
#: Severities by rank; others rank 99.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
#: Terms too common to prove anything.
GENERIC_TERMS = ("self", "data", "item", "items", "list", "dict", "value", "values", "result", "results", "index", "name", "path", "file", "line", "true", "false", "none", "def", "return", "class", "the", "and", "for", "get", "set", "obj", "arg", "args", "kwargs", "temp", "tmp")


def lines(c: Column) -> Column:
    """The lines of a text without their ends; a final line end starts none, an empty text has none (null stays null)."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    """How many lines() there are, without making them."""
    last = F.right(c, F.lit(1))
    ended = last.rlike(rf"(?s)^(?:{LINE_END})$")
    return F.when(c == "", 0).otherwise(F.regexp_count(c, F.lit(LINE_END)) + F.when(ended, 0).otherwise(1))


def first_lines(c: Column, most: int) -> Column:
    """The first lines of a text, without splitting the rest."""
    parts = F.split(c, LINE_END, most + 1)
    return F.slice(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), 1, most)


def first_filled_line(c: Column) -> Column:
    """The first line that holds more than spaces, '' if none does."""
    end = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
    return F.regexp_extract(c, rf"([^{end}]*[^ {end}][^{end}]*)", 1)


def newline_count(c: Column) -> Column:
    """Line feeds plus one."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def tokens(c: Column) -> Column:
    """Identifier parts in lower case, of two characters at least, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1), F.lower), lambda t: F.length(t) > 1)


def chunk_tokens(symbol: Column, content: Column, layer: Column) -> Column:
    """A chunk's tokens for the lexical index: its symbol three times, 30 content lines that are no comments, the layer if known."""
    head = F.filter(F.slice(lines(F.coalesce(content, F.lit(""))), 1, 30), lambda x: ~F.ltrim(x).startswith("#") & ~F.ltrim(x).startswith("//"))
    own = F.flatten(F.array_repeat(tokens(F.coalesce(symbol, F.lit(""))), 3))
    known = F.coalesce(layer, F.lit("unknown"))
    return F.concat(own, tokens(F.array_join(head, "\n")), F.when(known != "unknown", tokens(known)).otherwise(F.array().cast("array<string>")))


def uuid5(*parts: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """The version 5 UUID of parts joined by the unit separator; null parts count as ''."""
    name = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def severity(c: Column) -> Column:
    """A severity's name, INFO for what is none."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*SEVERITIES), up).otherwise("INFO")


def severity_rank(c: Column) -> Column:
    out = F.lit(99)
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def category(c: Column) -> Column:
    """Lower case without a final ' rules'; blanks and slashes become _."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+rules$", ""), r"[\s/]+", "_")


def terms_match(a: Column, b: Column, shortest: int = 3) -> Column:
    """Either contains the other; if one is shorter than three characters they must be equal. Case doesn't matter."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((F.length(x) < shortest) | (F.length(y) < shortest), x == y).otherwise(x.contains(y) | y.contains(x))


def specific_term(c: Column, least: int = 4) -> Column:
    """Whether a term proves something: long enough and not generic."""
    x = F.lower(F.trim(c))
    return (F.length(x) >= least) & ~x.isin(*GENERIC_TERMS)


def head_lines(content: Column, most: int) -> Column:
    """The first lines, with a note of how many there are if some are cut."""
    ls = lines(content)
    note = F.concat(F.lit("\n... ("), F.size(ls).cast("string"), F.lit(" lines total)"))
    return F.when(F.size(ls) > most, F.concat(F.array_join(F.slice(ls, 1, most), "\n"), note)).otherwise(F.array_join(ls, "\n"))


def strip_generic(c: Column) -> Column:
    """A type's name without its arguments."""
    return F.trim(F.regexp_extract(c, r"^([^<\[]*)", 1))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repo_slug(url: Column) -> Column:
    """owner__repo of a repository's address."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.rtrim(url), r"/+$", ""), r"\.git$", ""), "[/:]")
    return F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("__"), F.try_element_at(parts, F.lit(-1)))


def run_id(at: Column, slug: Column, sha: Column) -> Column:
    """time__slug__commit, cut to 20 and 6 characters."""
    return F.concat_ws("__", F.date_format(at, "yyyyMMdd_HHmmss"), F.substring(slug, 1, 20), F.substring(sha, 1, 6))


def domain(path: Column) -> Column:
    """A path's first part, null if it has no other."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, 1))


def graded(value: Column, good: Column, fair: Column, higher: bool) -> Column:
    """PASS, WARN or FAIL of a value against two thresholds."""
    hit = (lambda t: value >= t) if higher else (lambda t: value < t)
    return F.when(hit(good), "PASS").when(hit(fair), "WARN").otherwise("FAIL")


def _tabs(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in lines:
        yield s.map(lambda x: None if x is None else _cut(x.expandtabs(4)))


def _cut(line: str, width: int = 120) -> str:
    return line if len(line) <= width else line[:width] + "…"


def _wrapped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import textwrap

    for s in texts:
        yield s.map(lambda t: None if t is None else "\n".join(textwrap.wrap(t, 72)))


#: Tab stops of four and at most 120 characters (by column, so it needs Python; batches come by Arrow).
tabs_expanded = F.pandas_udf(StringType())(_tabs)
#: Lines of 72 characters at most (Python, by Arrow).
wrapped = F.pandas_udf(StringType())(_wrapped)


def fence_stripped(c: Column) -> Column:
    """A text without the code fence around it."""
    s = F.trim(c)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*(\n|$)", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(s.startswith("```"), inner).otherwise(s)


def json_list(c: Column, size: Column) -> Column:
    """The trimmed items of a JSON array of `size` strings, perhaps within a code fence; null for anything else."""
    items = F.from_json(fence_stripped(c), "array<string>")
    return F.when(F.size(items) == size, F.transform(items, lambda x: F.trim(x)))


def service_base(url: Column) -> Column:
    """A model service's base address: without the endpoint and final slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"/chat/completions/?$", ""), "/+$", "")


def hosted_repository(url: Column) -> Column:
    """Whether an address is that of a repository on the public host."""
    return F.coalesce(F.trim(url).startswith("https://github.com/") | F.trim(url).startswith("http://github.com/"), F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays have the same distinct items."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def unlisted(found: Column, listed: Column) -> Column:
    """What is in one array and not in the other, sorted."""
    return F.array_sort(F.array_except(found, listed))


def utc_iso(c: Column) -> Column:
    """A time as ISO 8601 in UTC, with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
