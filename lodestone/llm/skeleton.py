"""Visually identical text with different characters: one form in which look-alikes are equal.

The skeleton of a text decomposes it, replaces every character by its prototype from a table of look-alikes, drops what
has no width, and decomposes again. Texts are grouped by equal skeleton. The table is the public one of confusable characters as
the session's Unicode library has it, restricted to letters of other scripts that stand for one letter of the same case; a few fixed
entries come first and serve where there is no session. Case, accents, raised or enclosed digits, line breaks
and everything else the eye tells apart stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.neardup import expanded
from lodestone.session import cut

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian and Cherokee
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Single blanks.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters without width.
NO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(a): b for a, b in LOOK_ALIKES.items()}
    out |= {ord(c): " " for c in BLANKS} | {ord(c): None for c in NO_WIDTH}
    for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF66, 0xFFDD)):  # width forms of letters
        wide = unicodedata.normalize("NFKC", chr(c))
        if unicodedata.category(chr(c))[0] in "LM" and wide != chr(c):
            out[c] = wide
    return out


#: Joiners and selectors that change how their neighbours look: within pictographs, and in scripts whose letters join.
_PICTURE = "[\u2190-\u21ff\u2300-\u23ff\u2460-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
_JOINING = "[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff]"
_KEPT = re.compile(f"(?<={_PICTURE})[\ufe0e\ufe0f]|(?:(?<={_PICTURE})|(?<={_PICTURE}\ufe0f)|(?<=[\U0001f3fb-\U0001f3ff]))\u200d(?={_PICTURE})|(?<={_JOINING})[\u200c\u200d](?={_JOINING})")
_MARKS = {"\ufe0e": "\ue0f0", "\ufe0f": "\ue0f1", "\u200d": "\ue0f2", "\u200c": "\ue0f3"}
_BACK = {ord(v): k for k, v in _MARKS.items()}


_OTHER = re.compile(r"[^\x00-\x7f]+")
#: Scripts with upper and lower case, whose letters may stand for each other's; by the begin of their letters' names.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "GEORGIAN", "GLAGOLITIC", "DESERET", "OSAGE", "VITHKUQI", "MEDEFAIDRIN", "WARANG CITI")


class Skeletons:
    """Gives texts their skeletons, by the fixed entries and `more` (code point to letter); short runs of characters are computed once."""

    def __init__(self, more: dict[int, str] | None = None):
        self.table = (more or {}) | _table()
        self.run = lru_cache(maxsize=1 << 16)(self._run)

    def _run(self, text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        kept = _KEPT.search(text) is not None
        if kept:
            text = _KEPT.sub(lambda m: _MARKS[m.group()], text)
        text = text.translate(self.table)
        if kept:
            text = text.translate(_BACK)
        return unicodedata.normalize("NFD", text)

    def __call__(self, text: str) -> str:
        """The form in which texts that look the same are equal.

        ASCII characters stay, take no part in decompositions and separate the runs of others, which are short and often the same.
        """
        return text if text.isascii() else _OTHER.sub(lambda m: self.run(m.group()), text)


skeleton = Skeletons()


@lru_cache(maxsize=1)
def _letters() -> tuple[str, ...]:
    return tuple(c for c in map(chr, range(0x370, 0x1F000)) if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.name(c, "").startswith(SCRIPTS) and unicodedata.normalize("NFD", c) == c)


def confusables(spark: SparkSession) -> dict[int, str]:
    """Code points of other scripts' letters with the letter they look like; some hundred entries from the public table of confusable characters.

    A letter is taken to the ASCII letter of its case with the same prototype; letters of several scripts that share another letter as
    prototype are taken to that. Digits, marks, signs and prototypes of several characters are left alone: the eye tells them apart.
    """
    checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    ascii_letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    letters = _letters()
    # one call for all of them; line ends separate
    prototypes = checker.getSkeleton(0, "\n".join((*ascii_letters, *letters))).split("\n")
    plain = {(p, a.isupper()): a for a, p in zip(ascii_letters, prototypes)}
    any_case = set(prototypes[: len(ascii_letters)])
    out = {}
    for c, p in zip(letters, prototypes[len(ascii_letters) :]):
        if (p, c.isupper()) in plain:
            out[ord(c)] = plain[p, c.isupper()]
        elif p != c and p not in any_case and len(p) == 1 and p.isalpha() and p.isupper() == c.isupper():
            out[ord(c)] = p
    # a prototype that is itself taken to another letter stands for that one
    return {c: out.get(ord(p), p) for c, p in out.items()}


def canonical(texts: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """key, t1, t2, s1, s2[, skeleton]: 128-bit hashes of each text and of its skeleton. Null texts and keys are left out; an empty text is its own skeleton."""

    more = confusables(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Skeletons(more)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([form(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "text", "skeleton"])

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, text string, skeleton string")
    hashed = [F.xxhash64(F.lit(i), c).alias(f"{n}{i}") for n, c in (("t", "text"), ("s", "skeleton")) for i in (1, 2)]
    return rows.select(key, *hashed, *(["skeleton"] if keep_text else []))


def look_alikes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """{key}_a < {key}_b: all pairs whose texts look the same but differ in characters.

    Only groups with two different texts take part, so any number of equal copies costs nothing unless a variant of them
    exists. Equal texts give no pair. A key that comes twice counts once, with each of its texts.
    """
    rows = cut(canonical(texts, key, text).distinct().withColumn("id", F.xxhash64("t1", "t2")))  # a few dozen bytes a text; the texts are read once
    varied = rows.groupBy("s1", "s2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") != F.col("hi")).select("s1", "s2")
    part = rows.hint("merge").join(varied.hint("merge"), ["s1", "s2"], "left_semi").select(key, "id", "s1", "s2")
    # different texts meet within a skeleton, not their copies
    forms = part.select("s1", "s2", "id").distinct()
    links = forms.withColumnRenamed("id", "a").hint("merge").join(forms.withColumnRenamed("id", "b").hint("merge"), ["s1", "s2"]).where(F.col("a") < F.col("b")).select("a", "b")
    found = expanded(part.select(key, "id"), links, key)
    return found.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).where(F.col(f"{key}_a") != F.col(f"{key}_b")).distinct()
