"""Evaluation texts within training text: a prefix-filtered set join over word shingles with exact verification.

An item leaks where a document shares `run` consecutive words with it, so where all shingles of one of the item's windows
stand side by side. Of each window only the rarest shingle (by its frequency in all documents) is looked up: a document
without it can't hold the window. Matches must leave room for the window in both texts. They are then verified on the window: each of its
shingles must stand at its place in the document, so all its words do. Texts are read once and never shuffled; what leaves their
tasks are shingles that an item has, too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.neardup import _MIX, _scramble
from lodestone.llm.skeleton import Skeletons, confusables
from lodestone.session import cut

_WORD = re.compile(r"[^\W_]+")
#: Bits of the filter that documents' shingles pass before they leave their task, by the number of items' shingles: at least 16 a
#: shingle, but never more than 8 MB. Beyond 4 million shingles more of the documents' pass; the result is the same.
LEAST_LOG2, MOST_LOG2 = 20, 26


#: A run of other characters with the one before it, to which marks may belong.
_SEGMENT = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


class Words:
    """Splits texts into words: maximal runs of letters or digits, after look-alike differences (see skeleton) and case are set aside."""

    def __init__(self, more: dict[int, str] | None = None):
        form = Skeletons(more)
        self.composed = lru_cache(maxsize=1 << 16)(lambda segment: unicodedata.normalize("NFC", form(segment)))

    def __call__(self, text: str) -> list[str]:
        return _WORD.findall((text if text.isascii() else _SEGMENT.sub(lambda m: self.composed(m.group()), text)).lower())


words_of = Words()


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _shingles(words: list[str], size: int, cache: _Hashes) -> np.ndarray:
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + n] * _MIX[k]
    return _scramble(total)


def _tokens(rows: DataFrame, key: str, text: str, size: int, bits=None) -> DataFrame:
    """key, text_hash, pos, n (words), token: the shingles of each text; with `bits` (a broadcast bit set) only those that are in it."""
    kind, more = rows.schema[key].dataType.simpleString(), confusables(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, words_of = _Hashes(), Words(more)
        table = None if bits is None else np.frombuffer(bits.value, dtype=np.uint8)
        for b in batches:
            owner, place, count, token, same = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                s = _shingles(words, size, cache)
                at = np.arange(len(s))
                if table is not None and len(s):
                    low = (s & np.uint64(8 * len(table) - 1)).astype(np.int64)
                    hit = (table[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                    s, at = s[hit], at[hit]
                owner.append(np.full(len(s), i))
                place.append(at)
                count.append(np.full(len(s), len(words)))
                token.append(s.view(np.int64))
                same.append(np.full(len(s), xxhash.xxh64_intdigest(t) if len(s) else 0, np.uint64).view(np.int64))
            if owner:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(owner).astype(np.int64))), pa.array(np.concatenate(same)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(count).astype(np.int32)), pa.array(np.concatenate(token))], names=[key, "text_hash", "pos", "n", "token"])

    return rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, text_hash bigint, pos int, n int, token bigint")


def _bit_set(tokens: DataFrame):
    """A broadcast bit set of the tokens, built by blocks of 64 bits; its size is bounded."""
    n = tokens.count()
    log2 = min(max(LEAST_LOG2, (16 * n).bit_length()), MOST_LOG2)
    low = F.col("token").bitwiseAND(F.lit((1 << log2) - 1))
    words = tokens.select(F.shiftright(low, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros((1 << log2) // 64, dtype=np.int64)
    for r in words.toLocalIterator():  # at most a million rows, however many tokens
        table[r["w"]] = r["b"]
    return tokens.sparkSession.sparkContext.broadcast(table.tobytes())


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, size: int = 4, key: str = "doc_id", text: str = "text", item: str = "item_id", content: str = "content") -> DataFrame:
    """key, item: every document and item that share at least `run` consecutive words.

    Null or shorter texts share nothing. Repeated rows count once; a key that comes with two texts shares what either does. An item
    in many documents, or a document with many items, gives one row a pair. Words are compared by 64-bit hashes, a window by those of
    all its shingles.
    """
    span = run - size + 1  # shingles of a window
    wanted = cut(_tokens(items, item, content, size).select(item, F.col("text_hash").alias("version"), F.col("pos").alias("ipos"), F.col("n").alias("m"), "token").distinct())
    asked = cut(wanted.select("token").distinct())
    # estimates of sizes don't know how many shingles a text has: the documents' side is never broadcast
    hits = cut(_tokens(documents, key, text, size, _bit_set(asked)).hint("merge").join(asked, "token", "left_semi")).hint("merge")
    frequency = hits.select("token", key).distinct().groupBy("token").agg(F.count("*").alias("df"))
    known = wanted.join(frequency.hint("merge"), "token").withColumn("rank", F.struct("df", "token"))
    # of each window that has all its shingles in the corpus, the rarest
    window = Window.partitionBy(item, "version").orderBy("ipos").rangeBetween(0, span - 1)
    rarest = known.withColumn("least", F.min("rank").over(window)).withColumn("whole", F.count("*").over(window)).where(F.col("whole") == span)
    prefix = rarest.select(item, "version", F.col("least.token").alias("token"), F.col("ipos").alias("from")).distinct()
    placed = prefix.join(wanted.select(item, "version", "token", "ipos"), [item, "version", "token"]).where(F.col("ipos").between(F.col("from"), F.col("from") + span - 1))
    before = F.col("ipos") - F.col("from")
    # where a window would begin in a document: (key, text) and place, for a window of an item
    candidates = hits.join(placed, "token").where((F.col("pos") >= before) & (F.col("pos") - before + run <= F.col("n"))).select(key, "text_hash", (F.col("pos") - before).alias("start"), item, "version", "from").distinct()
    parts = wanted.select(item, "version", "ipos", F.col("token").alias("due"))
    due = candidates.hint("merge").join(parts, [item, "version"]).where(F.col("ipos").between(F.col("from"), F.col("from") + span - 1))
    due = due.select(key, "text_hash", "start", item, "version", "from", (F.col("start") + F.col("ipos") - F.col("from")).alias("pos"), F.col("due").alias("token"))
    stands = hits.select(key, "text_hash", "pos", "token").join(due.hint("merge"), [key, "text_hash", "pos", "token"])
    whole = stands.groupBy(key, "text_hash", "start", item, "version", "from").agg(F.count_distinct("pos").alias("found")).where(F.col("found") == span)
    return whole.select(key, item).distinct()


def by_item(found: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """item, documents: in how many documents each item leaked, 0 where it did in none."""
    return items.select(item).distinct().join(found.groupBy(item).agg(F.count("*").alias("documents")), item, "left").select(item, F.coalesce("documents", F.lit(0)).alias("documents"))
