"""Sources mixed to target weights by tokens, with capped repetition.

Tokens are summed per source, a rate follows from each target, and every document is taken floor(rate) times plus once more with
the fraction as probability, decided by a hash of mix and document: the same on every run and machine, without state.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut

#: The public byte-level BPE with 50,257 ids; any file of the tokenizers library will do. Only the driver reads it.
TOKENIZER = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _vocabulary(spark: SparkSession, path: str):
    """The tokenizer's file as a broadcast, so that no executor needs a copy of its own; files over 64 MB are refused."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} has {len(data)} bytes, which is no vocabulary")
    return spark.sparkContext.broadcast(data)


def source_name(column: str = "source") -> Column:
    """A source's one spelling: trimmed, lower case, `_` for `-` and blanks."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[-\s]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, source, tokens of each document; null texts have no tokens, null sources are a source of their own (null)."""
    kind, vocabulary = documents.schema[key].dataType.simpleString(), _vocabulary(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(vocabulary.value)
        t.encode_special_tokens = True
        for b in batches:
            n = [len(e.ids) for e in t.encode_batch_fast([x or "" for x in b.column(2).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=[key, "source", "tokens"])

    return documents.select(key, source_name().alias("source"), text).mapInArrow(run, f"{key} {kind}, source string, tokens bigint")


def rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, source_tokens, rate, short_tokens: how often each source's documents are taken.

    short_tokens is what a source lacks for its share, because of its cap or because it has no documents.

    The rate gives the source its share of budget_ratio times all tokens, but at most max_repeats. A source without
    documents or tokens has rate 0. A source named twice in a mix (by spelling) has the sum of its shares and the larger cap.
    """
    total = counts.agg(F.sum("tokens").alias("all_tokens"))
    own = counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    wanted = targets.withColumn("source", source_name()).groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    joined = wanted.join(own, "source", "left").join(F.broadcast(total))  # one row
    tokens = F.coalesce("source_tokens", F.lit(0))
    due = F.col("target_share") * F.col("budget_ratio") * F.coalesce("all_tokens", F.lit(0))
    rate = F.when(tokens > 0, F.least(F.col("max_repeats").cast("double"), due / tokens)).otherwise(F.lit(0.0))
    short = F.greatest(F.lit(0.0), due - rate * tokens)
    return joined.select("mix_name", "source", "target_share", "max_repeats", tokens.alias("source_tokens"), rate.alias("rate"), F.round(short).cast("bigint").alias("short_tokens"))


def copies(counts: DataFrame, rate: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """mix_name, source, key, tokens, copies (1 or more) of every document that a mix takes."""
    part = F.col("rate") - F.floor("rate")
    # 52 bits of a hash as a number from 0 up to 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", F.col(key)), 12) / F.lit(float(1 << 52))
    taken = counts.join(F.broadcast(rate.select("mix_name", "source", "rate")), "source").withColumn("copies", (F.floor("rate") + (draw < part).cast("int")).cast("int"))
    return taken.where((F.col("copies") > 0) & (F.col("tokens") > 0)).select("mix_name", "source", key, "tokens", "copies")


def expand(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """mix_name, source, target_share, actual_share, tokens, documents, rate, most_copies, short_tokens: what each mix came to."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("mix_name").agg(F.sum("got").alias("all_got"))
    out = rate.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("mix_name", "source", "target_share", F.round(zero("got") / F.col("all_got"), 6).alias("actual_share"), zero("got").alias("tokens"), zero("documents").alias("documents"), F.round("rate", 6).alias("rate"), zero("most_copies").alias("most_copies"), "short_tokens")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of all mixes. The texts are tokenized once; counts are a few bytes a document."""
    counts = cut(token_counts(documents, tokenizer).where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))
    rate = cut(rates(counts, targets))
    mixed = copies(counts, rate, seed)
    return mixed, shares(mixed, rate)
