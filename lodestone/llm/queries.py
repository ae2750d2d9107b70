"""Queries of the operators for training text, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import docpairs, leakage, mixing, neardup, origin, secrets, skeleton, split, syntax
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.detect(table(spark, d, "chunks")).select("chunk_id", "line_no").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "chunks")).select("chunk_id", "symbol_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.not_hand_written(table(spark, d, "repo_file")).select("file_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "chunks")).where(F.col("piece_no") == 0).select("chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check(table(spark, d, "repo_file"), table(spark, d, "files")).where(F.col("cost") > 0).select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.check(table(spark, d, "repo_file"), table(spark, d, "files")))


#: Parameters that TESTDATA.md states for problem 7: three words, similarity 0.6, at least 30 words.
_P7 = {"key": "chunk_id", "text": "content", "threshold": 0.6, "size": 3, "least_words": 30}


def _declarations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.col("chunk_type").isin("function", "method", "class"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(_declarations(spark, d), **_P7)
    return neardup.pairs(members, links, "chunk_id").select(F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped(_declarations(spark, d), **_P7)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.by_item(leakage.leaks(table(spark, d, "documents"), items), items)


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alikes(table(spark, d, "documents")).select(F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
            SELECT DISTINCT chunk_id FROM chunks WHERE content IS NOT NULL AND (
              octet_length(encode(content)) > 8000
              OR length(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) - length(replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), ''))
                 + CASE WHEN content <> '' AND right(content, 1) NOT IN (chr(10), chr(13)) THEN 1 ELSE 0 END > 150)""",
    }
