"""Queries of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.incremental import merkle
from lodestone.session import shared_dir
from lodestone.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "chunk_feed").withColumn("content_hash", F.lower("content_hash"))
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    return merkle.replay(feed, table(spark, d, "runs"), folder, "chunk_id", "content_hash", "arrived_at", ["arrived_at", "feed_seq"]).select("run_id", "chunk_id")


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p6_found for all runs at once, without published states."""
    feed = table(spark, d, "chunk_feed").withColumn("content_hash", F.lower("content_hash"))
    return merkle.changes_by_run(feed, table(spark, d, "runs"), "chunk_id", "content_hash", "arrived_at", ["arrived_at", "feed_seq"]).select("run_id", "chunk_id")


def queries():
    return {"p6_found": p6_found, "p6_changes": p6_changes}


def oracle_sql():
    sql = """
            WITH good AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS i FROM runs WHERE status = 'success'),
            state AS (
              SELECT g.i, g.run_id, f.chunk_id, arg_max(lower(f.content_hash), (f.arrived_at, f.feed_seq)) AS h
              FROM good g JOIN chunk_feed f ON f.arrived_at <= g.started_at AND f.content_hash IS NOT NULL
              GROUP BY g.i, g.run_id, f.chunk_id)
            SELECT a.run_id, a.chunk_id FROM state a LEFT JOIN state b ON b.i = a.i - 1 AND b.chunk_id = a.chunk_id
            WHERE b.h IS NULL OR b.h <> a.h"""
    return {"p6_found": sql, "p6_changes": sql}
