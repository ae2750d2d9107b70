"""What the engine gives beyond its own operators: multi-dimensional, temporal and approximate queries in native form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, date_trunc('day', ts))")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")).cube("event_type", "day").agg(F.count("*").alias("n"))


@query("SELECT c.feed_seq, r.run_id FROM (SELECT DISTINCT feed_seq, arrived_at FROM chunk_feed WHERE arrived_at IS NOT NULL) c ASOF LEFT JOIN runs r ON c.arrived_at >= r.started_at")
def ext_asof(spark: SparkSession, d: str) -> DataFrame:
    """The run that was the last to start when a row arrived; runs are few, so they travel as one sorted array."""
    starts = table(spark, d, "runs").agg(F.array_sort(F.collect_list(F.struct("started_at", "run_id"))).alias("s"))
    rows = table(spark, d, "chunk_feed").where("arrived_at IS NOT NULL").select("feed_seq", "arrived_at").distinct()
    before = F.filter("s", lambda x: x["started_at"] <= F.col("arrived_at"))
    return rows.join(F.broadcast(starts)).select("feed_seq", F.try_element_at(before, F.lit(-1))["run_id"].alias("run_id"))  # one row


@query(
    """WITH s AS (SELECT DISTINCT repo_name, file_path, chunk_id, start_line, end_line FROM chunks WHERE chunk_type IN ('class_head', 'method') AND end_line IS NOT NULL AND start_line IS NOT NULL)
    SELECT a.chunk_id AS a, b.chunk_id AS b FROM s a JOIN s b ON a.repo_name = b.repo_name AND a.file_path = b.file_path AND a.start_line <= b.end_line AND a.end_line >= b.start_line AND a.chunk_id < b.chunk_id"""
)
def ext_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping spans of a file; the file is an equi-join key, so only a file's own spans meet."""
    s = table(spark, d, "chunks").where("chunk_type IN ('class_head', 'method') AND end_line IS NOT NULL AND start_line IS NOT NULL").select("repo_name", "file_path", "chunk_id", "start_line", "end_line").distinct()
    a, b = (s.select("repo_name", "file_path", *(F.col(c).alias(f"{p}_{c}") for c in ("chunk_id", "start_line", "end_line"))) for p in "ab")
    meets = (F.col("a_start_line") <= F.col("b_end_line")) & (F.col("a_end_line") >= F.col("b_start_line")) & (F.col("a_chunk_id") < F.col("b_chunk_id"))
    return a.join(b, ["repo_name", "file_path"]).where(meets).select(F.col("a_chunk_id").alias("a"), F.col("b_chunk_id").alias("b"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2"""
)
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("fresh", F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 12 * 3_600_000_000, 0).otherwise(1))
    s = e.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.events import windowed

    return windowed(table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query()
def ext_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_extendedprice", F.lit(0.5), F.lit(1000)).alias("median_price"))
