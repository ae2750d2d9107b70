"""Queries of event logs, ledgers, caches and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import telemetry as M
from lodestone.plans.registry import query
from lodestone.sources import corpus
from lodestone.sources.tables import table


@query("SELECT event_id, round(sum(value) OVER w, 4) AS rolling, count(*) OVER w AS calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")
def q_ledger_24h(spark: SparkSession, d: str) -> DataFrame:
    return M.rolling(table(spark, d, "events"), ["user_id"], "ts", "value", 86_400).select("event_id", F.round("rolling", 4).alias("rolling"), "calls")


@query("SELECT user_id, count(*) AS calls, round(sum(value), 4) AS spend, count(DISTINCT event_type) AS types FROM events GROUP BY 1")
def q_run_spend(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("spend"), F.count_distinct("event_type").alias("types"))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum((props->>'k')::BIGINT) AS k FROM events GROUP BY 1")
def q_event_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(k).alias("k"))


@query("SELECT event_id, calls FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls FROM events) WHERE calls > 5")
def q_rate_audit(spark: SparkSession, d: str) -> DataFrame:
    return M.over_limit(table(spark, d, "events"), ["event_type"], "ts", 5, 3600).select("event_id", "calls")


@query("SELECT run_id, status, CASE WHEN finished_at IS NOT NULL THEN epoch_us(finished_at) - epoch_us(started_at) END AS duration_us, row_number() OVER (ORDER BY started_at) AS place FROM runs")
def q_stage_times(spark: SparkSession, d: str) -> DataFrame:
    # one short row a run
    return table(spark, d, "runs").select("run_id", "status", (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("duration_us"), F.row_number().over(Window.orderBy("started_at")).alias("place"))


_PREFIXES = (("review", 1), ("review_c", 2), ("chunk", 3), ("r", 4), ("design_notes", 5))


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in _PREFIXES) + ") t(prefix, rate)), s AS (SELECT DISTINCT source FROM documents) SELECT source, arg_max(rate, length(prefix)) AS rate FROM s LEFT JOIN p ON starts_with(source, prefix) GROUP BY 1")
def q_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(list(_PREFIXES), "prefix string, rate int")
    return M.longest_prefix(table(spark, d, "documents").select("source").distinct(), t, "source", "prefix").select("source", "rate")


_FEED = "SELECT chunk_id, arg_{m}(lower(content_hash), (arrived_at, feed_seq)) AS h FROM chunk_feed WHERE content_hash IS NOT NULL GROUP BY 1"


def _state(spark: SparkSession, d: str, pick) -> DataFrame:
    return table(spark, d, "chunk_feed").where("content_hash IS NOT NULL").groupBy("chunk_id").agg(pick(F.lower("content_hash"), F.struct("arrived_at", "feed_seq")).alias("h"))


@query(f"WITH old AS ({_FEED.format(m='min')}), new AS (SELECT DISTINCT chunk_id, md5(content) AS h FROM chunks WHERE content IS NOT NULL) SELECT new.chunk_id, new.h FROM new LEFT JOIN old USING (chunk_id) WHERE new.h IS DISTINCT FROM old.h")
def q_incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", F.md5("content").alias("h")).distinct()
    return corpus.to_upsert(_state(spark, d, F.min_by), new, ["chunk_id"], "h")


@query(f"WITH old AS ({_FEED.format(m='min')}), new AS ({_FEED.format(m='max')}) SELECT new.chunk_id, new.h FROM new LEFT JOIN old USING (chunk_id) WHERE new.h IS DISTINCT FROM old.h")
def q_changed_files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.changed_files(_state(spark, d, F.min_by), _state(spark, d, F.max_by), ["chunk_id"], "h")


@query(f"WITH old AS ({_FEED.format(m='min')}), new AS (SELECT DISTINCT chunk_id, md5(content) AS h FROM chunks WHERE content IS NOT NULL) SELECT chunk_id, h FROM new UNION ALL SELECT chunk_id, h FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)")
def q_merged(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", F.md5("content").alias("h")).distinct()
    return corpus.merged(_state(spark, d, F.min_by), new, ["chunk_id"])


@query("WITH c AS (SELECT md5(content) AS h, min(summary) AS summary FROM chunks WHERE content IS NOT NULL AND coalesce(summary, '') <> '' GROUP BY 1), n AS (SELECT DISTINCT chunk_id, md5(content) AS h FROM chunks WHERE content IS NOT NULL) SELECT n.chunk_id, c.summary FROM n LEFT JOIN c USING (h)")
def q_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", F.md5("content").alias("h"), "summary")
    cache = c.where(F.coalesce("summary", F.lit("")) != "").groupBy("h").agg(F.min("summary").alias("summary"))
    return c.select("chunk_id", "h").distinct().join(cache, "h", "left").select("chunk_id", "summary")


#: Cases are source spellings: a document's rule is found, the commonest severity of each rule is expected, INFO is forbidden.
_EVAL = """found AS (SELECT source AS case_id, rule_id, severity FROM documents WHERE rule_id IS NOT NULL),
  must AS (SELECT DISTINCT case_id, rule_id, 'HIGH' AS severity FROM found), never AS (SELECT DISTINCT case_id, rule_id, 'INFO' AS severity FROM found),
  hit AS (SELECT m.case_id, count(*) AS t FROM must m WHERE EXISTS (SELECT 1 FROM found f WHERE f.case_id = m.case_id AND f.rule_id = m.rule_id AND f.severity = m.severity) GROUP BY 1),
  w AS (SELECT case_id, count(*) AS wanted FROM must GROUP BY 1), b AS (SELECT case_id, count(*) FILTER (WHERE severity = 'INFO') AS fp, count(*) FILTER (WHERE severity IS NULL OR severity NOT IN ('INFO', 'HIGH')) AS unexpected FROM found GROUP BY 1),
  counts AS (SELECT w.case_id, coalesce(t, 0) AS tp, wanted - coalesce(t, 0) AS fn, fp, unexpected FROM w LEFT JOIN hit USING (case_id) JOIN b USING (case_id))"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").where("rule_id IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("case_id"), "rule_id", "severity")
    keys = f.select("case_id", "rule_id").distinct()
    return M.evaluated(f, keys.withColumn("severity", F.lit("HIGH")), keys.withColumn("severity", F.lit("INFO")))


@query(f"WITH {_EVAL} SELECT case_id, tp, fn, fp, unexpected FROM counts")
def q_eval_case(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query(f"WITH {_EVAL}, s AS (SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(unexpected) AS unexpected FROM counts) SELECT tp, fn, fp, unexpected, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM s")
def q_eval_micro(spark: SparkSession, d: str) -> DataFrame:
    return M.scores(_counts(spark, d)).select("tp", "fn", "fp", "unexpected", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))
