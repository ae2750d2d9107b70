"""Queries of findings, comments and reports. Lines of orders stand for findings: the order is the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import review as V
from lodestone.plans import rules as _rules
from lodestone.plans.chunking import chunk_texts
from lodestone.plans.corpus import sql_lines
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_SQL = """issues AS (SELECT l_orderkey AS file, l_linenumber AS start_line, l_linenumber + (l_quantity / 25)::INT AS end_line, l_returnflag || l_linestatus AS rule_id,
  CASE WHEN l_quantity > 48 THEN 'CRITICAL' WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 20 THEN 'MEDIUM' WHEN l_quantity > 5 THEN 'LOW' ELSE 'INFO' END AS severity,
  1 - 10 * l_discount AS confidence, l_tax > 0.06 AS is_pre_flagged, l_partkey AS seq, l_suppkey AS seq2, l_extendedprice AS seq3 FROM lineitem)"""
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END"


def issues(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    severity = F.when(q > 48, "CRITICAL").when(q > 40, "HIGH").when(q > 20, "MEDIUM").when(q > 5, "LOW").otherwise("INFO")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.round(q / 25).cast("int")).alias("end_line"), F.concat("l_returnflag", "l_linestatus").alias("rule_id"),
        severity.alias("severity"), (1 - 10 * F.col("l_discount")).alias("confidence"), (F.col("l_tax") > 0.06).alias("is_pre_flagged"), F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("seq2"), F.col("l_extendedprice").alias("seq3"),
    )


@query(f"WITH {_SQL} SELECT file, start_line, rule_id, severity, round(confidence, 6) AS confidence, seq, seq2 FROM (SELECT *, row_number() OVER (PARTITION BY file, start_line, rule_id ORDER BY is_pre_flagged DESC, confidence DESC, {_RANK}, seq, seq2, seq3) AS r FROM issues WHERE confidence >= 0.5) WHERE r = 1")
def q_issue_dedup(spark: SparkSession, d: str) -> DataFrame:
    best = V.best_issue(issues(spark, d).where("confidence >= 0.5"), ["file", "start_line", "rule_id"], ["seq", "seq2", "seq3"])
    return best.select("file", "start_line", "rule_id", "severity", F.round("confidence", 6).alias("confidence"), "seq", "seq2")


_GROUPS = f"""{_SQL}, o AS (SELECT *, max(end_line) OVER (PARTITION BY file, is_pre_flagged ORDER BY start_line, seq, seq2, seq3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM issues),
  g0 AS (SELECT *, sum(CASE WHEN before IS NULL OR start_line - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file, is_pre_flagged ORDER BY start_line, seq, seq2, seq3 ROWS UNBOUNDED PRECEDING) AS group_no FROM o),
  g AS (SELECT file, is_pre_flagged, group_no, min(start_line) AS line, max(end_line) AS end_line, arg_min(severity, {_RANK}) AS severity, count(*) AS issues, round(avg(confidence), 6) AS confidence FROM g0 GROUP BY 1, 2, 3)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return V.comment_groups(issues(spark, d), ["file", "is_pre_flagged"], 1, ["seq", "seq2", "seq3"]).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_GROUPS} SELECT * FROM g")
def q_comment_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@query(
    f"""WITH {_GROUPS}, s AS (SELECT *, severity = 'CRITICAL' AS c, count_if(severity = 'CRITICAL') OVER (PARTITION BY file) AS nc, count_if(severity = 'CRITICAL') OVER () AS allc FROM g),
    f AS (SELECT *, nc + row_number() OVER (PARTITION BY file, c ORDER BY {_RANK}, confidence DESC, line, is_pre_flagged, group_no) AS pf FROM s),
    t AS (SELECT file, is_pre_flagged, group_no, allc + row_number() OVER (ORDER BY {_RANK}, confidence DESC, file, line, is_pre_flagged, group_no) AS pt FROM f WHERE NOT c AND pf <= 5)
    SELECT f.file, f.is_pre_flagged, f.group_no, f.severity, f.c OR coalesce(t.pt <= 2000, false) AS inline FROM f LEFT JOIN t USING (file, is_pre_flagged, group_no)"""
)
def q_comment_budget(spark: SparkSession, d: str) -> DataFrame:
    return V.budgeted(_groups(spark, d), "file", ["line", "is_pre_flagged", "group_no"], 5, 2000).select("file", "is_pre_flagged", "group_no", "severity", "inline")


@query(f"WITH {_SQL} SELECT file, arg_min(severity, {_RANK}) AS severity, count(*) AS n FROM issues GROUP BY 1")
def q_dominant_severity(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("file").agg(F.min_by("severity", T.severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("n"))


@query(f"WITH {_rules._SQL} SELECT 'MEDIUM' AS severity, 'GEN001' AS rule_id, count(*) AS n FROM c WHERE {_rules._FN} AND len(list_filter(ls, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|//)'))) > 50 HAVING count(*) > 0")
def q_sev_counts(spark: SparkSession, d: str) -> DataFrame:
    """The minimum slice: texts to lines to a rule to issues to counts by severity."""
    return _rules._of(spark, d, "GEN001").groupBy("severity", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {_SQL} SELECT rule_id, count(*) AS n, count(DISTINCT file) AS files FROM issues GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 10")
def q_top_rules(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).orderBy(F.col("n").desc(), "rule_id").limit(10)


@query(f"WITH {_SQL} SELECT file, count(*) AS issues, string_agg(severity || ':' || rule_id, ';' ORDER BY {_RANK}, start_line, rule_id) AS listed FROM issues GROUP BY 1")
def q_report_files(spark: SparkSession, d: str) -> DataFrame:
    rank = T.severity_rank(F.col("severity")).alias("rank")
    g = issues(spark, d).groupBy("file").agg(F.count("*").alias("issues"), F.array_sort(F.collect_list(F.struct(rank, "start_line", "rule_id", "severity"))).alias("i"))
    return g.select("file", "issues", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["severity"], x["rule_id"])), ";").alias("listed"))


@query()
def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    agent = F.element_at(F.array(*map(F.lit, ("security", "architecture", "style"))), (F.col("seq2") % 3 + 1).cast("int"))
    i = issues(spark, d).select("file", F.col("start_line").alias("line"), F.xxhash64("start_line", "seq", "seq2", "seq3").alias("seq"), agent.alias("agent"), "severity", "confidence")
    return V.consensus(i, "file")


@query(
    f"""WITH RECURSIVE b AS (SELECT repo_name, file_path, start_line, chunk_id, len({sql_lines('content')}) AS n, row_number() OVER (PARTITION BY repo_name, file_path ORDER BY start_line, chunk_id) AS i FROM (SELECT DISTINCT repo_name, file_path, chunk_id, chunk_type, start_line, content FROM chunks) WHERE content IS NOT NULL AND start_line IS NOT NULL AND chunk_type IN ('function', 'method', 'class', 'block')),
    w AS (SELECT *, 1 AS bundle, 1 AS cnt, n::BIGINT AS total FROM b WHERE i = 1 UNION ALL
      SELECT b.*, CASE WHEN w.cnt >= 5 OR w.total + b.n > 200 THEN w.bundle + 1 ELSE w.bundle END, CASE WHEN w.cnt >= 5 OR w.total + b.n > 200 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.cnt >= 5 OR w.total + b.n > 200 THEN b.n ELSE w.total + b.n END
      FROM w JOIN b ON b.repo_name = w.repo_name AND b.file_path = w.file_path AND b.i = w.i + 1)
    SELECT chunk_id, bundle FROM w"""
)
def q_bundle(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_texts(spark, d, "repo_name", "file_path", "chunk_id", "chunk_type", "start_line", "content").where("content IS NOT NULL AND start_line IS NOT NULL AND chunk_type IN ('function', 'method', 'class', 'block')")
    sized = c.select("repo_name", "file_path", "start_line", "chunk_id", T.line_count(F.col("content")).alias("n")).distinct()
    return V.bundles(sized, ["repo_name", "file_path"], ["start_line", "chunk_id"]).select("chunk_id", "bundle")


@query(
    """WITH c AS (SELECT DISTINCT chunk_id, symbol_name, parent_symbol, summary, start_line, end_line FROM chunks WHERE summary IS NOT NULL AND symbol_name IS NOT NULL),
    e AS (SELECT *, list_filter(list_slice(string_split(summary, ' '), 1, 3), lambda x: trim(x) <> '') AS ev FROM c)
    SELECT chunk_id, summary, coalesce(start_line <= end_line, false) AND len(list_filter(ev, lambda x: NOT (CASE WHEN length(trim(x)) < 3 OR length(trim(symbol_name)) < 3 THEN lower(trim(x)) = lower(trim(symbol_name)) ELSE contains(lower(trim(x)), lower(trim(symbol_name))) OR contains(lower(trim(symbol_name)), lower(trim(x))) END))) = 0 AS valid FROM e"""
)
def q_evidence_valid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "symbol_name", "parent_symbol", "summary", "start_line", "end_line").where("summary IS NOT NULL AND symbol_name IS NOT NULL").distinct()
    ok = V.evidence_valid(F.col("start_line"), F.col("start_line"), F.col("end_line"), F.slice(F.split("summary", " "), 1, 3), F.array("symbol_name"))
    return c.select("chunk_id", "summary", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("SELECT DISTINCT term, length(lower(trim(term))) >= 4 AND lower(trim(term)) NOT IN (" + ", ".join(f"'{t}'" for t in T.GENERIC_TERMS) + ") AS specific FROM (SELECT unnest(string_split(summary, ' ')) AS term FROM chunks WHERE summary IS NOT NULL)")
def q_term_specificity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("summary IS NOT NULL").select(F.explode(F.split("summary", " ")).alias("term")).distinct().select("term", T.specific_term(F.col("term")).alias("specific"))


_SNIP = f"""WITH {_rules._SQL}, v AS (SELECT chunk_id, start_line, ls, i FROM (SELECT c.chunk_id, c.start_line, c.ls, x.i, x.line FROM c JOIN x ON x.chunk_id = c.chunk_id WHERE c.{_rules._FN}) WHERE contains(line, 'return'))
  SELECT chunk_id, i::INT AS at, array_to_string(list_transform(list_slice(ls, greatest(1, i - 3), least(len(ls), i + 3)), lambda l, k: (greatest(1, i - 3) + k - 1) || ': ' || l), chr(10)) AS snippet FROM v"""


@query(_SNIP)
def q_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_texts(spark, d, "chunk_id", "chunk_type", "content").where("content IS NOT NULL AND chunk_type IN ('function', 'method')").withColumn("ls", T.lines(F.col("content")))
    hits = F.filter(F.transform("ls", lambda x, i: F.when(x.contains("return"), i + 1)), lambda i: i.isNotNull())
    cut = F.transform(hits, lambda at: F.struct(at.alias("at"), V.snippet(F.col("ls"), at, at).alias("snippet")))
    return c.select("chunk_id", F.explode(cut).alias("s")).select("chunk_id", "s.at", "s.snippet").distinct()
