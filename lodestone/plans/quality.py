"""Queries of ingestion quality, by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import classify, parsers, quality, standards, tags
from lodestone.operators import graph as G
from lodestone.operators import layers as L
from lodestone.plans.chunking import chunk_texts, chunks_once
from lodestone.plans.code_graph import _code_edges, _EDGES, _layer_sql, resolved
from lodestone.plans.corpus import flagged, sql_lines
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_P95 = f"""n AS (SELECT language, len({sql_lines('content')}) AS n FROM (SELECT DISTINCT chunk_id, language, chunk_type, content FROM chunks) WHERE content IS NOT NULL AND chunk_type <> 'module'),
  s AS (SELECT language, list_sort(list(n)) AS v, count(*) AS c FROM n GROUP BY 1), j AS (SELECT *, greatest(1, least(c - 1, (95 * (c + 1)) // 100)) AS j FROM s),
  p AS (SELECT language, CASE WHEN c = 1 THEN v[1]::DOUBLE ELSE (v[j] * (100 - (95 * (c + 1) - 100 * j)) + v[j + 1] * (95 * (c + 1) - 100 * j)) / 100 END AS p95 FROM j)"""


@query(f"WITH {_P95} SELECT language, round(p95, 6) AS p95 FROM p")
def q_quality_p95(spark: SparkSession, d: str) -> DataFrame:
    n = chunk_texts(spark, d, "chunk_id", "language", "chunk_type", "content").where("content IS NOT NULL AND chunk_type <> 'module'").select("chunk_id", "language", T.line_count(F.col("content")).alias("n")).distinct()
    return quality.p95(n, ["language"], "n").select("language", F.round("p95", 6).alias("p95"))


@query(f"WITH {_P95} SELECT language, round(p95, 6) AS value, CASE WHEN p95 < good THEN 'PASS' WHEN p95 < fair THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT p.*, CASE language " + " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in quality.BY_LANGUAGE["IQ-05"].items()) + " ELSE 150 END AS good, CASE language " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in quality.BY_LANGUAGE["IQ-05"].items()) + " ELSE 250 END AS fair FROM p)")
def q_quality_chunk_size(spark: SparkSession, d: str) -> DataFrame:
    v = q_quality_p95(spark, d).select(F.lit("IQ-05").alias("dim"), "language", F.col("p95").alias("value"))
    return quality.graded(v).select("language", "value", "status")


def primary_languages(spark: SparkSession, d: str) -> DataFrame:
    """repo_name, language: the most frequent known language of a repository's files, ties to the first by name."""
    n = flagged(spark, d).where(~F.col("language").isin("unknown", "binary")).groupBy("repo_name", "language").agg(F.count("*").alias("n"))
    return n.groupBy("repo_name").agg(F.lower(F.min_by("language", F.struct(-F.col("n"), "language"))).alias("language"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """repo_name, dim, value of the measures with one threshold; all repositories have all of them, null where nothing can be told (skipped)."""
    f = classify.parseable(flagged(spark, d)).where("is_parseable").select("repo_name", "file_id", "language", "content")
    symbols = parsers.symbols(f).groupBy("file_id").agg(F.count("*").alias("n"))
    parsed = f.select("repo_name", "file_id").join(symbols, "file_id", "left").groupBy("repo_name").agg((F.count_if(F.col("n") > 0) / F.count("*")).alias("IQ-01"), (F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("IQ-02"))
    layer = L.labels(F.col("path"))[0]
    unknown = table(spark, d, "repo_file").groupBy("repo_name").agg((F.count_if(layer == "unknown") / F.count("*")).alias("IQ-04"))
    sizes = chunk_texts(spark, d, "chunk_id", "repo_name", "chunk_type", "content").where("content IS NOT NULL AND chunk_type <> 'module'").select("chunk_id", "repo_name", T.line_count(F.col("content")).alias("n")).distinct()
    size = quality.p95(sizes, ["repo_name"], "n").select("repo_name", F.col("p95").alias("IQ-05"))
    calls = resolved(spark, d).groupBy("repo_name").agg((F.count_if(F.col("via") != "external") / F.count("*")).alias("IQ-03"))
    whole = unknown.join(parsed, "repo_name", "left").join(size, "repo_name", "left").join(calls, "repo_name", "left").withColumn("IQ-07", F.lit(None).cast("double"))  # chunks have no vectors here
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.round(F.col(k), 9).alias("value")) for k in ("IQ-01", "IQ-02", "IQ-03", "IQ-04", "IQ-05", "IQ-07"))))
    return whole.select("repo_name", rows.alias("r")).select("repo_name", "r.dim", "r.value")


def graph_measures(spark: SparkSession, d: str) -> DataFrame:
    """repo_name, cycles (of up to three chunks), orphan_rate of the graph within each repository."""
    names = chunks_once(spark, d, "chunk_id", "repo_name", "chunk_type").where("chunk_type NOT IN ('module', 'import')").select(F.col("chunk_id").alias("node"), "repo_name").distinct()
    edges = _code_edges(spark, d)
    alone = G.orphans(names, edges).groupBy("repo_name").agg(F.count("*").alias("orphans"))
    round_trips = G.cycles(edges, 3).select(F.split("cycle", ">")[0].alias("node")).join(names, "node").groupBy("repo_name").agg(F.count("*").alias("cycles"))
    all_nodes = names.groupBy("repo_name").agg(F.count("*").alias("nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_nodes.join(alone, "repo_name", "left").join(round_trips, "repo_name", "left").select("repo_name", zero("cycles").alias("cycles"), F.round(zero("orphans") / F.col("nodes"), 9).alias("orphan_rate"))


def dimensions(spark: SparkSession, d: str) -> DataFrame:
    """repo_name, dim, language, value, status, score of all seven dimensions, by the thresholds of each repository's primary language."""
    language = primary_languages(spark, d)
    own = lambda t: t.join(language, "repo_name", "left").withColumn("language", F.coalesce("language", F.lit("default")))
    six = quality.graded(own(measures(spark, d)))
    health = quality.graph_health(own(graph_measures(spark, d))).select("repo_name", F.lit("IQ-06").alias("dim"), "language", F.col("orphan_rate").alias("value"), "status", "score")
    return six.select("repo_name", "dim", "language", "value", "status", "score").unionByName(health)


@query(f"WITH {_layer_sql()} SELECT repo_name, round(count_if(len(found) = 0) / count(*), 9) AS value, CASE WHEN count_if(len(found) = 0) / count(*) < 0.2 THEN 'PASS' WHEN count_if(len(found) = 0) / count(*) < 0.4 THEN 'WARN' ELSE 'FAIL' END AS status FROM labelled JOIN repo_file USING (file_id) GROUP BY 1")
def q_quality_layers(spark: SparkSession, d: str) -> DataFrame:
    layer = L.labels(F.col("path"))[0]
    unknown = table(spark, d, "repo_file").groupBy("repo_name").agg(F.round(F.count_if(layer == "unknown") / F.count("*"), 9).alias("value"))
    return quality.graded(unknown.select("repo_name", F.lit("IQ-04").alias("dim"), F.lit("default").alias("language"), "value")).select("repo_name", "value", "status")


@query()
def q_quality_decision(spark: SparkSession, d: str) -> DataFrame:
    return quality.decision(dimensions(spark, d), ["repo_name"])


@query()
def q_quality_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return dimensions(spark, d)


_ORPHANS = f"""{_EDGES}, nodes AS (SELECT DISTINCT chunk_id, repo_name FROM c WHERE chunk_type NOT IN ('module', 'import')), alone AS (SELECT repo_name, count(*) AS nodes, count_if(chunk_id NOT IN (SELECT dst FROM edges)) AS orphans FROM nodes GROUP BY 1),
  pairs AS (SELECT DISTINCT src, dst FROM edges), loops AS (SELECT a.src AS node FROM pairs a JOIN pairs b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src FROM pairs a JOIN pairs b ON b.src = a.dst JOIN pairs e ON e.src = b.dst AND e.dst = a.src WHERE a.src < b.src AND a.src < e.src AND b.src <> e.src UNION ALL SELECT src FROM pairs WHERE src = dst),
  trips AS (SELECT repo_name, count(*) AS cycles FROM loops JOIN nodes ON chunk_id = node GROUP BY 1)"""


@query(f"WITH {_ORPHANS} SELECT repo_name, coalesce(cycles, 0) AS cycles, round(orphans / nodes, 9) AS orphan_rate FROM alone LEFT JOIN trips USING (repo_name)")
def q_graph_health(spark: SparkSession, d: str) -> DataFrame:
    return graph_measures(spark, d)


@query()
def q_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of every file whose language has a parser."""
    s = parsers.symbols(flagged(spark, d))
    return s.select("file_id", "seq", "kind", "name", "start_line", "end_line", "parent", F.size("calls").alias("n_calls"), F.array_join("bases", ",").alias("bases"))


@query()
def q_symbol_density(spark: SparkSession, d: str) -> DataFrame:
    f = flagged(spark, d).select("file_id", "language")
    n = q_symbols(spark, d).groupBy("file_id").agg(F.count("*").alias("n"))
    return f.join(n, "file_id", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


#: Rules in the markdown form that the parser reads.
EXAMPLE = "## General Rules\n\n### GEN001 — Short functions\n- **Severity**: MEDIUM\n- **Language**: all\n- Keep functions under 50 lines.\n- **Bad:**\n```\nlong\n```\n- **Good:**\n```\nshort\n```\n\n### SEC001 - No secrets\n- **Severity**: CRITICAL\n- **Category**: security\n- Read them from a store.\n\n## Python Rules\n\n### PY001 — Type hints\n- **Severity**: LOW\n- **Language**: python\n- Annotate.\n"


@query("SELECT * FROM (VALUES ('GEN001', 'all', 'general', 'MEDIUM', 'Short functions'), ('SEC001', 'all', 'security', 'CRITICAL', 'No secrets'), ('PY001', 'python', 'python', 'LOW', 'Type hints')) t(rule_id, language, category, severity, title)")
def q_rules(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("example.md", EXAMPLE)], "name string, text string")
    return standards.rules(texts).select("rule_id", "language", "category", "severity", "title")


@query(
    """WITH r AS (SELECT * FROM (VALUES ('GEN001', 'all', 2), ('SEC001', 'all', 0), ('PY001', 'python', 3)) t(rule_id, l, rank)), c AS (SELECT DISTINCT language FROM chunks WHERE language IS NOT NULL)
    SELECT language, rule_id, row_number() OVER (PARTITION BY language ORDER BY rank, rule_id) AS rank FROM c JOIN r ON l = language OR l = 'all'"""
)
def q_rules_for_language(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("example.md", EXAMPLE)], "name string, text string")
    languages = table(spark, d, "chunks").where("language IS NOT NULL").select("language").distinct()
    return standards.for_languages(standards.rules(texts), languages).select("language", "rule_id", "rank")


@query()
def q_symbol_tags(spark: SparkSession, d: str) -> DataFrame:
    """What frameworks make of the symbols of Kotlin, Rust, Swift and Dart files."""
    f = flagged(spark, d).where(F.col("language").isin("kotlin", "rust", "swift", "dart"))
    where = f.select("file_id", "repo_name", F.col("path").alias("file_path"), "language")
    return tags.tags(parsers.symbols(f, source=True).join(where, "file_id"))
