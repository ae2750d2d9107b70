"""Queries of stores, small functions, standards by language and further measures of the code's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import layers as L
from lodestone.operators import retrieval, standards
from lodestone.plans import review as _review
from lodestone.plans import rules as _rules
from lodestone.plans.chunking import FILE, chunk_texts, chunks_once
from lodestone.plans.code_graph import _CALLS, _EDGES, _code_edges, resolved
from lodestone.plans.corpus import sql_lines
from lodestone.plans.quality import EXAMPLE
from lodestone.plans.registry import query
from lodestone.sources import stores
from lodestone.sources.tables import table

_LONG = f"long AS (SELECT chunk_id FROM c WHERE {_rules._FN} AND len(list_filter(ls, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|//)'))) > 50)"


@query(
    f"""WITH {_rules._SQL}, {_LONG} SELECT chunk_id, any_value(repo_name) AS repo_name, any_value(chunk_type) AS chunk_type, any_value(content_hash) AS content_hash, CASE WHEN chunk_id IN (SELECT chunk_id FROM long) THEN 'GEN001' ELSE '' END AS violations FROM (SELECT chunk_id, repo_name, chunk_type, md5(content) AS content_hash FROM chunks) GROUP BY chunk_id"""
)
def q_payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a store keeps of each chunk, without its texts."""
    c = table(spark, d, "chunks").withColumn("content_hash", F.md5("content"))
    p = stores.payload(c, _rules._of(spark, d, "GEN001"))
    return p.select("chunk_id", "repo_name", "chunk_type", "content_hash", F.array_join("violations", ",").alias("violations"))


@query()
def q_chunk_postings(spark: SparkSession, d: str) -> DataFrame:
    """The lexical index over chunks, modules left out: terms of names three times, of first lines, of layers."""
    c = chunk_texts(spark, d, "chunk_id", "chunk_type", "symbol_name", "content", "layer").where("chunk_type <> 'module'")
    terms = c.select("chunk_id", T.chunk_tokens(F.col("symbol_name"), F.col("content"), F.col("layer")).alias("terms")).dropDuplicates(["chunk_id"])
    return retrieval.postings(terms, "chunk_id", "terms")


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'a|b' END AS items FROM events")
def q_json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists that a model answered with: plain, fenced, of the wrong length, and no list."""
    answers = F.array(F.lit('["a", " b "]'), F.lit('```json\n["a", "b"]\n```'), F.lit('["a"]'), F.lit("none"))
    e = table(spark, d, "events").select("event_id", F.element_at(answers, (F.col("event_id") % 4 + 1).cast("int")).alias("a"))
    return e.select("event_id", F.array_join(T.json_list(F.col("a"), F.lit(2)), "|").alias("items"))


@query("SELECT DISTINCT repo_name, 'https://host/v' || length(repo_name) AS base, length(repo_name) % 2 = 0 AS hosted FROM chunks")
def q_addresses(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("repo_name").distinct()
    n = F.length("repo_name")
    base = T.service_base(F.concat(F.lit(" https://host/v"), n.cast("string"), F.when(n % 3 == 0, "/chat/completions/").when(n % 3 == 1, "/chat/completions").otherwise("//")))
    hosted = T.hosted_repository(F.when(n % 2 == 0, F.concat(F.lit("https://github.com/"), "repo_name")).otherwise("git@host:x"))
    return c.select("repo_name", base.alias("base"), hosted.alias("hosted"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def q_event_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.utc_iso(F.col("ts")).alias("at"))


@query(f"WITH {_review._SQL} SELECT file, (list_sort(list_distinct(list(severity))) = ['LOW', 'MEDIUM'])::BOOLEAN AS alike, array_to_string(list_sort(list_filter(list_distinct(list(severity)), lambda x: x NOT IN ('LOW', 'HIGH'))), ',') AS rest FROM issues GROUP BY 1")
def q_category_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order's severities are exactly two given ones, and which are others than two given."""
    g = _review.issues(spark, d).groupBy("file").agg(F.collect_set("severity").alias("s"))
    return g.select("file", T.same_set(F.col("s"), F.array(F.lit("MEDIUM"), F.lit("LOW"))).alias("alike"), F.array_join(T.unlisted(F.col("s"), F.array(F.lit("HIGH"), F.lit("LOW"))), ",").alias("rest"))


@query("SELECT * FROM (VALUES ('all', 2, 1), ('python', 1, 0)) t(language, rules, critical)")
def q_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    c = standards.counts(standards.rules(spark.createDataFrame([("example.md", EXAMPLE)], "name string, text string")))
    return c.select("language", F.col("rules").cast("int").alias("rules"), F.col("critical").cast("int").alias("critical"))


@query("SELECT language, 'SEC001' AS rule_id, 1 AS rank FROM (SELECT DISTINCT language FROM chunks WHERE language IS NOT NULL)")
def q_rules_by_category(spark: SparkSession, d: str) -> DataFrame:
    languages = table(spark, d, "chunks").where("language IS NOT NULL").select("language").distinct()
    r = standards.grave(standards.rules(spark.createDataFrame([("example.md", EXAMPLE)], "name string, text string")))
    return standards.for_languages(r, languages, categories=languages.withColumn("category", F.lit("security"))).select("language", "rule_id", "rank")


@query(f"WITH {_rules._SQL}, {_LONG} SELECT count(*) AS violations, count(DISTINCT chunk_id) AS chunks FROM long")
def q_violation_total(spark: SparkSession, d: str) -> DataFrame:
    return _rules._of(spark, d, "GEN001").agg(F.count("*").alias("violations"), F.count_distinct("chunk_id").alias("chunks"))


@query(f"WITH n AS (SELECT DISTINCT chunk_id, language, len({sql_lines('content')}) AS n FROM chunks WHERE content IS NOT NULL AND chunk_type <> 'module') SELECT language, min(n)::INT AS least, max(n)::INT AS most, median(n) AS middle FROM n GROUP BY 1")
def q_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = chunk_texts(spark, d, "chunk_id", "language", "chunk_type", "content").where("content IS NOT NULL AND chunk_type <> 'module'").select("chunk_id", "language", T.line_count(F.col("content")).alias("n")).distinct()
    return n.groupBy("language").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", 0.5).alias("middle"))


@query("WITH n AS (SELECT repo_name, coalesce(layer, 'unknown') AS layer, count(*) AS n FROM (SELECT DISTINCT chunk_id, repo_name, layer FROM chunks) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, layer) AS r FROM n) SELECT repo_name, string_agg(layer || ':' || n, ' ' ORDER BY r) AS layers FROM r WHERE r <= 3 GROUP BY 1")
def q_layer_shares(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest layers of each repository."""
    n = chunks_once(spark, d, "chunk_id", "repo_name", "layer").groupBy("repo_name", F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"))
    return L.top_layers(n, ["repo_name"])


@query("WITH n AS (SELECT repo_name, language, count(*) AS n FROM file_flags WHERE language IS NOT NULL GROUP BY 1, 2) SELECT repo_name, lower(arg_max(language, (n, -hash_rank))) AS language FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY language) AS hash_rank FROM n) GROUP BY 1")
def q_primary_language(spark: SparkSession, d: str) -> DataFrame:
    """Each repository's most frequent language; ties go to the first by name."""
    n = table(spark, d, "file_flags").where("language IS NOT NULL").groupBy("repo_name", "language").agg(F.count("*").alias("n"))
    return n.groupBy("repo_name").agg(F.lower(F.min_by("language", F.struct(-F.col("n"), "language"))).alias("language"))


@query(
    f"""WITH {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), seeds AS (SELECT DISTINCT dst AS seed FROM e WHERE substr(dst, 1, 2) = '00'),
    one AS (SELECT DISTINCT seed, src AS node FROM seeds JOIN e ON dst = seed WHERE src <> seed), two AS (SELECT DISTINCT seed, e.src AS node FROM one JOIN e ON e.dst = one.node)
    SELECT seed, node, min(hops) AS hops FROM (SELECT seed, seed AS node, 0 AS hops FROM seeds UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two) GROUP BY 1, 2"""
)
def q_code_dependents(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the chunks whose id begins with 00, within two hops."""
    e = _code_edges(spark, d).select("src", "dst").distinct()
    return G.dependents(e, e.where("substr(dst, 1, 2) = '00'").select(F.col("dst").alias("node")).distinct(), 2)


@query(f"WITH {_CALLS} SELECT count(*) AS calls, 0::BIGINT AS edges FROM resolved WHERE via = 'external'")
def q_external_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls to what is outside of the repositories: they are counted and never become edges."""
    r = resolved(spark, d)
    return r.agg(F.count_if(F.col("via") == "external").alias("calls"), F.count_if((F.col("via") == "external") & F.col("target").isNotNull()).alias("edges"))


@query(
    f"""WITH {_review._GROUPS}, s AS (SELECT l_orderkey AS file, l_linenumber AS a, l_linenumber + 1 AS b, l_partkey AS chunk_id FROM lineitem), j AS (SELECT g.file, g.line, g.end_line, s.chunk_id, row_number() OVER (PARTITION BY g.file, g.line, g.end_line ORDER BY s.a, s.chunk_id) AS r FROM (SELECT DISTINCT file, line, end_line FROM g) g JOIN s ON s.file = g.file AND s.a <= g.end_line AND s.b >= g.line)
    SELECT file, line, end_line, chunk_id FROM j WHERE r = 1"""
)
def q_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk that a group of findings overlaps; an order's lines stand for chunks of two lines."""
    t = table(spark, d, "lineitem")
    c = t.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line"), F.col("l_partkey").alias("chunk_id"))
    return X.overlapping(_review._groups(spark, d).select("file", "line", "end_line").distinct(), c, ["file"])


@query("SELECT doc_id, coalesce(rule_id, 'UNKNOWN') AS rule_id, CASE WHEN upper(trim(coalesce(severity, 'INFO'))) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') THEN upper(trim(coalesce(severity, 'INFO'))) ELSE 'INFO' END AS severity, 0.7::DOUBLE AS confidence, 'general' AS category FROM documents")
def q_finding_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' comments with what they left out."""
    raw = table(spark, d, "documents").select("doc_id", "rule_id", "severity", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("category"))
    return X.with_defaults(raw)
