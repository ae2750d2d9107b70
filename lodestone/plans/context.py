"""Queries of review context, order and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import layers as L
from lodestone.plans import review as _review
from lodestone.plans.chunking import FILE, chunk_texts, chunks_once
from lodestone.plans.code_graph import _EDGES, _code_edges
from lodestone.plans.corpus import sql_lines
from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query(f"SELECT DISTINCT chunk_id, coalesce(regexp_matches(lower(file_path), '{'|'.join(X.SECURITY_PATHS)}'), false) AS sensitive FROM chunks")
def q_security_path(spark: SparkSession, d: str) -> DataFrame:
    return chunk_texts(spark, d, "chunk_id", "file_path").distinct().select("chunk_id", X.security_path(F.col("file_path")).alias("sensitive"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the feed has with two states."""
    f = table(spark, d, "chunk_feed").where("content_hash IS NOT NULL").groupBy("chunk_id").agg(F.min(F.lower("content_hash")).alias("a"), F.max(F.lower("content_hash")).alias("b"))
    return f.where("a <> b").select(F.col("chunk_id").alias("node"))


_CHANGED = "changed AS (SELECT chunk_id FROM chunk_feed WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(content_hash)) > 1)"


@query(
    f"""WITH {_CHANGED}, c AS (SELECT DISTINCT chunk_id, chunk_type, end_line - start_line + 1 AS lines FROM chunks WHERE chunk_type IN ('function', 'method', 'class', 'block') AND end_line - start_line + 1 >= 3)
    SELECT chunk_id, CASE WHEN chunk_type IN ('function', 'method') AND chunk_id IN (SELECT chunk_id FROM changed) THEN 1 WHEN chunk_type = 'block' THEN 3 ELSE 2 END AS tier, lines FROM c"""
)
def q_review_priority(spark: SparkSession, d: str) -> DataFrame:
    return X.review_order(chunks_once(spark, d, "chunk_id", "chunk_type", "start_line", "end_line"), _changed(spark, d))


_RISK = f"""{_EDGES}, {_CHANGED}, u AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), radius AS (SELECT src AS chunk_id, count(*) AS radius FROM u GROUP BY 1),
  coupled AS (SELECT src AS chunk_id FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY 1 HAVING count(*) >= 3), ids AS (SELECT DISTINCT chunk_id, file_path FROM chunks),
  risk AS (SELECT ids.chunk_id, coalesce(radius, 0) AS blast_radius, ids.chunk_id NOT IN (SELECT dst FROM edges) AS is_orphan, ids.chunk_id IN (SELECT chunk_id FROM coupled) AS is_high_coupling,
    coalesce(regexp_matches(lower(file_path), '{'|'.join(X.SECURITY_PATHS)}'), false) AS is_security_path, ids.chunk_id IN (SELECT chunk_id FROM changed) AS is_changed FROM ids LEFT JOIN radius USING (chunk_id))"""


def _risk(spark: SparkSession, d: str) -> DataFrame:
    edges, ids = _code_edges(spark, d), chunk_texts(spark, d, "chunk_id", "file_path").distinct()
    nodes = ids.select(F.col("chunk_id").alias("node"))
    return X.risk_signals(ids, G.blast_radius(edges), G.orphans(nodes, edges), G.high_coupling(edges, 3), nodes.limit(0), _changed(spark, d))


@query(f"WITH {_RISK} SELECT chunk_id, blast_radius, is_orphan, is_high_coupling, is_security_path, is_changed FROM risk")
def q_risk_signals(spark: SparkSession, d: str) -> DataFrame:
    return _risk(spark, d).drop("is_pre_flagged")


@query()
def q_rule_routing(spark: SparkSession, d: str) -> DataFrame:
    layer = L.labels(F.col("file_path"))[0]
    r = _risk(spark, d).join(chunk_texts(spark, d, "chunk_id", "file_path").distinct(), "chunk_id")
    return r.select("chunk_id", F.array_join(X.categories(layer, F.col("blast_radius"), F.col("is_high_coupling"), F.col("is_changed")), ",").alias("categories"))


@query(f"WITH {_EDGES}, e AS (SELECT src, dst, max(confidence) AS confidence FROM edges WHERE src <> dst GROUP BY 1, 2) SELECT src, dst, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS place FROM e) WHERE place <= 3")
def q_top_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return X.top_dependencies(_code_edges(spark, d))


@query(
    f"""WITH {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src AS node, count(*) AS n_out, string_agg(dst, ',' ORDER BY dst) AS outgoing FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in, string_agg(src, ',' ORDER BY src) AS incoming FROM e GROUP BY 1)
    SELECT node, n_out, outgoing, n_in, incoming FROM o FULL JOIN i USING (node)"""
)
def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return X.neighbour_lists(_code_edges(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("outgoing", "incoming")})


@query(
    """WITH s AS (SELECT DISTINCT repo_name, file_path, chunk_id, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND chunk_type IN ('class', 'class_head', 'method', 'function', 'block')),
    j AS (SELECT a.chunk_id, b.chunk_id AS o, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.end_line - b.start_line, b.chunk_id) AS r FROM s a JOIN s b ON a.repo_name = b.repo_name AND a.file_path = b.file_path AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND b.end_line - b.start_line > a.end_line - a.start_line)
    SELECT s.chunk_id, j.o AS outer_id FROM s LEFT JOIN j ON j.chunk_id = s.chunk_id AND r = 1"""
)
def q_enclosing(spark: SparkSession, d: str) -> DataFrame:
    s = chunks_once(spark, d, *FILE, "chunk_id", "chunk_type", "start_line", "end_line").where("start_line IS NOT NULL AND end_line IS NOT NULL AND chunk_type IN ('class', 'class_head', 'method', 'function', 'block')").drop("chunk_type")
    return X.enclosing(s, FILE).withColumnRenamed("outer", "outer_id")


@query()
def q_large_split(spark: SparkSession, d: str) -> DataFrame:
    ls = T.lines(F.col("content"))
    blank = F.filter(F.transform("ls", lambda x, i: F.when(F.trim(x) == "", i + F.col("start_line"))), lambda i: i.isNotNull())
    c = chunk_texts(spark, d, "chunk_id", "chunk_type", "start_line", "content").where("content IS NOT NULL AND start_line IS NOT NULL AND chunk_type IN ('function', 'method', 'class', 'block')").withColumn("ls", ls).where(F.size("ls") > 150)
    s = c.select("chunk_id", "start_line", (F.col("start_line") + F.size("ls") - 1).alias("end_line"), blank.alias("lines")).dropDuplicates(["chunk_id"])
    return X.long_parts(s.drop("lines"), s.select("chunk_id", "lines"))


_GROUPS = _review._GROUPS


@query(
    f"""WITH {_GROUPS}, p AS (SELECT file, is_pre_flagged, group_no, line, end_line, severity, '[' || severity || '] ' || issues || ' findings' AS head FROM g)
    SELECT file, is_pre_flagged, group_no, '**' || head || '**' AS body FROM p"""
)
def q_rendered(spark: SparkSession, d: str) -> DataFrame:
    g = _review._groups(spark, d).select("file", "is_pre_flagged", "group_no", "severity", F.concat(F.col("issues").cast("string"), F.lit(" findings")).alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("suggestion"))
    return X.rendered(g).select("file", "is_pre_flagged", "group_no", "body")


@query(
    f"""WITH {_GROUPS}, d AS (SELECT file, idx, arg_max(keep, seq) AS keep FROM (SELECT l_orderkey AS file, l_linenumber AS idx, l_returnflag <> 'R' AS keep, l_partkey * 1000 + l_suppkey AS seq FROM lineitem) GROUP BY 1, 2),
    i AS (SELECT file, start_line AS idx, severity, seq, seq2, seq3, count(*) OVER (PARTITION BY file) >= 2 OR max(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END) OVER (PARTITION BY file) > 0 AS gate FROM issues)
    SELECT i.file, i.severity, count(*) AS n FROM i LEFT JOIN d USING (file, idx) WHERE NOT gate OR coalesce(d.keep, true) GROUP BY 1, 2"""
)
def q_reflected(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    decisions = t.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") != "R").alias("keep"), F.lit(None).cast("string").alias("severity"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    i = _review.issues(spark, d).select("file", F.col("start_line").alias("idx"), "severity")
    return X.reflected(i, decisions).groupBy("file", "severity").agg(F.count("*").alias("n"))


@query()
def q_context(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d, "chunk_id", *FILE, "chunk_type", "symbol_name", "parent_symbol", "start_line", "content").where("chunk_type IN ('function', 'method', 'class', 'class_head')")
    return X.context(c, C.parents(c, FILE), X.top_dependencies(_code_edges(spark, d))).select("chunk_id", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query(f"SELECT DISTINCT chunk_id, md5('# ' || concat_ws(' ', language, symbol_name, 'in', file_path) || chr(10) || CASE WHEN len({sql_lines('content')}) > 60 THEN array_to_string(list_slice({sql_lines('content')}, 1, 60), chr(10)) || chr(10) || '... (' || len({sql_lines('content')}) || ' lines total)' ELSE array_to_string({sql_lines('content')}, chr(10)) END) AS digest FROM chunks WHERE content IS NOT NULL")
def q_embed_text(spark: SparkSession, d: str) -> DataFrame:
    text = X.embed_text(F.col("language"), F.col("file_path"), F.col("symbol_name"), F.col("content"))
    return chunk_texts(spark, d, "chunk_id", "language", "file_path", "symbol_name", "content").where("content IS NOT NULL").select("chunk_id", F.md5(text).alias("digest")).distinct()
