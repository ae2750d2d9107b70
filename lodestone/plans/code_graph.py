"""Queries of symbols, resolution, layers and the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import layers as L
from lodestone.operators import symbols as S
from lodestone.plans.chunking import chunk_texts, chunks_once
from lodestone.plans.registry import query
from lodestone.session import cut
from lodestone.sources.tables import table

_CHUNKS = "c AS (SELECT DISTINCT chunk_id, repo_name, file_path, chunk_type, symbol_name, parent_symbol AS parent, start_line, content FROM chunks)"
_BARE = "regexp_extract(symbol_name, '([^.:#/]+)$', 1)"
_SYMBOLS = f"{_CHUNKS}, s AS (SELECT repo_name, file_path, {_BARE} AS name, parent, chunk_type AS kind, chunk_id, start_line FROM c WHERE chunk_type IN ('function', 'method', 'class', 'class_head', 'constant') AND symbol_name IS NOT NULL)"
_NO = ", ".join(f"'{x}'" for x in S.NO_CALLS)


def _first(keys: str, alias: str, where: str = "true", source: str = "s") -> str:
    return f"{alias} AS (SELECT {keys}, chunk_id AS {alias}_id FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY file_path, start_line NULLS FIRST, chunk_id) AS r FROM {source} WHERE {where}) WHERE r = 1)"


_CALLS = f"""{_SYMBOLS}, k AS (SELECT chunk_id, repo_name, file_path, parent, {_BARE} AS own, unnest(list_distinct(regexp_extract_all(content, '([A-Za-z_][\\w.]*)\\s*\\(', 1))) AS callee FROM c WHERE chunk_type IN ('function', 'method') AND content IS NOT NULL),
  k2 AS (SELECT *, regexp_replace(regexp_replace(callee, '{S.RECEIVERS}', ''), '^super\\.', '') AS name FROM k WHERE callee NOT IN ({_NO}) AND callee IS DISTINCT FROM own),
  sq AS (SELECT * FROM s UNION ALL SELECT repo_name, file_path, parent || '.' || name, parent, kind, chunk_id, start_line FROM s WHERE parent IS NOT NULL),
  {_first("repo_name, file_path, parent, name", "a", "parent IS NOT NULL")}, {_first("repo_name, file_path, name", "f", source="sq")}, {_first("repo_name, name", "n")},
  resolved AS (SELECT k2.chunk_id, k2.callee, coalesce(a_id, f_id, n_id) AS target, CASE WHEN a_id IS NOT NULL OR f_id IS NOT NULL THEN 1.0::DOUBLE WHEN n_id IS NOT NULL THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
     CASE WHEN a_id IS NOT NULL THEN 'class' WHEN f_id IS NOT NULL THEN 'file' WHEN n_id IS NOT NULL THEN 'name' ELSE 'external' END AS via
     FROM k2 LEFT JOIN a USING (repo_name, file_path, parent, name) LEFT JOIN f USING (repo_name, file_path, name) LEFT JOIN n USING (repo_name, name))"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(chunks_once(spark, d, "chunk_id", "repo_name", "file_path", "chunk_type", "symbol_name", "parent_symbol", "start_line"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_texts(spark, d, "chunk_id", "repo_name", "file_path", "chunk_type", "symbol_name", "parent_symbol", "content")
    return S.resolve_calls(S.calls(c).distinct(), symbols(spark, d))


@query(f"WITH {_SYMBOLS}, {_first('repo_name, file_path, name', 'f')} SELECT repo_name, file_path, name, f_id AS chunk_id FROM f")
def q_symbol_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return S.first_by(symbols(spark, d), "repo_name", "file_path", "name").select("repo_name", "file_path", "name", F.col("hit.chunk_id").alias("chunk_id"))


@query(f"WITH {_CALLS} SELECT chunk_id, callee, target, confidence, via FROM resolved")
def q_resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("chunk_id", "callee", "target", "confidence", "via")


@query(f"WITH {_CALLS} SELECT via, count(*) AS calls, count(DISTINCT target) AS targets, round(avg(confidence), 9) AS confidence FROM resolved GROUP BY 1")
def q_resolution_rates(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).groupBy("via").agg(F.count("*").alias("calls"), F.count_distinct("target").alias("targets"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query(
    f"""WITH {_SYMBOLS}, h AS (SELECT chunk_id, repo_name, array_to_string(list_slice(regexp_split_to_array(content, '\\r\\n|\\n|\\r'), 1, 3), ' ') AS t FROM c WHERE chunk_type IN ('class', 'class_head') AND content IS NOT NULL),
    b AS (SELECT chunk_id, repo_name, unnest(regexp_split_to_array(coalesce(nullif(regexp_extract(t, 'class\\s+\\w+\\s*\\(([^)]*)\\)', 1), ''), nullif(regexp_extract(t, '(?:extends|implements|class\\s+\\w+[^:{{]*:)\\s+([^{{]*)', 1), ''), ''), '\\s*(?:,|\\bimplements\\b|\\bwith\\b)\\s*')) AS raw FROM h),
    b2 AS (SELECT DISTINCT chunk_id, repo_name, trim(regexp_extract(raw, '^([^<\\[]*)', 1)) AS name FROM b), {_first("repo_name, name", "n", "kind IN ('class', 'class_head')")}
    SELECT b2.chunk_id, name AS base, n_id AS target FROM b2 JOIN n USING (repo_name, name) WHERE name <> ''"""
)
def q_resolve_bases(spark: SparkSession, d: str) -> DataFrame:
    return S.resolve_bases(chunk_texts(spark, d, "chunk_id", "repo_name", "chunk_type", "content"), symbols(spark, d))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_texts(spark, d, "chunk_id", "repo_name", "file_path", "chunk_type", "content").where("chunk_type = 'import' AND content IS NOT NULL")
    module = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*(?:from|import)\s+([\w./]+)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"from\s+[\"']([^\"']+)[\"']", 1), F.lit("")))
    lines = c.select("chunk_id", "repo_name", "file_path", F.explode(F.split("content", r"\r\n|\n|\r")).alias("line"))
    return lines.select("chunk_id", "repo_name", "file_path", module.alias("module")).where("module IS NOT NULL").distinct()


_ENDS = ", ".join(f"{x} || '{e}'" for x in ("rel", "slashed", "('src/' || slashed)") for e in S.MODULE_ENDS)


@query(
    f"""WITH {_CHUNKS}, l AS (SELECT chunk_id, repo_name, file_path, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS line FROM c WHERE chunk_type = 'import' AND content IS NOT NULL),
    i AS (SELECT DISTINCT chunk_id, repo_name, file_path, coalesce(nullif(regexp_extract(line, '^\\s*(?:from|import)\\s+([\\w./]+)', 1), ''), nullif(regexp_extract(line, 'from\\s+["'']([^"'']+)["'']', 1), '')) AS module FROM l),
    p AS (SELECT *, regexp_replace(file_path, '[^/]*$', '') || regexp_replace(module, '^\\./', '') AS rel, CASE WHEN contains(module, '/') THEN module ELSE replace(module, '.', '/') END AS slashed FROM i WHERE module IS NOT NULL),
    t AS (SELECT chunk_id, repo_name, module, unnest([module, {_ENDS}]) AS path, generate_subscripts([module, {_ENDS}], 1) AS rank FROM p),
    m AS (SELECT chunk_id, module, arg_min(path, rank) AS target FROM t JOIN (SELECT DISTINCT repo_name, path FROM repo_file) USING (repo_name, path) GROUP BY 1, 2)
    SELECT DISTINCT p.chunk_id, p.module, m.target FROM p LEFT JOIN m USING (chunk_id, module)"""
)
def q_resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return S.resolve_imports(_imports(spark, d), table(spark, d, "repo_file"))


def _code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls inside the repositories, and methods to their classes."""
    r = resolved(spark, d).where("target IS NOT NULL AND target <> chunk_id")
    called = r.select(F.col("chunk_id").alias("src"), F.col("target").alias("dst"), F.lit("CALLS").alias("kind"), "confidence", S.cross_domain(F.col("file_path"), F.col("target_file")).alias("cross_domain"))
    from lodestone.operators.chunking import parents

    c = chunks_once(spark, d, "chunk_id", "repo_name", "file_path", "chunk_type", "symbol_name", "parent_symbol", "start_line")
    owned = parents(c, ["repo_name", "file_path"]).where("parent_id IS NOT NULL").select(F.col("chunk_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("BELONGS_TO").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("cross_domain"))
    return called.unionByName(owned)


_EDGES = f"""{_CALLS}, heads AS (SELECT repo_name, file_path, symbol_name, chunk_id, row_number() OVER (PARTITION BY repo_name, file_path, symbol_name ORDER BY start_line, chunk_id) AS r FROM c WHERE chunk_type = 'class_head'),
  edges AS (SELECT chunk_id AS src, target AS dst, 'CALLS' AS kind, confidence FROM resolved WHERE target IS NOT NULL AND target <> chunk_id
  UNION ALL SELECT m.chunk_id, h.chunk_id, 'BELONGS_TO', 1.0::DOUBLE FROM c m JOIN heads h ON h.r = 1 AND h.repo_name = m.repo_name AND h.file_path = m.file_path AND h.symbol_name = m.parent WHERE m.chunk_type = 'method')"""


@query(f"WITH {_EDGES} SELECT kind, count(*) AS n, count(DISTINCT (src, dst)) AS pairs FROM edges GROUP BY 1")
def q_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return _code_edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("pairs"))


@query(f"WITH {_EDGES} SELECT DISTINCT chunk_id AS node FROM c WHERE chunk_type NOT IN ('module', 'import') AND NOT (starts_with(coalesce(symbol_name, ''), '__') AND ends_with(coalesce(symbol_name, ''), '__')) AND chunk_id NOT IN (SELECT dst FROM edges)")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce("symbol_name", F.lit(""))
    nodes = chunks_once(spark, d, "chunk_id", "chunk_type", "symbol_name").where(~F.col("chunk_type").isin("module", "import") & ~(name.startswith("__") & name.endswith("__")))
    return G.orphans(nodes.select(F.col("chunk_id").alias("node")).distinct(), _code_edges(spark, d))


#: Trade between nations stands for edges that come many times: one from the customer's nation to the supplier's for every line sold.
_TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS kind, l_orderkey AS o, l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))




@query(f"WITH {_TRADE} SELECT src, dst, kind, o, l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY o, l) AS r FROM trade) WHERE r = 1")
def q_edges_dedup(spark: SparkSession, d: str) -> DataFrame:
    return G.first_edges(trade(spark, d), ["o", "l"])


@query(f"WITH {_TRADE} SELECT src, dst, kind, o, l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o DESC, l DESC, kind DESC) AS r FROM trade) WHERE r = 1")
def q_digraph_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return G.digraph(trade(spark, d), ["o", "l", "kind"])


def _layer_sql() -> str:
    suffix = lambda table, stem: "CASE " + " ".join(f"WHEN ends_with({stem}, '{s}') THEN '{k}'" for s, k in sorted(((s, k) for k, v in table.items() for s in v), key=lambda t: (-len(t[0]), t[0]))) + " END"
    tells = ", ".join(f"CASE WHEN list_has_any(folders, [{', '.join(repr(x) for x in L.FOLDERS[k])}]) OR coalesce(camel = '{k}', false) OR coalesce(snake = '{k}', false) THEN '{k}' END" for k in L.LAYERS)
    return f"""f AS (SELECT file_id, list_transform(string_split(path, '/'), lambda p: regexp_replace(lower(p), '\\.[^.]*$', '')) AS folders, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM repo_file),
      g AS (SELECT *, {suffix(L.SUFFIXES, 'stem')} AS camel, {suffix(L.SNAKE_SUFFIXES, 'lower(stem)')} AS snake FROM f),
      labelled AS (SELECT file_id, list_filter([{tells}], lambda x: x IS NOT NULL) AS found FROM g)"""


@query(f"WITH {_layer_sql()} SELECT file_id, CASE WHEN len(found) = 0 THEN 'unknown' ELSE array_to_string(found, ',') END AS labels, CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS layer FROM labelled")
def q_layers(spark: SparkSession, d: str) -> DataFrame:
    found = L.labels(F.col("path"))
    return table(spark, d, "repo_file").select("file_id", F.array_join(found, ",").alias("labels"), found[0].alias("layer"))


_PAIRS = f"{_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges)"


def _code_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of the code's graph."""
    return _code_edges(spark, d).select("src", "dst").distinct()


@query(f"WITH {_PAIRS} SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def q_code_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_code_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1 HAVING count(*) >= 10")
def q_code_high_coupling(spark: SparkSession, d: str) -> DataFrame:
    return G.high_coupling(_code_pairs(spark, d))


@query(f"WITH {_PAIRS}, v AS (SELECT count(DISTINCT chunk_id)::DOUBLE AS nodes FROM chunks) SELECT (SELECT nodes::BIGINT FROM v) AS nodes, count(*) AS edges, round(count(*) / ((SELECT nodes FROM v) * ((SELECT nodes FROM v) - 1)), 9) AS density FROM e")
def q_code_density(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(chunks_once(spark, d, "chunk_id").select(F.col("chunk_id").alias("node")), _code_pairs(spark, d))


@query(
    f"""WITH {_PAIRS} SELECT src AS cycle, 1 AS length FROM e WHERE src = dst UNION ALL
    SELECT a.src || '>' || a.dst, 2 FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL
    SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND b.dst > a.src AND b.dst <> a.dst"""
)
def q_code_cycles3(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles(cut(_code_pairs(spark, d)), 3)


@query(
    f"""WITH RECURSIVE {_PAIRS}, walk AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hops FROM e UNION SELECT w.seed, e.dst, w.hops + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hops < 3)
    SELECT seed, node, min(hops) AS hops FROM walk GROUP BY 1, 2"""
)
def q_code_reach_k(spark: SparkSession, d: str) -> DataFrame:
    e = cut(_code_pairs(spark, d))
    return G.reach(e, e.select(F.col("src").alias("node")).distinct(), 3)


@query(f"WITH {_PAIRS}, u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst) SELECT src AS node, count(*) AS radius FROM u GROUP BY 1")
def q_code_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return G.blast_radius(_code_pairs(spark, d))


_LABELLED = _layer_sql().replace("FROM repo_file", "FROM (SELECT DISTINCT file_path AS file_id, file_path AS path FROM chunks)")


@query(
    f"""WITH {_EDGES}, lab AS (WITH {_LABELLED} SELECT file_id AS file_path, CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS layer, greatest(1, len(found)) AS labels FROM labelled),
    v AS (SELECT chunk_id AS node, layer, labels, string_split(file_path, '/') AS p FROM (SELECT DISTINCT chunk_id, file_path FROM chunks) JOIN lab USING (file_path))
    SELECT DISTINCT src, dst, x.layer AS src_layer, y.layer AS dst_layer FROM edges JOIN v x ON x.node = src JOIN v y ON y.node = dst WHERE kind = 'CALLS' AND x.labels <= 1 AND y.labels <= 1
      AND ((x.layer = 'presentation' AND y.layer = 'data') OR (x.layer = 'data' AND y.layer = 'presentation') OR (x.layer = 'unknown' AND y.layer = 'unknown' AND len(x.p) >= 2 AND len(y.p) >= 2 AND x.p[1] <> y.p[1]))"""
)
def q_code_layer_violations(spark: SparkSession, d: str) -> DataFrame:
    found = L.labels(F.col("file_path"))
    nodes = chunk_texts(spark, d, "chunk_id", "file_path").distinct().select(F.col("chunk_id").alias("node"), found[0].alias("layer"), F.size(found).alias("labels"))
    edges = _code_edges(spark, d).select("src", "dst", "kind", "cross_domain").distinct()
    return G.layer_violations(edges, nodes)


@query("SELECT DISTINCT a.file_path AS path_a, b.file_path AS path_b, len(string_split(a.file_path, '/')) >= 2 AND len(string_split(b.file_path, '/')) >= 2 AND string_split(a.file_path, '/')[1] <> string_split(b.file_path, '/')[1] AS cross_domain FROM chunks a JOIN chunks b ON a.next_chunk_id = b.chunk_id")
def q_cross_domain(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    a, b = c.select(F.col("file_path").alias("path_a"), F.col("next_chunk_id").alias("k")).distinct(), c.select(F.col("file_path").alias("path_b"), F.col("chunk_id").alias("k")).distinct()
    return a.join(b, "k").select("path_a", "path_b", S.cross_domain(F.col("path_a"), F.col("path_b")).alias("cross_domain")).distinct()
