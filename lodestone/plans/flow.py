"""Queries of the review's flow and of its comments and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import context as X
from lodestone.operators import flow as W
from lodestone.operators import graph as G
from lodestone.operators import reporting as O
from lodestone.operators import review as V
from lodestone.operators import standards
from lodestone.plans import review as _review
from lodestone.plans import rules as _rules
from lodestone.plans.chunking import chunk_texts, chunks_once
from lodestone.plans.code_graph import _EDGES, _code_edges
from lodestone.plans.context import _CHANGED, _changed
from lodestone.plans.quality import EXAMPLE
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_LONG = f"long AS (SELECT chunk_id, start_line AS line FROM c WHERE {_rules._FN} AND len(list_filter(ls, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|//)'))) > 50)"
_META = "meta AS (SELECT DISTINCT chunk_id, repo_name || '/' || file_path AS file_path, language, layer FROM chunks)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, file_path (within its repository), language, layer, symbol_name and lines of each chunk."""
    c = chunks_once(spark, d, "chunk_id", "repo_name", "file_path", "language", "layer", "symbol_name", "start_line", "end_line")
    return c.withColumn("file_path", F.concat("repo_name", F.lit("/"), "file_path"))


def _standards(spark: SparkSession) -> DataFrame:
    return standards.rules(spark.createDataFrame([("example.md", EXAMPLE)], "name string, text string"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return W.preflagged(_rules._of(spark, d, "GEN001"), _places(spark, d).select("chunk_id", "file_path", "language", "layer").distinct(), _standards(spark))


@query(
    f"""WITH {_rules._SQL}, {_LONG}, {_META} SELECT chunk_id, 'GEN001' AS rule_id, 'MEDIUM' AS severity, 'Short functions' AS title, file_path, line::INT AS start_line, 'See rule GEN001 in standards/' || coalesce(language, 'unknown') || '.md for the required fix.' AS suggestion, 'general' AS category, layer
    FROM long JOIN meta USING (chunk_id)"""
)
def q_preflagged(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("chunk_id", "rule_id", "severity", "title", "file_path", "start_line", "suggestion", "category", "layer")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return W.radius_notes(_places(spark, d).distinct(), G.blast_radius(_code_edges(spark, d)), 5)


_RADIUS = f"""{_EDGES}, pairs AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), radius AS (SELECT src AS chunk_id, count(*) AS radius FROM pairs GROUP BY 1 HAVING count(*) >= 5),
  places AS (SELECT DISTINCT chunk_id, repo_name || '/' || file_path AS file_path, language, layer, symbol_name, start_line, end_line FROM chunks),
  notes AS (SELECT chunk_id, 'ARCH005' AS rule_id, 'INFO' AS severity, coalesce(symbol_name, '') || ' has ' || radius || ' direct callers and callees, at or above the threshold (5).' AS description, file_path, start_line, end_line FROM radius JOIN places USING (chunk_id))"""


@query(f"WITH {_RADIUS} SELECT * FROM notes")
def q_radius_notes(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("chunk_id", "rule_id", "severity", "description", "file_path", "start_line", "end_line")


_RULES_C = _rules._SQL.replace("c AS (", "rc AS (", 1).replace("FROM c)", "FROM rc)")
_LONG_RC = _LONG.replace("FROM c ", "FROM rc ")


@query(
    f"""WITH {_RADIUS}, {_RULES_C}, {_LONG_RC}, {_META}, every AS (SELECT file_path, line::INT AS start_line, 'GEN001' AS rule_id, chunk_id, 'MEDIUM' AS severity, 'Short functions' AS title, true AS pre FROM long JOIN meta USING (chunk_id) UNION ALL SELECT file_path, start_line, rule_id, chunk_id, severity, 'Wide blast radius, reviewed at reduced depth', false FROM notes),
    best AS (SELECT *, row_number() OVER (PARTITION BY file_path, start_line, rule_id ORDER BY pre DESC, chunk_id, title) AS r FROM every)
    SELECT file_path, start_line, rule_id, severity, 1.0::DOUBLE AS confidence, '' AS corroborated_by FROM best WHERE r = 1"""
)
def q_review_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rules' findings and notes on the graph, as one de-duplicated list in order of severity."""
    issues = W.deduplicated(W.together(_flagged(spark, d), _notes(spark, d)))
    return W.ordered(issues).select("file_path", "start_line", "rule_id", "severity", "confidence", "corroborated_by")


@query(
    f"""WITH {_CHANGED}, c AS (SELECT DISTINCT chunk_id, chunk_type, end_line - start_line + 1 AS lines FROM chunks WHERE chunk_type IN ('function', 'method', 'class', 'block') AND end_line - start_line + 1 >= 3),
    o AS (SELECT chunk_id, CASE WHEN chunk_type IN ('function', 'method') AND chunk_id IN (SELECT chunk_id FROM changed) THEN 1 WHEN chunk_type = 'block' THEN 3 ELSE 2 END AS tier, lines FROM c)
    SELECT chunk_id, row_number() OVER (ORDER BY tier, lines DESC, chunk_id)::INT AS place FROM o QUALIFY place <= 300"""
)
def q_review_queue(spark: SparkSession, d: str) -> DataFrame:
    return W.queue(X.review_order(chunks_once(spark, d, "chunk_id", "chunk_type", "start_line", "end_line"), _changed(spark, d)))


@query(
    f"""WITH {_CHANGED}, c AS (SELECT DISTINCT chunk_id, chunk_type, end_line - start_line + 1 AS lines FROM chunks WHERE chunk_type IN ('function', 'method', 'class', 'block') AND end_line - start_line + 1 >= 3),
    o AS (SELECT chunk_id, CASE WHEN chunk_type IN ('function', 'method') AND chunk_id IN (SELECT chunk_id FROM changed) THEN 1 WHEN chunk_type = 'block' THEN 3 ELSE 2 END AS tier, lines FROM c)
    SELECT chunk_id, row_number() OVER (ORDER BY tier, lines DESC, chunk_id)::INT AS place FROM o"""
)
def q_review_places(spark: SparkSession, d: str) -> DataFrame:
    """The whole order of review, without a cap."""
    return W.queue(X.review_order(chunks_once(spark, d, "chunk_id", "chunk_type", "start_line", "end_line"), _changed(spark, d)), 0)


@query(f"WITH {_rules._SQL}, {_LONG} SELECT DISTINCT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM long) OR coalesce(regexp_matches(lower(file_path), '{'|'.join(X.SECURITY_PATHS)}'), false) THEN 'full' ELSE 'fast' END AS depth FROM chunks")
def q_review_depth(spark: SparkSession, d: str) -> DataFrame:
    hit = _rules._of(spark, d, "GEN001").select("chunk_id", F.lit(True).alias("hit")).distinct()
    return chunk_texts(spark, d, "chunk_id", "file_path").distinct().join(hit, "chunk_id", "left").select("chunk_id", W.depth(F.col("hit"), F.col("file_path")).alias("depth")).distinct()


@query("SELECT f.l_orderkey AS bundle_id, f.l_linenumber AS finding, b.l_partkey AS chunk_id FROM lineitem f JOIN lineitem b ON b.l_orderkey = f.l_orderkey AND b.l_linenumber - 1 = f.l_quantity::INT % 9 - 1")
def q_attributed(spark: SparkSession, d: str) -> DataFrame:
    """Findings on bundles; orders stand for bundles, their lines for chunks, and an index made of the quantity often misses."""
    t = table(spark, d, "lineitem")
    findings = t.select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").alias("finding"), (F.round("l_quantity").cast("int") % 9 - 1).alias("chunk_index"))
    bundles = t.select(F.col("l_orderkey").alias("bundle_id"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_partkey").alias("chunk_id"))
    return W.attributed(findings, bundles).select("bundle_id", "finding", "chunk_id")


@query("SELECT event_id, CASE WHEN s IN (400, 401, 403) OR a >= 3 THEN NULL WHEN s = 429 THEN coalesce(TRY_CAST(w AS DOUBLE) + 0.5, 15.0) ELSE pow(2.0, a) END AS delay FROM (SELECT event_id, [200, 400, 401, 403, 429, 500, 503][event_id % 7 + 1] AS s, event_id % 5 AS a, CASE event_id % 3 WHEN 0 THEN '3' WHEN 1 THEN 'soon' END AS w FROM events)")
def q_retry_delays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 429, 500, 503))), (F.col("event_id") % 7 + 1).cast("int")).alias("s"), F.when(F.col("event_id") % 3 == 0, "3").when(F.col("event_id") % 3 == 1, "soon").alias("w"))
    return e.select("event_id", W.retry_delay(F.col("s"), F.col("w"), F.col("event_id") % 5).alias("delay"))


@query()
def q_architecture_notes(spark: SparkSession, d: str) -> DataFrame:
    edges = _code_edges(spark, d)
    c = _places(spark, d).select("chunk_id", "file_path", "layer").distinct()
    layers = c.groupBy(F.col("chunk_id").alias("node")).agg(F.coalesce(F.min("layer"), F.lit("unknown")).alias("layer"), F.lit(1).alias("labels"))
    wrong = G.layer_violations(edges, layers).join(c.select(F.col("chunk_id").alias("src"), "file_path"), "src").select("file_path", F.concat_ws(" > ", "src_layer", "dst_layer").alias("detail")).distinct()
    cycles = G.cycles(edges, 2).withColumn("members", F.split("cycle", ">"))
    nodes = c.select(F.col("chunk_id").alias("node")).distinct()
    return W.architecture_notes(c, wrong, cycles, G.orphans(nodes, edges), G.high_coupling(edges))


@query()
def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of what a reviewer of each function and class is asked."""
    c = chunk_texts(spark, d, "chunk_id", "file_path", "language", "chunk_type", "symbol_name", "content").where("chunk_type IN ('function', 'method', 'class')").dropDuplicates(["chunk_id"])
    deps = X.top_dependencies(_code_edges(spark, d)).groupBy(F.col("src").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), "\n").alias("text"))
    languages = c.where("language IS NOT NULL").select("language").distinct()
    blocks = standards.blocks(standards.for_languages(_standards(spark), languages))
    p = W.prompts(c, deps, blocks, _rules._of(spark, d, "GEN001"))
    return p.select("chunk_id", F.length("prompt").alias("size"), F.md5("prompt").alias("digest"))


# ---- comments and reports: orders stand for areas of a file, their lines for findings

_ITEM = """f AS (SELECT file, start_line, rule_id, severity, 'Rule ' || rule_id AS title, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'seen ' || seq2 || ' times' || chr(10) || 'and again' ELSE 'seen once' END AS description, CASE WHEN seq % 2 = 0 THEN 'use ' || seq ELSE '' END AS suggestion FROM issues)"""
_SIGN = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.SIGNS.items()) + " ELSE '' END"
_COLOUR = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.COLOURS.items()) + " ELSE 'gray' END"
_ORDER = f"ORDER BY {_review._RANK}, start_line, rule_id"
_ALL = f"{_ORDER}, title, description, suggestion"
_WORST = f"arg_min(severity, {_review._RANK})"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    said = F.when(s % 3 == 0, "").when(s % 3 == 1, F.concat(F.lit("seen "), F.col("seq2").cast("string"), F.lit(" times\nand again"))).otherwise("seen once")
    i = _review.issues(spark, d).withColumns({"title": F.concat(F.lit("Rule "), "rule_id"), "description": said, "suggestion": F.when(s % 2 == 0, F.concat(F.lit("use "), s.cast("string"))).otherwise("")})
    return i.withColumns({"file_path": F.col("file").cast("string"), "category": F.substring("rule_id", 1, 1)})


def _comments(spark: SparkSession, d: str, platform: str) -> DataFrame:
    return O.rendered(O.with_issues(_findings(spark, d), ["file"]), platform, "review").select("file", F.md5("body").alias("digest"))


_CALLOUT = "CASE worst " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.CALLOUTS.items()) + " ELSE 'NOTE' END"


@query(
    f"""WITH {_review._SQL}, {_ITEM}, g AS (SELECT file, count(*) AS n, {_WORST} AS worst, string_agg(rule_id, ', ' {_ALL}) AS rules,
      string_agg('> ' || {_SIGN} || ' **' || title || '** `' || rule_id || '` · ' || severity || CASE WHEN description <> '' THEN chr(10) || '> ' || replace(description, chr(10), chr(10) || '> ') ELSE '' END || CASE WHEN suggestion <> '' THEN chr(10) || '>' || chr(10) || '> **Suggestion:** ' || suggestion ELSE '' END, chr(10) {_ALL}) AS one,
      string_agg('>' || chr(10) || '> ' || {_SIGN} || ' **' || title || '** `' || rule_id || '` · line ' || start_line || ' · ' || severity || CASE WHEN description <> '' THEN chr(10) || '>   ' || split_part(description, chr(10), 1) ELSE '' END || CASE WHEN suggestion <> '' THEN chr(10) || '>   _Fix:_ ' || suggestion ELSE '' END, chr(10) {_ALL}) AS many FROM f GROUP BY 1)
    SELECT file, md5('> [!' || {_CALLOUT} || ']' || chr(10) || CASE WHEN n = 1 THEN one ELSE '> **' || n || ' issues** in this area (dominant: ' || worst || ')' || chr(10) || many END || chr(10) || chr(10) || '<sub>review · ' || rules || '</sub>') AS digest FROM g"""
)
def q_rendered_github(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d, "github")


@query(
    f"""WITH {_review._SQL}, {_ITEM} SELECT file, md5(string_agg('**' || {_SIGN} || ' ' || title || '** (`' || rule_id || '`) — *' || severity || '* at line ' || start_line || CASE WHEN description <> '' THEN chr(10) || chr(10) || description ELSE '' END || CASE WHEN suggestion <> '' THEN chr(10) || chr(10) || '**Suggestion:** ' || suggestion ELSE '' END || chr(10) || chr(10) || '---', chr(10) {_ALL})
      || chr(10) || chr(10) || '_review · ' || string_agg(rule_id, ', ' {_ALL}) || '_') AS digest FROM f GROUP BY 1"""
)
def q_rendered_gitlab(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d, "gitlab")


@query(
    f"""WITH {_review._SQL}, {_ITEM} SELECT file, md5(string_agg('h4. {{' || {_COLOUR} || '|' || severity || '}} ' || title || ' (' || rule_id || ') — line ' || start_line || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END || CASE WHEN suggestion <> '' THEN chr(10) || '*Suggestion:* ' || suggestion ELSE '' END || chr(10), chr(10) {_ALL})
      || chr(10) || '_review · ' || string_agg(rule_id, ', ' {_ALL}) || '_') AS digest FROM f GROUP BY 1"""
)
def q_rendered_jira(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d, "jira")


@query(
    f"""WITH {_review._SQL}, {_ITEM} SELECT file, md5(repeat('─', 60) || chr(10) || string_agg('[' || severity || '] ' || rule_id || ': ' || title || ' (line ' || start_line || ')' || CASE WHEN description <> '' THEN chr(10) || '  ' || replace(description, chr(10), ' ') ELSE '' END || CASE WHEN suggestion <> '' THEN chr(10) || '  Fix: ' || suggestion ELSE '' END || chr(10), chr(10) {_ALL}) || chr(10) || repeat('─', 60)) AS digest FROM f GROUP BY 1"""
)
def q_rendered_text(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d, "text")


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = _findings(spark, d)
    return i.where("NOT is_pre_flagged"), i.where("is_pre_flagged").groupBy("file").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_review._SQL}, n AS (SELECT file, count(*) AS n FROM issues WHERE is_pre_flagged GROUP BY 1) SELECT file, {_WORST} AS severity, md5('=== Additional findings (' || count(*) || ' issues) ===' || chr(10) || coalesce(any_value(n), 0) || ' issue(s) already shown inline.' || chr(10) || chr(10)
      || string_agg('  [' || severity || '] ' || rule_id || ': Rule ' || rule_id || ' (' || file || ':' || start_line || ')', chr(10) {_ORDER})) AS digest FROM issues LEFT JOIN n USING (file) WHERE NOT is_pre_flagged GROUP BY 1"""
)
def q_summaries(spark: SparkSession, d: str) -> DataFrame:
    rest, inline = _folded(spark, d)
    return O.summaries(rest, ["file"], inline, "text").select("file", "severity", F.md5("body").alias("digest"))


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    g = V.comment_groups(_review.issues(spark, d), ["file", "is_pre_flagged"], 1, ["seq", "seq2", "seq3"])
    inline = g.where("is_pre_flagged").select(F.col("file").alias("file_path"), "line", "end_line", "severity", F.concat("severity", F.lit(" x"), F.col("issues").cast("string")).alias("body"))
    rest, n = _folded(spark, d)
    return O.assembled(inline, O.summaries(rest, ["file"], n, "github"))


@query(f"WITH {_review._GROUPS} SELECT 'inline' AS kind, file::VARCHAR AS file_path, line, end_line, severity FROM g WHERE is_pre_flagged UNION ALL SELECT 'summary', '', 0, 0, {_WORST} FROM issues WHERE NOT is_pre_flagged GROUP BY file")
def q_comments(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d).select("kind", "file_path", "line", "end_line", "severity")


@query(f"WITH {_review._GROUPS} SELECT file::VARCHAR AS file_path, line, '{{\"path\":\"' || file || '\",\"body\":\"' || severity || ' x' || issues || '\",' || CASE WHEN end_line > line THEN '\"start_line\":' || line || ',\"line\":' || end_line || ',\"side\":\"RIGHT\",\"start_side\":\"RIGHT\"}}' ELSE '\"line\":' || line || ',\"side\":\"RIGHT\"}}' END AS payload FROM g WHERE is_pre_flagged")
def q_payloads(spark: SparkSession, d: str) -> DataFrame:
    return O.anchored(_assembled(spark, d)).select("file_path", "line", "payload")


_COUNTS = ", ".join(f"count_if(severity = '{s}') AS {s.lower()}" for s in O.SIGNS)


@query(f"WITH {_review._SQL} SELECT rule_id, count(*) AS issues, count(DISTINCT file) AS files, {_COUNTS} FROM issues GROUP BY 1")
def q_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.counts(_findings(spark, d), "rule_id")


_BADGES = "concat_ws(' · ', " + ", ".join(f"CASE WHEN {s.lower()} > 0 THEN '**{s}**: ' || {s.lower()} END" for s in list(O.SIGNS)[:4]) + ")"


@query(
    f"""WITH {_review._SQL}, i AS (SELECT *, substr(rule_id, 1, 1) AS category FROM issues), n AS (SELECT category, rule_id, count(*) AS n FROM i GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, rule_id) AS place FROM n),
    r AS (SELECT category, string_agg('- `' || rule_id || '` × ' || n, chr(10) ORDER BY place) AS rules FROM t WHERE place <= 5 GROUP BY 1), c AS (SELECT category, count(*) AS issues, {_COUNTS} FROM i GROUP BY 1)
    SELECT category, md5('## Review ' || category || chr(10) || chr(10) || '**' || issues || ' issue(s) found**' || CASE WHEN {_BADGES} <> '' THEN ' · ' || {_BADGES} ELSE '' END || chr(10) || chr(10) || '**Most frequent violations:**' || chr(10) || rules || chr(10) || chr(10) || '_Inline comments show specific violations. See the full HTML report for details._') AS digest FROM c JOIN r USING (category)"""
)
def q_review_bodies(spark: SparkSession, d: str) -> DataFrame:
    return O.review_bodies(_findings(spark, d), ["category"], F.concat(F.lit("## Review "), "category")).select("category", F.md5("body").alias("digest"))


_ROWS = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {s.lower()} > 0 THEN rpad('{s}', 9, ' ') || ' ' || rpad(repeat('█', least(30, 2 * {s.lower()})::BIGINT), 30, ' ') || '  ' || (CASE WHEN {s.lower()} < 10000 THEN lpad({s.lower()}::VARCHAR, 4, ' ') ELSE left({s.lower()}::VARCHAR, 4) END) || ' issue(s)' END" for s in O.SIGNS) + ")"


@query(f"WITH {_review._SQL}, c AS (SELECT file, {_COUNTS} FROM issues GROUP BY 1) SELECT file, md5({_ROWS}) AS digest FROM c")
def q_console(spark: SparkSession, d: str) -> DataFrame:
    return O.console(_findings(spark, d), ["file"]).select("file", F.md5("text").alias("digest"))


@query()
def q_file_reports(spark: SparkSession, d: str) -> DataFrame:
    return O.file_reports(_findings(spark, d), ["category"]).select("category", "file_path", F.md5("report").alias("digest"))


@query(f"WITH {_review._SQL}, n AS (SELECT substr(rule_id, 1, 1) AS category, rule_id, count(*) AS n FROM issues GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY category) AS top FROM n) SELECT category, rule_id, n, floor(100 * n / top)::INT AS share, length(repeat('█', least(30, 2 * n)::BIGINT)) AS bar FROM m")
def q_rule_shares(spark: SparkSession, d: str) -> DataFrame:
    n = O.top_rules(_findings(spark, d), ["category"], 1000)
    top = n.where("place = 1").select("category", F.col("n").alias("top"))
    return n.join(top, "category").select("category", "rule_id", "n", O.share(F.col("n"), F.col("top")).alias("share"), F.length(O.bar(F.col("n"))).alias("bar"))
