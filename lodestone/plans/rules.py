"""Queries of the mechanical rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import rules as R
from lodestone.plans.chunking import chunk_texts
from lodestone.plans.corpus import sql_lines
from lodestone.plans.registry import query

_Q = lambda p: p.replace("'", "''")
_SQL = f"""c AS (SELECT chunk_id, language, chunk_type, symbol_name, parent_symbol, file_path, coalesce(start_line, 1) AS start_line, {sql_lines('content')} AS ls
  FROM (SELECT DISTINCT chunk_id, repo_name, file_path, language, chunk_type, symbol_name, start_line, content, parent_symbol FROM chunks) WHERE content IS NOT NULL AND chunk_type NOT IN ('module', 'import')),
  x AS (SELECT * EXCLUDE (ls), unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM c)"""
_FN = "chunk_type IN ('function', 'method')"


def _of(spark: SparkSession, d: str, rule: str) -> DataFrame:
    c = chunk_texts(spark, d, "chunk_id", "file_path", "language", "chunk_type", "symbol_name", "start_line", "content", "parent_symbol")
    return R.violations(c, tuple(r for r in R.RULES if rule in ("", r.rule_id))).distinct()


@query(f"WITH {_SQL} SELECT chunk_id, 'GEN001' AS rule_id, 'MEDIUM' AS severity, start_line AS line FROM c WHERE {_FN} AND len(list_filter(ls, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:#|//)'))) > 50")
def q_rule_length(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "GEN001")


@query(f"WITH {_SQL} SELECT chunk_id, 'SEC001' AS rule_id, 'CRITICAL' AS severity, start_line + i - 1 AS line FROM x WHERE NOT coalesce(regexp_matches(file_path, '{_Q(R.TEST_PATH)}'), false) AND regexp_matches(line, '{_Q(R.SECRET)}') AND NOT regexp_matches(trim(regexp_extract(line, '{_Q(R.SECRET)}', 1)), '{_Q(R.PLACEHOLDER)}')")
def q_rule_secret(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "SEC001")


@query(
    f"""WITH {_SQL}, m AS (SELECT chunk_id, start_line + i - 1 AS line, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS r FROM x WHERE {_FN} AND trim(line) <> '' AND NOT starts_with(trim(line), '#')
      AND NOT regexp_matches(trim(line), '{_Q(R.MAGIC_SKIP)}') AND regexp_matches(trim(line), '{_Q(R.MAGIC_CONTEXT)}') AND regexp_matches(trim(line), '{_Q(R.MAGIC)}'))
    SELECT chunk_id, 'GEN002' AS rule_id, 'LOW' AS severity, line FROM m WHERE r <= 3"""
)
def q_rule_magic(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "GEN002")


@query()
def q_rule_parameters(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "CP013")


@query(f"WITH {_SQL}, m AS (SELECT chunk_id, start_line + i - 1 AS line, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS r FROM x WHERE {_FN} AND language = 'swift' AND (contains(coalesce(parent_symbol, ''), 'ViewController') OR contains(coalesce(file_path, ''), 'ViewController')) AND NOT starts_with(trim(line), '//') AND regexp_matches(line, '{_Q(R.NETWORK)}')) SELECT chunk_id, 'SW008' AS rule_id, 'HIGH' AS severity, line FROM m WHERE r <= 3")
def q_rule_network(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "SW008")


@query()
def q_rule_mounted(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "DA008")


@query(
    f"""WITH {_SQL}, h AS (SELECT chunk_id, start_line, array_to_string(list_slice(ls, 1, 8), chr(10)) AS head FROM c WHERE {_FN} AND language = 'python' AND NOT starts_with(coalesce(symbol_name, ''), '_')),
    p AS (SELECT *, list_filter(list_transform(string_split(regexp_extract(head, '{_Q(R.HINTED)}', 1), ','), lambda v: trim(v)), lambda v: v NOT IN ('self', 'cls', '')) AS ps FROM h WHERE regexp_matches(head, '{_Q(R.HINTED)}'))
    SELECT chunk_id, 'PY001' AS rule_id, 'LOW' AS severity, start_line AS line FROM p WHERE len(list_filter(ps, lambda v: NOT contains(string_split(v, '=')[1], ':'))) > 0 OR NOT contains(head, '->')"""
)
def q_rule_hints(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "PY001")


@query()
def q_violations(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "").groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


@query(
    f"""WITH m AS (SELECT repo_name, parent_symbol, language, symbol_name, array_to_string(list_slice({sql_lines('content')}, 1, 3), chr(10)) AS head FROM (SELECT DISTINCT chunk_id, repo_name, chunk_type, language, symbol_name, parent_symbol, content FROM chunks) WHERE chunk_type = 'method' AND content IS NOT NULL AND parent_symbol IS NOT NULL)
    SELECT repo_name, parent_symbol, count(*) AS methods FROM m WHERE NOT regexp_matches(head, '\\boverride\\b|@[Oo]verride\\b|\\bprivate\\b|\\bfileprivate\\b') AND NOT regexp_matches(coalesce(symbol_name, ''), '(^|\\.)_')
      AND (language <> 'rust' OR regexp_matches(head, '\\bpub\\b')) AND NOT contains(lower(parent_symbol), 'test') GROUP BY 1, 2 HAVING count(*) > 3"""
)
def q_god_class(spark: SparkSession, d: str) -> DataFrame:
    return R.god_classes(chunk_texts(spark, d, "chunk_id", "repo_name", "chunk_type", "language", "symbol_name", "parent_symbol", "content"), most=3)
