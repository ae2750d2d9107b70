"""Queries of scans, classification and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import classify
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _in(names) -> str:
    return ", ".join("'" + x + "'" for x in names)


def sql_lines(c: str) -> str:
    """SQL for the lines of a text, as functions.text.lines."""
    s = f"regexp_split_to_array({c}, '{_END}')"
    return f"(CASE WHEN {s}[-1] = '' THEN list_slice({s}, 1, len({s}) - 1) ELSE {s} END)"


_SQL_LANGUAGE = "CASE " + " ".join(f"WHEN ext IN ({_in(v)}) THEN '{k}'" for k, v in classify.EXTENSIONS.items()) + " " + " ".join(f"WHEN starts_with(coalesce(ls[1], ''), '{s}') THEN '{n}'" for n, s in classify.SHEBANGS) + " ELSE 'unknown' END"
_SQL_FLAGS = f"""
 flags0 AS (SELECT file_id, repo_name, path, coalesce(content, '') AS content, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name,
    lower(regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]+)$', 1)) AS ext, {sql_lines("coalesce(content, '')")} AS ls FROM repo_file),
 flags1 AS (SELECT *, contains(substr(content, 1, 8192), chr(0)) AS is_binary FROM flags0),
 flags AS (SELECT file_id, repo_name, path, content, parts, name, ext, is_binary, CASE WHEN is_binary THEN 'binary' ELSE {_SQL_LANGUAGE} END AS language,
    NOT is_binary AND ({" OR ".join(f"ends_with(name, '{x}')" for x in classify.GENERATED_ENDS)} OR len(list_filter(list_slice(ls, 1, 5), lambda x: {" OR ".join(f"contains(x, '{m}')" for m in classify.GENERATED_MARKS)})) > 0) AS is_generated,
    NOT is_binary AND (contains(name, '.min.') OR length(coalesce(list_filter(ls, lambda x: trim(x) <> '')[1], '')) > 500) AS is_minified,
    NOT is_binary AND list_has_any(parts, [{_in(classify.VENDOR_PARTS)}]) AS is_vendor,
    NOT is_binary AND (list_has_any(list_slice(parts, 1, len(parts) - 1), [{_in(classify.TEST_DIRS)}]) OR {" OR ".join(f"contains(name, '{x}')" for x in classify.TEST_NAMES)}) AS is_test,
    NOT is_binary AND ext IN ({_in(classify.CONFIG_EXTENSIONS)}) AS is_config FROM flags1)
"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return classify.file_flags(table(spark, d, "repo_file"))


@query(f"WITH {_SQL_FLAGS} SELECT file_id, language, is_binary, is_generated, is_minified, is_vendor, is_test, is_config FROM flags")
def q_file_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("file_id", "language", "is_binary", "is_generated", "is_minified", "is_vendor", "is_test", "is_config")


@query(
    f"""WITH {_SQL_FLAGS} SELECT file_id, CASE WHEN list_has_any(parts, [{_in(classify.SKIP_DIRS)}]) THEN 'skip_dir'
      WHEN len(list_filter(parts, lambda x: ends_with(x, '.egg-info') OR ends_with(x, '.dist-info'))) > 0 THEN 'skip_dir_glob'
      WHEN len(list_filter(parts, lambda x: starts_with(x, '.'))) > 0 THEN 'hidden_dir' WHEN is_vendor THEN 'vendor'
      WHEN is_binary OR ext IN ({_in(classify.BINARY_EXTENSIONS)}) THEN 'binary' WHEN name IN ({_in(classify.LOCK_NAMES)}) THEN 'lock_file'
      WHEN is_generated THEN 'generated' WHEN octet_length(encode(content)) < 10 THEN 'too_small' END AS skip_reason FROM flags"""
)
def q_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return classify.skip_reason(flagged(spark, d)).select("file_id", "skip_reason")


@query(
    f"""WITH {_SQL_FLAGS} SELECT file_id, NOT (octet_length(encode(content)) > 500000 OR is_minified OR language = 'unknown') AS is_parseable,
      length(content) - length(replace(content, chr(10), '')) + 1 AS line_count FROM flags"""
)
def q_parseable(spark: SparkSession, d: str) -> DataFrame:
    return classify.parseable(flagged(spark, d)).select("file_id", "is_parseable", "line_count")


@query(f"WITH {_SQL_FLAGS} SELECT language, count(*) AS n FROM flags GROUP BY 1")
def q_lang_hist(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS files, sum(size_bytes) AS bytes, count_if(size_bytes IS NULL) AS unsized FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, size_bytes DESC NULLS LAST) AS r FROM files) WHERE r = 1")
def q_size_totals(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "files").groupBy("file_id").agg(F.max_by("size_bytes", F.struct("scanned_at", F.coalesce("size_bytes", F.lit(-1)))).alias("size_bytes"))
    return last.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("size_bytes").isNull()).alias("unsized"))


@query(
    """SELECT repo_name, count(DISTINCT CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] END) AS top_dirs,
       coalesce(bool_or(list_contains(string_split(path, '/'), 'src')), false) AS has_src_layout,
       coalesce(bool_or(string_split(path, '/')[-1] IN ('lerna.json', 'nx.json', 'pnpm-workspace.yaml', 'go.work')), false) AS is_monorepo FROM repo_file GROUP BY 1"""
)
def q_structure_hints(spark: SparkSession, d: str) -> DataFrame:
    return classify.structure_hints(table(spark, d, "repo_file"))


@query(f"SELECT file_id, len({sql_lines('content')}) AS lines, len(list_filter({sql_lines('content')}, lambda x: trim(x) <> '')) AS nonblank FROM repo_file WHERE content IS NOT NULL")
def q_nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = T.lines(F.col("content"))
    return table(spark, d, "repo_file").where("content IS NOT NULL").select("file_id", F.size(ls).alias("lines"), F.size(F.filter(ls, lambda x: F.trim(x) != "")).alias("nonblank"))


_NS = T.CHUNK_NAMESPACE.replace("-", "")


@query(
    f"""WITH c AS (SELECT DISTINCT chunk_id, repo_name, file_path, chunk_type, symbol_name, start_line FROM chunks),
     h AS (SELECT chunk_id, sha1(unhex('{_NS}') || encode(coalesce(repo_name, '') || chr(31) || coalesce(file_path, '') || chr(31) || coalesce(chunk_type, '') || chr(31) || coalesce(symbol_name, '') || chr(31) || coalesce(start_line::VARCHAR, ''))) AS s FROM c)
     SELECT chunk_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', ('0x' || substr(s, 17, 1))::INT % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h"""
)
def q_chunk_uuid5(spark: SparkSession, d: str) -> DataFrame:
    names = ("repo_name", "file_path", "chunk_type", "symbol_name", "start_line")
    c = table(spark, d, "chunks").select("chunk_id", *names).distinct()
    return c.select("chunk_id", T.uuid5(*map(F.col, names)).alias("id"))


@query("SELECT DISTINCT chunk_id, md5(content) AS hash, content_hash IS NULL OR lower(content_hash) = md5(content) AS agrees FROM chunks WHERE content IS NOT NULL")
def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5("content")
    return table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", h.alias("hash"), (F.col("content_hash").isNull() | (F.lower("content_hash") == h)).alias("agrees")).distinct()


@query("SELECT run_id, strftime(started_at, '%Y%m%d_%H%M%S') || '__' || substr('owner__' || run_id, 1, 20) || '__' || substr(commit_sha, 1, 6) AS name FROM runs")
def q_run_names(spark: SparkSession, d: str) -> DataFrame:
    slug = T.repo_slug(F.concat(F.lit("https://github.com/owner/"), F.col("run_id"), F.lit(".git")))
    return table(spark, d, "runs").select("run_id", T.run_id(F.col("started_at"), slug, F.col("commit_sha")).alias("name"))


@query("SELECT chunk_id, substr(md5(repo_name || '/' || file_path), 1, 16) AS path_key, md5(coalesce(content_hash, '') || chr(31) || coalesce(language, '') || chr(31) || chunk_type) AS review_key FROM (SELECT DISTINCT chunk_id, repo_name, file_path, content_hash, language, chunk_type FROM chunks)")
def q_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "repo_name", "file_path", "content_hash", "language", "chunk_type").distinct()
    e = lambda x: F.coalesce(F.col(x), F.lit(""))
    return c.select("chunk_id", F.substring(F.md5(F.concat_ws("/", "repo_name", "file_path")), 1, 16).alias("path_key"), F.md5(F.concat_ws("\x1f", e("content_hash"), e("language"), "chunk_type")).alias("review_key"))
