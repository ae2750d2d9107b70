"""Queries of chunk construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import build as B
from lodestone.operators import chunking as C
from lodestone.plans.corpus import _SQL_FLAGS, flagged, sql_lines
from lodestone.plans.registry import query
from lodestone.sources.tables import table

FILE = ["repo_name", "file_path"]
_ONCE = "(SELECT DISTINCT chunk_id, repo_name, file_path, language, chunk_type, symbol_name, start_line, end_line, content, parent_symbol, layer FROM chunks)"
_COLUMNS = ("chunk_id", "repo_name", "file_path", "language", "chunk_type", "symbol_name", "start_line", "end_line", "content", "parent_symbol", "layer")


def chunks_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The chunks without re-deliveries, with the columns named."""
    return table(spark, d, "chunks").select(*(columns or _COLUMNS)).distinct()


def chunk_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The chunks as delivered, for queries that turn texts into small rows first and make those distinct: texts aren't shuffled."""
    return table(spark, d, "chunks").select(*columns)


@query(
    f"""WITH f AS (SELECT file_id, {sql_lines('content')} AS ls FROM repo_file WHERE content IS NOT NULL),
     w AS (SELECT file_id, ls, unnest(generate_series(1, len(ls), 45))::INT AS start_line FROM f)
     SELECT file_id, start_line, least(start_line + 59, len(ls))::INT AS end_line, md5(array_to_string(list_slice(ls, start_line, start_line + 59), chr(10))) AS text_md5 FROM w
     WHERE regexp_replace(array_to_string(list_slice(ls, start_line, start_line + 59), ''), '\\s+', '', 'g') <> ''"""
)
def q_windows_60_45(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(table(spark, d, "repo_file")).select("file_id", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query(f"SELECT DISTINCT chunk_id, CASE WHEN len({sql_lines('content')}) = 0 THEN '0' ELSE array_to_string(list_append(generate_series(0, len({sql_lines('content')}) - 1, 5), len({sql_lines('content')})), ',') END AS offsets FROM chunks WHERE content IS NOT NULL")
def q_sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = T.line_count(F.col("content"))
    return chunk_texts(spark, d, "chunk_id", "content").where("content IS NOT NULL").select("chunk_id", n.alias("n")).distinct().select("chunk_id", F.array_join(C.sentence_offsets(F.col("n")).cast("array<string>"), ",").alias("offsets"))


@query("SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM (SELECT DISTINCT chunk_id, repo_name, file_path, start_line FROM chunks) WINDOW w AS (PARTITION BY repo_name, file_path ORDER BY start_line NULLS FIRST, chunk_id)")
def q_nav_pointers(spark: SparkSession, d: str) -> DataFrame:
    return C.neighbours(chunks_once(spark, d, "chunk_id", *FILE, "start_line"), FILE, ["start_line", "chunk_id"]).select("chunk_id", "prev_id", "next_id")


@query(
    """WITH c AS (SELECT DISTINCT chunk_id, repo_name, file_path, chunk_type, symbol_name, parent_symbol, start_line FROM chunks),
     h AS (SELECT repo_name, file_path, symbol_name, chunk_id, row_number() OVER (PARTITION BY repo_name, file_path, symbol_name ORDER BY start_line, chunk_id) AS r FROM c WHERE chunk_type = 'class_head')
     SELECT c.chunk_id, h.chunk_id AS parent_id FROM c LEFT JOIN h ON h.r = 1 AND h.repo_name = c.repo_name AND h.file_path = c.file_path AND h.symbol_name = c.parent_symbol WHERE c.chunk_type = 'method'"""
)
def q_parent_first(spark: SparkSession, d: str) -> DataFrame:
    return C.parents(chunks_once(spark, d, "chunk_id", *FILE, "chunk_type", "symbol_name", "parent_symbol", "start_line"), FILE)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    n = T.line_count(F.col("content"))
    c = chunk_texts(spark, d, *FILE, "chunk_type", "start_line", "content").where("chunk_type <> 'module' AND content IS NOT NULL AND start_line IS NOT NULL")
    return c.select(*FILE, "start_line", (F.col("start_line") + n - 1).alias("end_line")).where("end_line >= start_line").distinct()


_SQL_SPANS = f"spans AS (SELECT repo_name, file_path, start_line, start_line + len({sql_lines('content')}) - 1 AS end_line FROM (SELECT DISTINCT chunk_id, repo_name, file_path, chunk_type, start_line, content FROM chunks) WHERE chunk_type <> 'module' AND content IS NOT NULL AND start_line IS NOT NULL AND len({sql_lines('content')}) > 0)"


@query(f"WITH {_SQL_SPANS} SELECT repo_name, file_path, count(DISTINCT line) AS covered FROM (SELECT repo_name, file_path, unnest(generate_series(start_line, end_line)) AS line FROM spans) GROUP BY 1, 2")
def q_covered_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.islands(_spans(spark, d), FILE).groupBy(*FILE).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered"))


@query(
    f"""WITH {_SQL_SPANS}, sizes AS (SELECT repo_name, path AS file_path, len({sql_lines('content')}) AS n FROM repo_file WHERE content IS NOT NULL),
     cov AS (SELECT DISTINCT repo_name, file_path, unnest(generate_series(start_line, end_line)) AS line FROM spans),
     free AS (SELECT s.repo_name, s.file_path, s.line FROM (SELECT repo_name, file_path, unnest(generate_series(1, n)) AS line FROM sizes) s ANTI JOIN cov USING (repo_name, file_path, line)),
     runs AS (SELECT repo_name, file_path, line, line - row_number() OVER (PARTITION BY repo_name, file_path ORDER BY line) AS g FROM free)
     SELECT repo_name, file_path, min(line)::INT AS start_line, max(line)::INT AS end_line FROM runs GROUP BY repo_name, file_path, g HAVING count(*) >= 20"""
)
def q_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "repo_file").where("content IS NOT NULL").select("repo_name", F.col("path").alias("file_path"), T.line_count(F.col("content")).alias("n"))
    return C.gaps(_spans(spark, d), sizes, FILE).select(*FILE, F.col("start_line").cast("int"), F.col("end_line").cast("int"))


@query(
    f"""WITH s AS (SELECT chunk_id, start_line, start_line + len({sql_lines('content')}) - 1 AS end_line, len({sql_lines('content')}) AS n FROM (SELECT DISTINCT chunk_id, chunk_type, start_line, content FROM chunks)
       WHERE chunk_type IN ('function', 'method', 'block', 'class') AND content IS NOT NULL AND start_line IS NOT NULL AND len({sql_lines('content')}) > 100),
     p AS (SELECT *, unnest(generate_series(1, ceil((n - 15) / 85.0)::BIGINT))::INT AS part FROM s)
     SELECT chunk_id, part, (start_line + (part - 1) * 85)::INT AS part_start, least(start_line + (part - 1) * 85 + 99, end_line)::INT AS part_end, '@split:' || part || '/' || ceil(n / 85.0)::INT AS label FROM p"""
)
def q_long_symbol_parts(spark: SparkSession, d: str) -> DataFrame:
    n = T.line_count(F.col("content"))
    s = chunk_texts(spark, d, "chunk_id", "chunk_type", "start_line", "content").where("chunk_type IN ('function', 'method', 'block', 'class') AND content IS NOT NULL AND start_line IS NOT NULL")
    return C.parts(s.select("chunk_id", "start_line", (F.col("start_line") + n - 1).alias("end_line")).distinct()).select("chunk_id", "part", "part_start", "part_end", "label")


_SQL_PRE = C.PREAMBLE.replace("'", "''")


@query(
    f"""WITH f AS (SELECT file_id, list_slice({sql_lines('content')}, 1, 50) AS h FROM repo_file WHERE content IS NOT NULL),
     g AS (SELECT file_id, len(h) AS n, coalesce(list_position(list_transform(h, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{_SQL_PRE}')), true), 0) AS code FROM f)
     SELECT file_id, CASE WHEN code > 0 THEN least(code + 1, n) ELSE n END AS module_end FROM g"""
)
def q_module_chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo_file").where("content IS NOT NULL").select("file_id", C.module_end(F.col("content")).alias("module_end"))


@query("SELECT chunk_type, count(*) AS n, count_if(coalesce(trim(summary), '') <> '') AS summarised FROM (SELECT chunk_id, chunk_type, max(summary) AS summary FROM chunks GROUP BY 1, 2) GROUP BY 1")
def q_chunk_type_hist(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "chunks").groupBy("chunk_id", "chunk_type").agg(F.max("summary").alias("summary"))
    return once.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("summary", F.lit(""))) != "").alias("summarised"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("repo_name", "path", "language", "content")


@query(
    f"""WITH {_SQL_FLAGS}, h AS (SELECT *, list_slice(ls, 1, 50) AS h FROM flags),
     g AS (SELECT *, len(h) AS n, coalesce(list_position(list_transform(h, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{_SQL_PRE}')), true), 0) AS code FROM (SELECT file_id, repo_name, path, language, {sql_lines('content')} AS ls, list_slice({sql_lines('content')}, 1, 50) AS h FROM flags)),
     e AS (SELECT *, (CASE WHEN code > 0 THEN least(code + 1, n) ELSE n END)::INT AS module_end FROM g)
     SELECT repo_name, path AS file_path, greatest(1, module_end)::INT AS end_line, md5('# File: ' || path || chr(10) || '# Language: ' || language || chr(10) || '# Lines: ' || len(ls) || chr(10) || chr(10) || array_to_string(list_slice(h, 1, module_end), chr(10))) AS content_hash FROM e"""
)
def q_module_chunks(spark: SparkSession, d: str) -> DataFrame:
    return B.module_chunks(_files(spark, d)).select("repo_name", "file_path", "end_line", F.md5("content").alias("content_hash"))


@query()
def q_chunks_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Scan to chunks: every file cut by its parser, with ids, hashes and no text."""
    return B.chunked(_files(spark, d)).select("chunk_id", "repo_name", "file_path", "chunk_type", "symbol_name", "parent_symbol", "start_line", "end_line", "content_hash")


@query()
def q_chunk_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of the chunks that files are cut into."""
    return B.linked(B.chunked(_files(spark, d)))


@query("SELECT DISTINCT chunk_id, md5('# ' || file_path || ':' || start_line || chr(10) || content) AS located FROM chunks WHERE content IS NOT NULL AND start_line IS NOT NULL AND chunk_type <> 'import'")
def q_located(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under the line that says where they stand, as they are embedded."""
    c = chunk_texts(spark, d, "chunk_id", "file_path", "chunk_type", "start_line", "content").where("content IS NOT NULL AND start_line IS NOT NULL AND chunk_type <> 'import'")
    return c.select("chunk_id", F.md5(B.located(F.col("file_path"), F.col("start_line"), F.col("content"))).alias("located")).distinct()


@query(
    f"""WITH {_SQL_SPANS}, cov AS (SELECT repo_name, count(DISTINCT (file_path, line)) AS covered FROM (SELECT repo_name, file_path, unnest(generate_series(start_line, end_line)) AS line FROM spans) GROUP BY 1),
     n AS (SELECT repo_name, sum(len({sql_lines('content')})) AS lines FROM repo_file WHERE content IS NOT NULL GROUP BY 1)
     SELECT repo_name, coalesce(covered, 0) AS covered, lines::BIGINT AS lines, round(CASE WHEN lines > 0 THEN coalesce(covered, 0) / lines ELSE 0 END, 9) AS coverage FROM n LEFT JOIN cov USING (repo_name)"""
)
def q_line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered lines by all lines of each repository."""
    cov = C.islands(_spans(spark, d), FILE).groupBy("repo_name").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered"))
    n = table(spark, d, "repo_file").where("content IS NOT NULL").groupBy("repo_name").agg(F.sum(T.line_count(F.col("content"))).cast("bigint").alias("lines"))
    c = F.coalesce("covered", F.lit(0))
    return n.join(cov, "repo_name", "left").select("repo_name", c.alias("covered"), "lines", F.round(F.when(F.col("lines") > 0, c / F.col("lines")).otherwise(0.0), 9).alias("coverage"))


@query("SELECT repo_name, count(*) AS chunks, count_if(chunk_type = 'block' AND contains(coalesce(symbol_name, ''), '_block_')) AS split_blocks FROM (SELECT DISTINCT chunk_id, repo_name, chunk_type, symbol_name FROM chunks) GROUP BY 1")
def q_split_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that were cut out of long functions, by repository."""
    c = chunks_once(spark, d, "chunk_id", "repo_name", "chunk_type", "symbol_name")
    cut = (F.col("chunk_type") == "block") & F.coalesce("symbol_name", F.lit("")).contains("_block_")
    return c.groupBy("repo_name").agg(F.count("*").alias("chunks"), F.count_if(cut).alias("split_blocks"))
