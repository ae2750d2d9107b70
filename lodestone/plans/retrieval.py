"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _words(c: str):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


_BM25 = f"""d AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, len(t) AS dl, t FROM d WHERE len(t) > 0),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dl) GROUP BY 1, 2, 3),
  i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), st),
  i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_WORDS.format("content")}) AS term FROM eval_items) GROUP BY 1, 2),
  scored AS (SELECT query_id, doc_id, sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM q JOIN i USING (term) JOIN p USING (term), st GROUP BY 1, 2)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 15")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are most like each evaluation item, by its whole text."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", _words("text").alias("terms"))
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), _words("content").alias("terms"))
    return R.bm25_top(asked, docs, 15, itself=True).select("query_id", "doc_id", "score", "rank")


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth document, which asks, and all of them, with the words of their whole texts."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", _words("text").alias("terms"))
    return docs.where("doc_id % 20 = 0"), docs


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, len(t) AS dl, t FROM d WHERE len(t) > 0),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM dl) GROUP BY 1, 2, 3),
    i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), st),
    i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
    scored AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl)))) AS score FROM p q JOIN i USING (term) JOIN p USING (term), st WHERE q.doc_id % 20 = 0 AND q.doc_id <> p.doc_id GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 15"""
)
def q_bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_top(*_documents(spark, d), 15).select("query_id", "doc_id", "score", "rank")


@query(
    """SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
       (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 15"""
)
def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.cosine_top(e.where("vec_id % 20 = 0"), e, 15).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    """SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
       (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def q_cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.cosine_top(e.where("vec_id % 20 = 0"), e, 5, same="label").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
    s AS (SELECT p_brand, p_partkey, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a WHERE rank <= 15 UNION ALL SELECT * FROM b WHERE rank <= 15) GROUP BY 1, 2)
    SELECT p_brand, p_partkey, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 12) DESC, p_partkey) AS rank FROM s) WHERE rank <= 7"""
)
def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = (R.top(p, ["p_brand"], [F.col(c).desc(), F.col("p_partkey")], 15) for c in ("p_retailprice", "p_size"))
    return R.rrf([a, b], "p_brand", "p_partkey", 7).select("p_brand", "p_partkey", F.round("score", 9).alias("score"), "rank")


@query()
def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense ranks of all documents for every twentieth one, by its whole text, fused."""
    lexical = R.bm25_top(*_documents(spark, d), 15)
    embed = R.hashing_embedder()
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", embed("text").alias("embedding"))
    dense = R.cosine_top(docs.where("doc_id % 20 = 0"), docs, 15, key="doc_id")
    return R.rrf([lexical, dense], "query_id", "doc_id", 7).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")
