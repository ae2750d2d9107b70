"""Lexical, dense and fused retrieval, for all queries at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The public defaults of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """term, key, tf, dl: how often a term is in a document, and the document's length. Documents without terms have none."""
    one = docs.where(F.size(terms) > 0).select(key, F.size(terms).alias("dl"), F.explode(terms).alias("term"))
    return one.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, key: str, qkey: str = "query_id", terms: str = "terms") -> DataFrame:
    """qkey, key, score (above 0) of each query against the index; a term that a query has twice counts twice."""
    docs = index.select(key, "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = df.join(F.broadcast(docs)).withColumn("raw", raw)  # one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")  # one row
    asked = queries.select(qkey, F.explode(terms).alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("times")).join(idf, "term")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked.join(index, "term").groupBy(qkey, key).agg(F.sum(F.col("times") * F.col("idf") * tf).alias("score")).where("score > 0")


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", terms: str = "terms", block: int = 1024, itself: bool = False) -> DataFrame:
    """query_id, key, score (to 6 places, above 0), rank: the k best documents of each query by the scores of `bm25`.

    A document of the query's own key is left out, unless `itself` says that queries aren't documents.

    Both sides have key (a bigint) and terms. Queries go in blocks of a fixed number, their terms weighted, to where the documents are; a
    task keeps its k best of each query, so the pairs of query and document are never shuffled. Ties: the smaller key.
    """
    spark, clean = docs.sparkSession, docs.where(F.size(terms) > 0).select(key, terms)
    n, avgdl = clean.agg(F.count("*"), F.avg(F.size(terms))).first()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = clean.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", raw)
    mean = df.agg(F.avg("raw")).first()[0]
    weight = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("raw")) * F.col("times")
    asked = queries.select(F.col(key).alias("query_id"), F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(df, "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(weight).alias("weights"))
    types = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])

    def search(batch: list) -> DataFrame:
        words: dict[str, int] = {}
        at = np.array([words.setdefault(w, len(words)) for r in batch for w in r[1]], dtype=np.int64)
        who, much = np.repeat(np.arange(len(batch)), [len(r[1]) for r in batch]), np.array([x for r in batch for x in r[2]], dtype=np.float64)
        order = np.argsort(at, kind="stable")
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in batch], dtype=np.int64), words, np.searchsorted(at[order], np.arange(len(words) + 1)), who[order], much[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, words, begin, who, much = sent.value
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for whole in batches:
                for i in range(0, whole.num_rows, 4096):
                    b = whole.slice(i, 4096)
                    keys = b.column(0).to_numpy(zero_copy_only=False)
                    found = _scores(b.column(1), words, begin, who, much, len(qids), avgdl)
                    if not itself:
                        found[qids[:, None] == keys[None, :]] = 0
                    close = np.round(found, 6)
                    least = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k] if len(keys) > k else -np.inf
                    q, j = np.nonzero((found > 0) & (close >= least))  # ties at the border stay in
                    best = tuple(np.concatenate(x) for x in zip(best, (q, keys[j], close[q, j])))
                    order = np.lexsort((best[1], -best[2], best[0]))
                    best = tuple(x[order] for x in best)
                    best = tuple(x[np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k] for x in best)
            yield pa.RecordBatch.from_pydict({"query_id": qids[best[0]], key: best[1], "score": best[2]}, schema=types)

        return clean.mapInArrow(run, f"query_id bigint, {key} bigint, score double")

    out, pending = clean.limit(0).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score")), []
    for r in asked.toLocalIterator():
        pending.append(tuple(r))
        if len(pending) == block:
            out, pending = out.unionByName(search(pending)), []
    if pending:
        out = out.unionByName(search(pending))
    return top(out, ["query_id"], [F.col("score").desc(), F.col(key)], k)


def _scores(terms: pa.ListArray, words: dict[str, int], begin: np.ndarray, who: np.ndarray, much: np.ndarray, queries: int, avgdl: float) -> np.ndarray:
    """queries x documents. begin, who, much: of each word the queries that have it and its weight there.

    Words that fill much of the product are multiplied as matrices, the others pair by pair.
    """
    n, sizes = len(terms), np.diff(terms.offsets.to_numpy())
    codes = terms.flatten().dictionary_encode()
    col = np.array([words.get(w, -1) for w in codes.dictionary.to_pylist()], dtype=np.int64)[codes.indices.to_numpy()]
    row = np.repeat(np.arange(n), sizes)
    entry, tf = np.unique((col * n + row)[col >= 0], return_counts=True)
    col, row = entry // n, entry % n
    tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / avgdl))
    askers = np.diff(begin)
    dense = np.bincount(col, minlength=len(askers)) * askers > queries * n / 128
    out = np.zeros((queries, n))
    for some in np.array_split(wide := np.nonzero(dense)[0], max(1, -(-len(wide) // 512))):
        place = np.full(len(askers), -1)
        place[some] = np.arange(len(some))
        a, d = np.zeros((queries, len(some))), np.zeros((len(some), n))
        c = np.repeat(np.arange(len(askers)), askers)
        use = place[c] >= 0
        a[who[use], place[c[use]]] = much[use]
        use = place[col] >= 0
        d[place[col[use]], row[use]] = tf[use]
        out += a @ d
    col, row, tf = (x[~dense[col]] for x in (col, row, tf))
    many = askers[col]
    upto = np.cumsum(many)
    cuts = np.flatnonzero(np.diff(upto >> 21, prepend=-1)) if len(upto) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(upto)]):  # about two million pairs at a time
        m = many[lo:hi]
        pair = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[col[lo:hi]], m)
        out += np.bincount(who[pair] * n + np.repeat(row[lo:hi], m), np.repeat(tf[lo:hi], m) * much[pair], minlength=queries * n).reshape(queries, n)
    return out


def top(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Adds rank (1 to k); the filter on row_number lets the engine prune before it shuffles."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def cosine_top(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096, same: str | None = None) -> DataFrame:
    """query_id, key, similarity, rank: the k nearest rows of each query by cosine (0 for a zero vector), itself left out.

    Queries go in blocks of a fixed number to where the rows are; a task keeps its k best of each query, so what is shuffled
    doesn't depend on the number of rows. With `same`, only rows with the query's value in that column count.
    Null vectors are left out. Ties: the smaller key.
    """
    spark, out = rows.sparkSession, None
    kind = rows.schema[key].dataType.simpleString()
    cols = [key, vector, *([same] if same else [])]
    clean = rows.where(F.col(vector).isNotNull()).select(*cols)
    pending: list = []

    def unit(x) -> np.ndarray:
        m = np.asarray(x, dtype=np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(n == 0, 1, n)

    def search(batch: list) -> DataFrame:
        ids = [r[0] for r in batch]
        sent = spark.sparkContext.broadcast((ids, unit([r[1] for r in batch]), [r[2] for r in batch] if same else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, groups = sent.value
            best: dict = {}
            for b in batches:
                if not b.num_rows:
                    continue
                keys, m = b.column(0).to_pylist(), unit(b.column(1).to_pylist())
                other = np.asarray(b.column(2).to_pylist(), dtype=object) if same else None
                sim = q @ m.T
                for i, qid in enumerate(qids):
                    s = sim[i] if other is None else np.where(other == groups[i], sim[i], -np.inf)
                    near = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
                    cut = s[near].min()  # ties at the border stay in
                    for j in np.nonzero(s >= cut)[0] if np.isfinite(cut) else np.nonzero(np.isfinite(s))[0]:
                        if keys[j] != qid:
                            best.setdefault(i, []).append((-s[j], keys[j]))
                for i in best:
                    best[i] = sorted(best[i])[:k]
            flat = [(qids[i], n, -s) for i, found in best.items() for s, n in found]
            yield pa.RecordBatch.from_pydict({"query_id": [x[0] for x in flat], key: [x[1] for x in flat], "similarity": [float(x[2]) for x in flat]}, schema=types)

        types = pa.schema([("query_id", pa.int64()), (key, pa.int64() if kind == "bigint" else pa.string()), ("similarity", pa.float64())])
        return clean.mapInArrow(run, f"query_id bigint, {key} {kind}, similarity double")

    for r in queries.where(F.col(vector).isNotNull()).select(*cols).toLocalIterator():
        pending.append(tuple(r))
        if len(pending) == block:
            out = search(pending) if out is None else out.unionByName(search(pending))
            pending = []
    if pending or out is None:
        part = search(pending or [(0, [0.0], None)]) if pending else search([(0, [0.0] * 1, None)]).limit(0)
        out = part if out is None else out.unionByName(part)
    return top(out, ["query_id"], [F.col("similarity").desc(), F.col(key)], k)


def rrf(lists: list[DataFrame], by: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """by, key, score, rank: reciprocal rank fusion of ranked lists (by, key, rank), ties by key."""
    parts = [x.select(by, key, (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy(by, key).agg(F.sum("s").alias("score")), [by], [F.round("score", 12).desc(), F.col(key)], k)


def hashing_embedder(size: int = 64):
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of unit length (pandas UDF on text)."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                    v[h % size] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return embed
