"""Near-duplicate records with small edits: every pair of texts whose word-shingle sets reach a Jaccard similarity.

Equal sets are one class and only classes are compared. Candidates share a shingle of their prefixes (the rarest
shingles, as many as the threshold makes necessary), which loses no pair. A pivot table then discards most of them: each
class has its Hamming distances to reference fingerprints, the empty fingerprint on each of 64 ranges of hashes. By the triangle
inequality no coordinate can differ by more than the sets do, and as the ranges are disjoint the differences add up. The
survivors are verified on the sets. No count of partners or candidates is capped.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, cut_by

_WORD = re.compile(r"[a-z0-9_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Reference fingerprints of the pivot table.
PIVOTS = 64
#: Cells of the table of shingle counts, one byte each: what is sent to each task has this size, whatever the corpus has.
CELLS_LOG2 = 22


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[str], size: int, cache: dict[str, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of `size` words."""
    h = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + n] * _MIX[k]
    return np.unique(_scramble(total))


def shingled(items: DataFrame, key: str, text: str, size: int = 3, least_words: int = 30, once: bool = False) -> DataFrame:
    """key, d1, d2 (digest of the set), n, shingles (sorted), pivots (64 bytes) of each text with enough words.

    With `once` a task gives each set only once, so copies of a hot text are combined before they are shuffled. Words are the maximal runs of ASCII letters, digits and `_`, lower-cased. Null texts and texts with fewer words are left out.
    """
    types = pa.schema([(key, pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64())), ("pivots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        given: set[bytes] = set()
        for b in batches:
            keys, one, two, sizes, sets, pivots = [], [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _WORD.findall(t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else " " for c in t))
                if len(words) < least_words or len(words) < size:
                    continue
                s = shingle_set(words, size, cache)
                d = xxhash.xxh3_128_digest(s.tobytes())
                if once:
                    if d in given:
                        continue
                    if len(given) > 1_000_000:
                        given.clear()  # a combiner only: what it forgets is combined later
                    given.add(d)
                keys.append(k)
                one.append(int.from_bytes(d[:8], "big", signed=True))
                two.append(int.from_bytes(d[8:], "big", signed=True))
                sizes.append(len(s))
                sets.append(s.view(np.int64))
                pivots.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PIVOTS), 255).astype(np.uint8).tobytes())
                if len(cache) > 1_000_000:
                    cache.clear()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) if sizes else np.zeros(1, np.int32))
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, flat), pa.array(pivots, pa.binary())], schema=types)

    ddl = f"{key} string, d1 bigint, d2 bigint, n int, shingles array<bigint>, pivots binary"
    return items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string"), text).mapInArrow(run, ddl)


def _counts(classes: DataFrame) -> np.ndarray:
    """How often shingles of each cell occur in all classes, on a scale of 8 steps a doubling; 4 MB, whatever the corpus.

    Tasks count by cell and send packed blocks of cells, which are added up block by block.
    """
    cells, block = 1 << CELLS_LOG2, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((flat & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
        parts = [(i, zlib.compress(total[i : i + block].tobytes(), 1)) for i in range(0, cells, block)]
        yield pa.RecordBatch.from_arrays([pa.array([i // block for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "counts"])

    def add(key, parts):
        total = np.zeros(block, dtype=np.uint64)
        for c in parts.column("counts").to_pylist():  # one a task
            total += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        scale = np.minimum(np.round(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([scale.tobytes()], pa.binary())], names=["part", "scale"])

    spark = classes.sparkSession
    few = max(1, min(classes.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism))
    blocks = classes.select("shingles").coalesce(few).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, scale binary")
    table = np.zeros(cells, dtype=np.uint8)
    for r in blocks.collect():  # 256 rows of 16 KB
        table[r["part"] * block : (r["part"] + 1) * block] = np.frombuffer(r["scale"], dtype=np.uint8)
    return table


def prefix_length(n: int, threshold: float) -> int:
    """How many of its first shingles a set must look up so that no similar set is missed."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def small_prefix_length(n: int, threshold: float) -> int:
    """The same for sets that only look for partners of their size or larger."""
    return n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1


def _prefixes(classes: DataFrame, table, length, suffix: str) -> DataFrame:
    """token, id, n, pos (with the suffix): the prefix of each class, its shingles ordered from rare to frequent (ties by hash)."""
    types = pa.schema([("token", pa.int64()), (f"id{suffix}", pa.int64()), (f"n{suffix}", pa.int32()), (f"pos{suffix}", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, mask = table.value, np.uint64((1 << CELLS_LOG2) - 1)
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            tokens, owners, sizes, places = [], [], [], []
            for i, x in enumerate(ids):
                s = flat[offsets[i] : offsets[i + 1]]
                n = len(s)
                p = length(n)
                u = s.view(np.uint64)
                # rarity in the top byte, then the hash: one order for all sets
                order = np.argsort((scale[(u & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8)), kind="stable")[:p]
                tokens.append(s[order])
                owners.append(np.full(p, x, np.int64))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (tokens, owners, sizes, places)], schema=types)

    return classes.select("id", "shingles").mapInArrow(run, f"token bigint, id{suffix} bigint, n{suffix} int, pos{suffix} int")


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity for every pair of classes (id, n, shingles, pivots; a < b) whose Jaccard similarity is at least the threshold."""
    table = classes.sparkSession.sparkContext.broadcast(_counts(classes))
    # of two sets the one of fewer shingles (ties: of smaller id) is the small one
    small = _prefixes(classes, table, lambda n: small_prefix_length(n, threshold), "_s")
    large = _prefixes(classes, table, lambda n: prefix_length(n, threshold), "_l")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_s") + F.col("n_l")) - F.lit(1e-9))
    meets = (
        ((F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("id_s") < F.col("id_l"))))
        & (F.col("n_s") >= F.lit(threshold) * F.col("n_l") - F.lit(1e-9))
        & (F.least(F.col("n_s") - F.col("pos_s"), F.col("n_l") - F.col("pos_l")) >= need)
    )
    pairs = small.hint("merge").join(large, "token").where(meets).groupBy("id_s", "id_l").agg(F.first("n_s").alias("n_s"), F.first("n_l").alias("n_l"))
    # estimates of sizes don't know what a set holds: none of these may be broadcast
    pivots = classes.select("id", "pivots").hint("merge")
    both = pairs.hint("merge").join(pivots.select(F.col("id").alias("id_s"), F.col("pivots").alias("p_s")), "id_s").join(pivots.select(F.col("id").alias("id_l"), F.col("pivots").alias("p_l")), "id_l")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            p, q = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS).astype(np.int16) for i in (4, 5))
            most = n - 2 * np.ceil(threshold / (1 + threshold) * n - 1e-9)  # the most shingles that only one has
            gap = np.abs(p - q)
            keep = (gap.max(axis=1) <= most) & (gap.sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id_s", "id_l"]).filter(pa.array(keep))

    left = cut(both.select("id_s", "id_l", "n_s", "n_l", "p_s", "p_l").mapInArrow(near, "id_s bigint, id_l bigint"))
    sets = classes.select("id", "shingles").hint("merge")
    full = left.hint("merge").join(sets.select(F.col("id").alias("id_s"), F.col("shingles").alias("x")), "id_s").join(sets.select(F.col("id").alias("id_l"), F.col("shingles").alias("y")), "id_l")
    shared = F.size(F.array_intersect("x", "y"))
    scored = full.withColumn("similarity", shared / (F.size("x") + F.size("y") - shared))
    return scored.where(F.col("similarity") >= threshold - 1e-12).select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b"), "similarity")


def near_duplicates(items: DataFrame, key: str, text: str, threshold: float = 0.8, size: int = 5, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has key, id (the class of equal sets); links has a, b, similarity between classes.

    Together they state every pair of keys at or above the threshold: keys of one class, and keys of linked classes.
    Repeated rows of one key and text count once; null keys or texts and texts with fewer words are left out. An empty table gives two empty ones.
    """
    rows = shingled(items, key, text, size, least_words)
    # the class is named by a hash of its digest: 64 bits are compared with the rest of the set when links are verified
    name = F.xxhash64("d1", "d2").alias("id")
    # the texts are read twice, so that the sets of copies needn't be stored beside those of their class
    members = cut(rows.select(key, name).distinct())
    # partitioned by class for good: no later join moves the sets of all classes again
    classes = cut_by(shingled(items, key, text, size, least_words, once=True).select(name, "n", "shingles", "pivots"), "id")
    return members, class_links(classes, threshold)


def _numbered(members: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(sizes, own): how many blocks of about `block` members each class has, and the members with their block."""
    sizes = members.groupBy("id").agg(F.count("*").alias("count"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    return sizes, members.hint("merge").join(sizes.hint("merge"), "id").select("id", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"), F.col(key).alias("k"))


def _side(own: DataFrame, name: str, out: str) -> DataFrame:
    return own.select(F.col("id").alias(name), F.col("block").alias(f"block_{name}"), F.col("k").alias(out)).hint("merge")


def expanded(members: DataFrame, links: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """x, y: the members of linked classes (links has a, b), each pair once.

    Members of a class are numbered off into blocks of about `block`, and blocks are joined: no key of a join has more rows, however
    many copies a text has. Nothing is broadcast, as estimates of sizes don't know how many copies there are.
    """
    sizes, own = _numbered(members, key, block)
    pairs = links.select("a", "b")
    for side in ("a", "b"):
        n = sizes.select(F.col("id").alias(side), F.col("blocks").alias("n")).hint("merge")
        pairs = pairs.hint("merge").join(n, side).withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return pairs.hint("merge").join(_side(own, "a", "x"), ["a", "block_a"]).hint("merge").join(_side(own, "b", "y"), ["b", "block_b"]).select("x", "y")


def pairs(members: DataFrame, links: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """{key}_a < {key}_b: all pairs of keys that are alike; one row per pair, so copies are expanded, block by block (see `expanded`)."""
    linked = expanded(members, links, key, block)
    sizes, own = _numbered(members, key, block)
    each = sizes.where("count > 1").select("id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_a"), "blocks")
    upper = each.select(F.col("id").alias("a"), F.col("id").alias("b"), "block_a", F.explode(F.sequence(F.col("block_a"), F.col("blocks") - 1)).alias("block_b"))
    inner = upper.hint("merge").join(_side(own, "a", "x"), ["a", "block_a"]).hint("merge").join(_side(own, "b", "y"), ["b", "block_b"])
    equal = inner.where((F.col("block_a") < F.col("block_b")) | (F.col("x") < F.col("y"))).select("x", "y")
    return linked.unionByName(equal).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, group: connected components by alternating large-star and small-star rounds; each round is checkpointed.

    Every node's group is the least id of its component. No component is gathered in one place: a round only needs each
    node's least neighbour, an aggregate.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("id").distinct().join(edges.select(F.col("u").alias("id"), "v").hint("merge"), "id", "left").groupBy("id").agg(F.least(F.min("v"), F.col("id")).alias("group"))


def grouped(items: DataFrame, key: str, text: str, threshold: float = 0.8, size: int = 5, least_words: int = 5) -> DataFrame:
    """key, class_id, group_id, links (classes linked to its own) for each text with enough words."""
    members, links = near_duplicates(items, key, text, threshold, size, least_words)
    links = cut(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    found = components(members, links)
    return members.join(found.hint("merge"), "id").join(degree.hint("merge"), "id", "left").select(key, F.col("id").alias("class_id"), F.col("group").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
