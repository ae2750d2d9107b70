"""Change detection with Merkle trees over key ranges, for processing only what is new or changed.

Keys are hashed to leaves; a leaf's digest is the exclusive or of its records' hashes (128 bits in two halves), a
node's that of its children. Two states are compared from the root: only nodes whose digests differ are descended into,
and records are compared in the changed leaves alone. `Runner` publishes a run's output together with its state and tree;
`replay` does so for all runs over a feed, `changes_by_run` gives their rows at once, by the trees' differences.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def leaf_of(key: str, fanout_bits: int, levels: int) -> Column:
    """The leaf (key range) of a record: the top fanout_bits * levels bits of its key's hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("leaf"), F.col(key)), 64 - fanout_bits * levels)


def record_hashes(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a record; nulls are told from empty strings."""
    cols = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)


def build(state: DataFrame, key: str, value: str, fanout_bits: int = 4, levels: int = 4) -> DataFrame:
    """level, node, d1, d2, n: the tree of a state (one row per key); level 0 is the root, `levels` the leaves."""
    one, two = record_hashes(key, value)
    leaves = state.groupBy(leaf_of(key, fanout_bits, levels).alias("node")).agg(F.bit_xor(one).alias("d1"), F.bit_xor(two).alias("d2"), F.count("*").alias("n"))  # at most 2 ** (fanout_bits * levels) rows
    return tree_of(leaves, fanout_bits, levels)


def tree_of(leaves: DataFrame, fanout_bits: int, levels: int) -> DataFrame:
    """level, node, d1, d2, n: the tree over its leaves (node, d1, d2, n), all levels by one aggregation."""
    above = F.array(*(F.struct(F.lit(at).alias("level"), F.shiftright("node", fanout_bits * (levels - at)).alias("node")) for at in range(levels + 1)))
    spread = leaves.select(F.explode(above).alias("at"), "d1", "d2", "n")
    return spread.groupBy("at.level", "at.node").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))


def _level(leaves: DataFrame, fanout_bits: int, levels: int, at: int, *more: str) -> DataFrame:
    node = F.shiftright(F.col("node"), fanout_bits * (levels - at))
    return leaves.groupBy(*more, node.alias("node")).agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n")).withColumn("level", F.lit(at))


#: Up to so many nodes of a level (8 bytes each) are kept by the driver while it descends; wider levels stay distributed.
FEW_NODES = 4096


def changed_leaves(saved: DataFrame, current: DataFrame, fanout_bits: int = 4, levels: int = 4) -> DataFrame:
    """node of the leaves whose digests differ (or that one side lacks), found by descending from the root."""
    open_nodes = None
    for at in range(levels + 1):
        a, b = (t.where(F.col("level") == at) for t in (saved, current))
        if isinstance(open_nodes, list):
            a, b = (t.where(F.shiftright("node", fanout_bits).isin(open_nodes)) for t in (a, b))
        elif open_nodes is not None:
            a, b = (t.join(open_nodes, F.shiftright(t["node"], fanout_bits) == open_nodes["parent"], "left_semi") for t in (a, b))
        # one row a node and side: equal sides leave nothing
        sides = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).groupBy("node")
        differ = sides.agg(F.count("*").alias("c"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.bit_xor("n").alias("n")).where("c < 2 OR d1 <> 0 OR d2 <> 0 OR n <> 0").select(F.col("node").alias("parent"))
        if at < levels and fanout_bits * at <= FEW_NODES.bit_length() - 1:
            open_nodes = [r["parent"] for r in differ.collect()]
        else:
            # few rows; without the cut each level would plan the one above twice
            open_nodes = cut(differ)
    return open_nodes.select(F.col("parent").alias("node"))


def changes(saved: DataFrame, current: DataFrame, saved_tree: DataFrame, current_tree: DataFrame, key: str, value: str, fanout_bits: int = 4, levels: int = 4) -> DataFrame:
    """key, value, change ('new', 'changed', 'removed'): records are compared only within the leaves that differ."""
    leaves = changed_leaves(saved_tree, current_tree, fanout_bits, levels)
    return _differences(*(t.withColumn("node", leaf_of(key, fanout_bits, levels)).join(leaves, "node", "left_semi") for t in (saved, current)), key, value)


def _differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, change of what two states (one row per key) differ in."""
    a = a.select(key, F.col(value).alias("__old"), F.lit(True).alias("__had"))
    both = a.join(b.select(key, value, F.lit(True).alias("__has")), key, "full_outer")
    kind = F.when(F.col("__had").isNull(), "new").when(F.col("__has").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col(value)), "changed")
    return both.withColumn("change", kind).where(F.col("change").isNotNull()).select(key, value, "change")


def latest(feed: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The state after all rows of a feed: per key the value of the last row by `order` among those with a value."""
    return feed.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def changes_by_run(feed: DataFrame, runs: DataFrame, key: str, value: str, at: str, order: list[str], fanout_bits: int = 4, levels: int = 4) -> DataFrame:
    """run_id, key, value: for each successful run the keys whose state at its start is new or differs from the run's before.

    The trees of all runs are built in one pass: a digest only ever changes by what a run's records replace, so the
    exclusive or of old and new hashes in a node is the difference between its digests at the run and the run before.
    It is zero where the trees agree; nodes are descended only where it is not, and records are compared in the leaves
    that remain. `runs` has run_id, started_at, status; runs that start at the same time keep the order of run_id.

    A null or late value never counts; a null key, a null time and rows after the last run neither. Repeated rows change nothing.
    Ties in `order` between different values: the greater value. Without successful runs or rows the result is empty.
    """
    good = runs.where((F.col("status") == "success") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct()
    found = good.orderBy("started_at", "run_id").collect()  # one short row a run
    spark = feed.sparkSession
    if not found:
        return feed.limit(0).select(F.lit("").alias("run_id"), key, value)
    starts = F.array(*(F.lit(r["started_at"]) for r in found))
    names = spark.createDataFrame([(i, r["run_id"]) for i, r in enumerate(found, 1)], "run int, run_id string")
    rows = feed.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull() & (F.col(at) <= F.lit(found[-1]["started_at"])))
    # the first run that sees a row
    seen = rows.withColumn("run", F.size(F.filter(starts, lambda s: s < F.col(at))) + 1)
    last = seen.groupBy(key, "run").agg(F.max_by(F.col(value), F.struct(*order, value)).alias(value))
    versions = last.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy("run"))).withColumn("leaf", leaf_of(key, fanout_bits, levels))
    versions = cut(versions)
    new, old = record_hashes(key, value), record_hashes(key, "before")
    had = F.col("before").isNotNull()
    delta = versions.groupBy("run", F.col("leaf").alias("node")).agg(
        *(F.bit_xor(n.bitwiseXOR(F.when(had, o).otherwise(F.lit(0).cast("bigint")))).alias(d) for n, o, d in zip(new, old, ("d1", "d2"))), F.count("*").alias("n")
    )
    open_nodes = None
    for level in range(levels + 1):
        nodes = _level(delta, fanout_bits, levels, level, "run").where((F.col("d1") != 0) | (F.col("d2") != 0))
        if open_nodes is not None:
            nodes = nodes.withColumn("parent", F.shiftright("node", fanout_bits)).join(open_nodes, ["run", "parent"], "left_semi")
        open_nodes = nodes.select("run", F.col("node").alias("parent"))
    leaves = open_nodes.withColumnRenamed("parent", "leaf")
    hits = versions.join(leaves, ["run", "leaf"], "left_semi").where(~F.col(value).eqNullSafe(F.col("before")))
    return hits.join(F.broadcast(names), "run").select("run_id", key, value)


class Runner:
    """Runs that process only what is new or changed since the last success.

    A run writes its output, its tree and the key ranges of the state that it touched into a folder of its own, and then
    commits by renaming a finished manifest to its number, which fails if another run was faster. The manifest says where each key range
    of the state stands, so untouched ranges stay where earlier runs wrote them. A run that dies at any step before the rename leaves
    nothing that counts; the next one starts from the last manifest: no record is skipped and none is published twice.

    The file system must rename atomically, as HDFS and local ones do. `part_bits` sets how many key ranges (files' folders) the state has.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, value: str, fanout_bits: int = 8, levels: int = 2, part_bits: int = 4):
        self.spark, self.folder, self.key, self.value, self.bits, self.levels, self.part_bits = spark, folder.rstrip("/"), key, value, fanout_bits, levels, part_bits
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        ready = self._path(f"{self.folder}/manifests/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(ready, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        sc = self.spark.sparkContext
        options = sc._jvm.org.apache.hadoop.fs.Options
        none = sc._gateway.new_array(getattr(options, "Rename"), 0)
        # without the option to overwrite, the rename fails if the number is taken
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(ready, self._path(f"{self.folder}/manifests/{number}.json"), none)

    def _leaf(self) -> Column:
        return leaf_of(self.key, self.bits, self.levels)

    def _part(self, leaf: str) -> Column:
        return F.shiftrightunsigned(F.col(leaf), self.bits * self.levels - self.part_bits).cast("int")

    def _saved(self, manifest: dict, parts: list[int], like: DataFrame) -> DataFrame:
        """key, value of the saved state, of some key ranges only."""
        paths = [f"{manifest['parts'][str(p)]}/state/part={p}" for p in parts if str(p) in manifest["parts"]]
        like = like.select(self.key, self.value)
        return self.spark.read.schema(like.schema).parquet(*paths).select(self.key, self.value) if paths else like.limit(0)

    def _last(self) -> tuple[int, dict, DataFrame | None]:
        done = self.committed()
        if not done:
            return 0, {"parts": {}}, None
        manifest = self.manifest(done[-1])
        return done[-1], manifest, self.spark.read.parquet(f"{manifest['work']}/tree")

    def _begin(self, number: int) -> str:
        return f"{self.folder}/runs/{number}-{uuid.uuid4().hex[:8]}"

    def _publish(self, number: int, work: str, base: dict, parts: list[int], kept: list[int], output: DataFrame) -> int:
        output.write.parquet(f"{work}/output")
        where = {p: w for p, w in base["parts"].items() if int(p) not in parts} | {str(p): work for p in kept}
        self._commit(number, {"work": work, "parts": where})
        return number

    def run(self, current: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Processes the changes of `current` (the whole state, one row per key) against the last committed state; the run's number.

        Output: what `process` makes of key, value, change ('new', 'changed', 'removed').
        """
        last, base, saved_tree = self._last()
        work = self._begin(last + 1)
        now = current.select(self.key, self.value)
        build(now, self.key, self.value, self.bits, self.levels).write.parquet(f"{work}/tree")
        tree = self.spark.read.parquet(f"{work}/tree")
        leaves = changed_leaves(tree.limit(0) if saved_tree is None else saved_tree, tree, self.bits, self.levels)
        parts = self._numbers(leaves.select(self._part("node").alias("part")))
        own = now.withColumn("leaf", self._leaf()).withColumn("part", self._part("leaf"))
        own.where(F.col("part").isin(parts)).drop("leaf").write.partitionBy("part").parquet(f"{work}/state")
        kept = self._written(work)
        state = self._saved({"parts": {str(p): work for p in kept}}, kept, now)
        saved = self._saved(base, parts, now)
        return self._publish(last + 1, work, base, parts, kept, process(self._compared(saved, state, leaves)))

    def advance(self, rows: DataFrame, order: list[str], process: Callable[[DataFrame], DataFrame]) -> int:
        """Processes what `rows`, everything that arrived since the last committed run, changes in the state; the run's number.

        Of several rows for one key the last by `order` counts (ties: the greater value). Only key ranges that rows fall into are read and
        written again; the digests of all other leaves are taken over from the saved tree. Null keys and values are left out.
        """
        last, base, saved_tree = self._last()
        work = self._begin(last + 1)
        rows = rows.where(F.col(self.key).isNotNull() & F.col(self.value).isNotNull())
        new = cut(rows.groupBy(self.key).agg(F.max_by(F.col(self.value), F.struct(*order, self.value)).alias(self.value)).withColumn("leaf", self._leaf()))
        parts = self._numbers(new.select(self._part("leaf").alias("part")))
        saved = self._saved(base, parts, new)
        merged = saved.withColumnRenamed(self.value, "__old").hint("merge").join(new.drop("leaf").hint("merge"), self.key, "full_outer")
        merged = merged.select(self.key, F.coalesce(self.value, "__old").alias(self.value), self._leaf().alias("leaf"))
        merged.withColumn("part", self._part("leaf")).drop("leaf").write.partitionBy("part").parquet(f"{work}/state")
        kept = self._written(work)
        state = self._saved({"parts": {str(p): work for p in kept}}, kept, new)
        one, two = record_hashes(self.key, self.value)
        fresh = state.groupBy(self._leaf().alias("node")).agg(F.bit_xor(one).alias("d1"), F.bit_xor(two).alias("d2"), F.count("*").alias("n"))
        if saved_tree is not None:
            fresh = fresh.unionByName(saved_tree.where((F.col("level") == self.levels) & ~self._part("node").isin(parts)).drop("level"))
        tree_of(fresh, self.bits, self.levels).write.parquet(f"{work}/tree")
        tree = self.spark.read.parquet(f"{work}/tree")
        leaves = changed_leaves(tree.limit(0) if saved_tree is None else saved_tree, tree, self.bits, self.levels)
        return self._publish(last + 1, work, base, parts, kept, process(self._compared(saved, state, leaves)))

    def _compared(self, saved: DataFrame, state: DataFrame, leaves: DataFrame) -> DataFrame:
        """key, value, change: records are compared only within the leaves that differ."""
        return _differences(*(t.withColumn("node", self._leaf()).join(leaves, "node", "left_semi") for t in (saved, state)), self.key, self.value)

    def _numbers(self, parts: DataFrame) -> list[int]:
        return sorted(r["part"] for r in parts.distinct().collect())  # at most 2 ** part_bits

    def _written(self, work: str) -> list[int]:
        at = self._path(f"{work}/state")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[5:]) for n in names if n.startswith("part="))

    def output(self) -> DataFrame:
        """The outputs of all committed runs."""
        works = [self.manifest(n)["work"] for n in self.committed()]
        return self.spark.read.parquet(*(f"{w}/output" for w in works))


def replay(feed: DataFrame, runs: DataFrame, folder: str, key: str, value: str, at: str, order: list[str], fanout_bits: int = 8, levels: int = 2, part_bits: int = 4) -> DataFrame:
    """As `changes_by_run`, by the runs themselves: each advances the saved state by what arrived since the run before.

    A run reads the feed's rows of its own interval and the key ranges of the state they fall into, compares its tree with the saved one from the
    root, reads the leaves that differ, and publishes output, state and tree together in `folder` (new or empty).
    """
    good = runs.where((F.col("status") == "success") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct()
    found = good.orderBy("started_at", "run_id").collect()  # one short row a run
    if not found:
        return feed.limit(0).select(F.lit("").alias("run_id"), key, value)
    spark = feed.sparkSession
    starts = F.array(*(F.lit(r["started_at"]) for r in found))
    rows = feed.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull() & (F.col(at) <= F.lit(found[-1]["started_at"])))
    # the feed is laid out once by the run that sees a row first, as a feed that arrives in folders would be
    seen = rows.select(*dict.fromkeys([key, value, *order]), (F.size(F.filter(starts, lambda s: s < F.col(at)))).alias("__run"))
    seen.write.partitionBy("__run").parquet(f"{folder}/arrivals")
    runner, schema = Runner(spark, folder, key, value, fanout_bits, levels, part_bits), seen.drop("__run").schema
    for i, r in enumerate(found):
        path, fs = runner._path(f"{folder}/arrivals/__run={i}"), runner._fs
        arrived = spark.read.schema(schema).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], schema)
        runner.advance(arrived, order, lambda d, name=r["run_id"]: d.select(F.lit(name).alias("run_id"), key, value))
    return runner.output()
