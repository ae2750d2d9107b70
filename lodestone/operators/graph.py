"""Dependency graph: edges, degrees, reachability, cycles, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def first_edges(edges: DataFrame, order: list[str], key: tuple[str, ...] = ("src", "dst", "kind")) -> DataFrame:
    """Of edges with equal ends and kind the first by `order`."""
    return edges.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def digraph(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per pair of ends, with the attributes of the last by `order`."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select("src", "dst", "e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return out.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def high_coupling(edges: DataFrame, least: int = 10) -> DataFrame:
    return degrees(edges).where(F.col("n_out") >= least).select("node", "n_out")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density."""
    n, e = nodes.agg(F.count_distinct("node").alias("nodes")), edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    both = n.join(F.broadcast(e))  # one row each
    return both.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9)).otherwise(F.lit(0.0)))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hops: all nodes within `depth` hops of each seed (by breadth, so by the least hops)."""
    e = edges.select("src", "dst").distinct()
    found = frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop))
        if hop < depth:
            frontier = cut(frontier)
        found = found.unionByName(frontier)
    return found


def dependents(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hops: what leads to each seed within `depth` hops."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth)


def cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """cycle (nodes joined by '>', the least first), length: the elementary cycles of up to `longest` nodes, self loops included.

    Paths start at their least node and only visit greater ones, so each cycle appears once. The number of cycles grows
    exponentially with the length, which is why that is bounded.
    """
    e = edges.select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.array("src").alias("path"))
    up = e.where("src <> dst")
    paths, out = up.where("src < dst").select(F.array("src", "dst").alias("path")), [loops]
    for n in range(2, longest + 1):
        ends = paths.withColumn("last", F.element_at("path", -1)).join(up, F.col("last") == F.col("src"))
        out.append(ends.where(F.col("dst") == F.col("path")[0]).select("path"))
        if n < longest:
            paths = ends.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return reduce(DataFrame.unionByName, out).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), F.size("path").alias("length"))


def blast_radius(edges: DataFrame) -> DataFrame:
    """node, radius: how many other nodes a node calls or is called by."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("radius"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Calls between presentation and data in either direction, both ends of one layer only, or across domains where no layer is known.

    `layers` has node, layer, labels (how many labels it has).
    """
    a, b = (layers.select(F.col("node").alias(k), F.col("layer").alias(f"{k}_layer"), F.col("labels").alias(f"{k}_labels")) for k in ("src", "dst"))
    j = edges.where(F.col("kind") == "CALLS").join(a, "src").join(b, "dst").where("src_labels <= 1 AND dst_labels <= 1")
    wrong = ((F.col("src_layer") == "presentation") & (F.col("dst_layer") == "data")) | ((F.col("src_layer") == "data") & (F.col("dst_layer") == "presentation"))
    unknown = (F.col("src_layer") == "unknown") & (F.col("dst_layer") == "unknown") & F.col("cross_domain")
    return j.where(wrong | unknown).select("src", "dst", "src_layer", "dst_layer")
