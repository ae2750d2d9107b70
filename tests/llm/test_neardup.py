import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import neardup as N


def shingles(text, size, least):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text or "", re.A)]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= least else None


def brute(rows, threshold, size, least):
    s = {k: v for k, v in ((k, shingles(t, size, least)) for k, t in rows) if v}
    keys = sorted(s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-12}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(28, 90))]
        rows.append((f"b{i}", " ".join(base)))
        for j in range(rng.randrange(4)):
            edit = base[:]
            for _ in range(rng.randrange(0, 9)):
                at = rng.randrange(len(edit))
                edit[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            rows.append((f"b{i}_{j}", ". ".join(edit).title()))
    return rows


@pytest.mark.parametrize(("threshold", "size", "least"), [(0.6, 3, 30), (0.8, 5, 5)])
def test_no_pair_is_lost(spark, threshold, size, least):
    rows = corpus(3)
    df = spark.createDataFrame(rows + rows[:9], "chunk_id string, content string").selectExpr("*", "1 AS id", "2 AS n")
    members, links = N.near_duplicates(df, "chunk_id", "content", threshold, size, least)
    got = [tuple(r) for r in N.pairs(members, links, "chunk_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, size, least) and len(got) > 20


def test_hot_group_is_one_class(spark):
    same = [(f"k{i:04}", "the very same words again and again " * 5) for i in range(500)]
    df = spark.createDataFrame(same + [("z", "the very same words again and again " * 5 + "but one")], "chunk_id string, content string")
    members, links = N.near_duplicates(df, "chunk_id", "content", 0.6, 3, 5)
    assert members.select("id").distinct().count() == 2 and links.count() == 1
    g = N.grouped(df, "chunk_id", "content", 0.6, 3, 5)
    assert g.count() == 501 and g.select("group_id").distinct().count() == 1


def test_edges(spark):
    text = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([("a", text), ("b", text.upper() + "."), ("c", None), ("d", ""), (None, text), ("e", "few words"), ("f", "x " * 300_000)], "chunk_id string, content string")
    members, links = N.near_duplicates(df, "chunk_id", "content", 0.6, 3, 30)
    assert {tuple(r) for r in N.pairs(members, links, "chunk_id").collect()} == {("a", "b")}
    members, links = N.near_duplicates(df.limit(0), "chunk_id", "content", 0.6, 3, 30)
    assert N.pairs(members, links, "chunk_id").count() == 0


def test_pivots_bound_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: rng.integers(0, 80)], b[: rng.integers(1, 80)]]))
        p, q = (np.bincount((s >> np.uint64(58)).astype(int), minlength=64) for s in (a, b))
        assert np.abs(p - q).max() <= np.abs(p - q).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(130)) if a != b] + [(i, i + 1) for i in range(300, 380)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(400).withColumnRenamed("id", "id")
    links = spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint")
    got = {r.id: r.group for r in N.components(nodes, links).collect()}
    least = defaultdict(lambda: 10**9)
    for x in parent:
        least[root(x)] = min(least[root(x)], x)
    assert got == {i: least[root(i)] if i in parent else i for i in range(400)}


def test_blocks_give_each_pair_once(spark):
    members = spark.createDataFrame([(f"a{i:02}", 1) for i in range(23)] + [(f"b{i}", 2) for i in range(4)] + [("c", 3)], "chunk_id string, id bigint")
    links = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.7)], "a bigint, b bigint, similarity double")
    got = [tuple(r) for r in N.pairs(members, links, "chunk_id", block=5).collect()]
    assert len(got) == len(set(got)) == 23 * 22 // 2 + 4 * 3 // 2 + 23 * 4 + 4 and all(a < b for a, b in got)
    assert "Broadcast" not in N.pairs(members, links, "chunk_id")._jdf.queryExecution().executedPlan().toString()
