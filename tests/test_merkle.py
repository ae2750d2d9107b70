import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from lodestone.incremental import merkle as M

T0 = datetime(2025, 1, 1)


def test_changes_descend_to_what_differs(spark):
    old = {f"k{i}": f"v{i}" for i in range(300)}
    new = {k: ("x" if k in ("k7", "k200") else v) for k, v in old.items() if k != "k9"} | {"n1": "y", "n2": None}
    a, b = (spark.createDataFrame(list(d.items()), "key string, value string") for d in (old, new))
    ta, tb = M.build(a, "key", "value"), M.build(b, "key", "value")
    assert M.changed_leaves(ta, tb).count() <= 5 and M.changed_leaves(ta, ta).count() == 0
    got = {(r.key, r.change) for r in M.changes(a, b, ta, tb, "key", "value").collect()}
    assert got == {("k7", "changed"), ("k200", "changed"), ("k9", "removed"), ("n1", "new"), ("n2", "new")}


def brute(feed, runs):
    good = sorted((s, r) for r, s, status in runs if status == "success" and s is not None)
    out, before = set(), {}
    for start, run in good:
        state = {}
        for seq, key, h, at in sorted((f for f in feed if f[2] is not None and f[1] is not None and f[3] is not None), key=lambda f: (f[3], f[0], f[2])):
            if at <= start:
                state[key] = h
        out |= {(run, k, v) for k, v in state.items() if before.get(k) != v}
        before = state
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_against_brute_force(spark, seed):
    rng = random.Random(seed)
    feed = [(i, rng.choice([None] + [f"c{j}" for j in range(25)]), rng.choice([None, "a", "b", "c"]), rng.choice([None] + [T0 + timedelta(hours=rng.randrange(200))] * 20)) for i in range(400)]
    feed += rng.sample(feed, 30)
    runs = [(f"r{i}", None if i == 5 else T0 + timedelta(hours=rng.randrange(220)), rng.choice(["success", "success", "failed", "aborted"])) for i in range(12)]
    f = spark.createDataFrame(feed, "feed_seq bigint, chunk_id string, content_hash string, arrived_at timestamp").selectExpr("*", "1 AS leaf", "2 AS run_id", "'x' AS before")
    r = spark.createDataFrame(runs, "run_id string, started_at timestamp, status string")
    go = lambda f, r: [tuple(x) for x in M.changes_by_run(f, r, "chunk_id", "content_hash", "arrived_at", ["arrived_at", "feed_seq"]).collect()]
    got = go(f, r)
    assert len(got) == len(set(got)) and set(got) == brute(feed, runs)
    assert go(f.limit(0), r) == [] and go(f, r.limit(0)) == []


def test_runner_survives_failures(spark, tmp_path):
    run = M.Runner(spark, f"{tmp_path}/work", "key", "value")
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")

    def broken(df):
        df.count()
        raise RuntimeError("lost")

    state = {"a": "1", "b": "2"}
    assert run.run(frame(state), lambda d: d) == 1
    state |= {"b": "3", "c": "4"}
    with pytest.raises(RuntimeError):
        run.run(frame(state), broken)
    assert run.committed() == [1]
    assert run.run(frame(state), lambda d: d) == 2
    assert run.run(frame(state), lambda d: d) == 3  # nothing is new
    assert sorted((r.key, r.value, r.change) for r in run.output().collect()) == [("a", "1", "new"), ("b", "2", "new"), ("b", "3", "changed"), ("c", "4", "new")]


@pytest.mark.parametrize("seed", [4])
def test_replay_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    feed = [(i, rng.choice([None] + [f"c{j}" for j in range(25)]), rng.choice([None, "a", "b", "c"]), rng.choice([None] + [T0 + timedelta(hours=rng.randrange(200))] * 20)) for i in range(300)]
    feed += rng.sample(feed, 30)
    runs = [(f"r{i}", None if i == 5 else T0 + timedelta(hours=rng.randrange(220)), rng.choice(["success", "failed", "aborted"])) for i in range(9)]
    f = spark.createDataFrame(feed, "feed_seq bigint, chunk_id string, content_hash string, arrived_at timestamp").selectExpr("*", "1 AS leaf", "2 AS part", "'x' AS __old")
    r = spark.createDataFrame(runs, "run_id string, started_at timestamp, status string")
    go = lambda f, r, n: [tuple(x) for x in M.replay(f, r, f"{tmp_path}/{n}", "chunk_id", "content_hash", "arrived_at", ["arrived_at", "feed_seq"]).collect()]
    got = go(f, r, "a")
    assert len(got) == len(set(got)) and set(got) == brute(feed, runs)
    assert go(f.limit(0), r, "b") == [] and go(f, r.limit(0), "c") == []


@pytest.mark.parametrize("step", ["parquet", "_commit", "rename"])
def test_a_crash_at_any_step_counts_for_nothing(spark, tmp_path, monkeypatch, step):
    from pyspark.sql.readwriter import DataFrameWriter

    folder = f"{tmp_path}/work"
    frame = lambda *rows: spark.createDataFrame(list(rows), "key string, value string, seq int")
    take = lambda run, *rows: run.advance(frame(*rows), ["seq"], lambda d: d)
    assert take(M.Runner(spark, folder, "key", "value"), ("a", "1", 1), ("b", "2", 1)) == 1
    write, calls = DataFrameWriter.parquet, []
    for n in range(3):  # state, tree, output; or the manifest
        with monkeypatch.context() as m:
            if step == "parquet":

                def failing(self, path, *args, n=n, **kw):
                    if "/runs/" in path:
                        calls.append(path)
                        if len(calls) % 4 == n + 1:
                            calls.clear()
                            raise RuntimeError("lost")
                    return write(self, path, *args, **kw)

                calls.clear()
                m.setattr(DataFrameWriter, "parquet", failing)
            elif step == "_commit":
                m.setattr(M.Runner, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            else:
                m.setattr(M, "json", SimpleNamespace(loads=json.loads, dumps=lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))))  # the manifest is created but not finished
            with pytest.raises(RuntimeError):
                take(M.Runner(spark, folder, "key", "value"), ("b", "3", 2), ("c", "4", 2))
        assert M.Runner(spark, folder, "key", "value").committed() == [1]
    run = M.Runner(spark, folder, "key", "value")
    assert take(run, ("b", "3", 2), ("c", "4", 2)) == 2
    assert take(run, ("b", "3", 3), ("c", "4", 3)) == 3  # delivered again: nothing changes
    assert sorted((r.key, r.value, r.change) for r in run.output().collect()) == [("a", "1", "new"), ("b", "2", "new"), ("b", "3", "changed"), ("c", "4", "new")]


def test_two_runs_cannot_take_one_number(spark, tmp_path):
    run = M.Runner(spark, f"{tmp_path}/work", "key", "value")
    run._commit(1, {"work": "x", "parts": {}})
    with pytest.raises(Exception, match="[eE]xist"):
        run._commit(1, {"work": "y", "parts": {}})
    assert run.manifest(1)["work"] == "x" and run.committed() == [1]
