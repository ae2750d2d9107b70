import itertools
import random

from lodestone.llm import split as S


def test_range_maximum():
    rng = random.Random(1)
    v = [rng.randrange(5) for _ in range(97)]
    index = S.RangeMaximum(v)
    for _ in range(500):
        a = rng.randrange(97)
        b = rng.randrange(a, 97)
        best = max(v[a : b + 1])
        assert index.at(a, b) == max(i for i in range(a, b + 1) if v[i] == best)


def check(text, max_lines, max_bytes, overlap):
    out = S.pieces(text, max_lines, max_bytes, overlap)
    lines = S._LINES.findall(text)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    at = 0
    for i, (a, b, t) in enumerate(out):
        assert S.line_count(t) <= max_lines and len(t.encode()) <= max_bytes and b - a + 1 <= max_lines
        place = text.find(t, starts[a])
        assert starts[a] <= place <= starts[b + 1] and place <= at, (i, place, at)
        assert place + len(t) > at or i == 0
        at = place + len(t)
    assert at == len(text)
    return out


def test_pieces_cover_and_keep_limits():
    rng, unique = random.Random(2), itertools.count(1_000_000)
    for _ in range(150):
        n = rng.randrange(1, 120)
        text = "".join(rng.choice(["", "    ", "def f():", "x = [1,", "}", "é" * rng.randrange(40), "".join(f"{next(unique)};b " for _ in range(rng.randrange(60)))]) + f"{next(unique)}" + rng.choice(["\n", "\r\n", "\r"]) for _ in range(n)) + rng.choice(["", "end"])
        check(text, rng.choice([5, 20, 150]), rng.choice([60, 300, 8000]), rng.choice([0, 3, 15]))


def test_overlap_and_boundaries():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 18 + "\n" for i in range(40))
    out = check(text, 150, 8000, 15)
    for (a, b, _), (c, _, _) in zip(out, out[1:]):
        assert b - c + 1 == 15
    assert all(t.endswith("\n\n") for _, _, t in out[:-1])  # cut at the blank lines before declarations
    assert S.pieces("a\n" * 150) == [(0, 149, "a\n" * 150)] and len(S.pieces("a\n" * 151)) == 2
    long = S.pieces("x" * 20_000)
    assert [len(t) for _, _, t in long] == [8000, 8000, 4000] and all((a, b) == (0, 0) for a, b, _ in long)


def test_tables(spark):
    rows = [("a", 7, "x\n" * 200), ("a", 7, "x\n" * 200), ("b", None, "é" * 4001), ("c", 1, "x\n" * 150), ("d", 1, None), ("e", 1, ""), ("f", 1, "x\r\n" * 149 + "y"), ("g", 1, "ab cd " * 300_000)]
    df = spark.createDataFrame(rows, "chunk_id string, start_line int, content string").selectExpr("*", "0 AS piece_no", "1 AS n_lines")
    out = S.split(df).collect()
    assert {r.chunk_id for r in out} == {"a", "b", "g"}
    a = sorted((r.piece_no, r.start_line, r.end_line) for r in out if r.chunk_id == "a")
    assert a[0][1] == 7 and a[-1][2] == 206 and len(a) == 2
    assert S.split(df, keep_small=True).where("piece_no = 0").count() == 6
    assert S.split(df.limit(0)).count() == 0
