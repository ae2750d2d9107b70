import re
import textwrap

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import parsers, review, rules, telemetry
from lodestone.sources import corpus


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\x0bc d\n") == ["a", "b", "c", "d"] and one(spark, T.lines(F.col("t")), t="") == []
    assert one(spark, T.tokens(F.col("t")), t="HTTPSClient get_access_token UserAuthService2 v10") == ["https", "client", "get", "access", "token", "user", "auth", "service", "10"]
    import uuid

    want = str(uuid.uuid5(uuid.UUID(T.CHUNK_NAMESPACE), "\x1f".join(["o__r", "a/b.py", "function", "foo", "42"])))
    assert one(spark, T.uuid5(*map(F.col, "abcde")), a="o__r", b="a/b.py", c="function", d="foo", e="42") == want
    assert one(spark, T.repo_slug(F.col("t")), t="https://github.com/own/name.git") == "own__name"
    assert one(spark, T.category(F.col("t")), t="Error Handling/IO Rules") == "error_handling_io" and one(spark, T.severity(F.col("t")), t="odd") == "INFO"
    assert one(spark, T.html_escaped(F.col("t")), t="<a b='c'>&") == "&lt;a b=&#39;c&#39;&gt;&amp;"
    assert one(spark, T.tabs_expanded(F.col("t")), t="a\tb") == "a\tb".expandtabs(4) and one(spark, T.wrapped(F.col("t")), t="word " * 40) == "\n".join(textwrap.wrap("word " * 40, 72))
    assert one(spark, T.head_lines(F.col("t"), 2), t="a\nb\nc") == "a\nb\n... (3 lines total)"


CHUNKS = [
    ("p", "python", "function", "f", "def f(self, a, b: Dict[str, int], c=(1, 2), *d, e, g):\n    pass\n", 1), ("q", "python", "function", "g", "def g(self, a, b, c, d, e):\n    pass\n", 0), ("r", "kotlin", "method", "h", "fun h(a: Map<String, Int>, b: Int, c: Int, d: Int, e: Int, f: Int) {}", 1), ("s", "go", "function", "k", "no signature", 0),
]


def test_parameter_rule(spark):
    df = spark.createDataFrame([(c[0], "src/a", c[1], c[2], c[3], 5, c[4], None) for c in CHUNKS], "chunk_id string, file_path string, language string, chunk_type string, symbol_name string, start_line int, content string, parent_symbol string")
    got = {r.chunk_id for r in rules.violations(df, tuple(r for r in rules.RULES if r.rule_id == "CP013")).collect()}
    assert got == {c[0] for c in CHUNKS if c[5]}


def test_golden_rules(spark):
    rows = [
        ("secret", "app/golden/x.py", "python", "function", 'def f():\n    api_key = "sk-live-123456"\n', {"SEC001"}), ("tests", "tests/x.py", "python", "function", 'def f() -> int:\n    api_key = "sk-live-123456"\n', set()), ("magic", "a.py", "python", "function", "def f(x: int) -> bool:\n    if x > 37:\n        return True\n", {"GEN002"}),
        ("clean", "a.py", "python", "function", "def f(x: int) -> int:\n    return x + 1\n", set()), ("hints", "a.py", "python", "function", "def f(x):\n    return x\n", {"PY001"}), ("swift", "a/FooViewController.swift", "swift", "method", "func f() {\n  URLSession.shared.dataTask(with: u)\n}\n", {"SW008"}),
        ("dart", "a.dart", "dart", "method", "f() async {\n  await g();\n  use(context);\n  await g();\n  if (!mounted) return;\n  use(context);\n}\n", {"DA008"}), ("long", "a.go", "go", "function", "x()\n" * 51, {"GEN001"}), ("module", "a.py", "python", "module", 'secret = "abcdef"', set()), ("null", "a.py", "python", "function", None, set()), ("empty", None, "python", "function", "", set()),
    ]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], "f", None, r[4], None) for r in rows], "chunk_id string, file_path string, language string, chunk_type string, symbol_name string, start_line int, content string, parent_symbol string")
    got = {}
    for r in rules.violations(df).collect():
        got.setdefault(r.chunk_id, set()).add(r.rule_id)
    extra = {"secret": {"PY001"}}
    assert {r[0]: got.get(r[0], set()) for r in rows} == {r[0]: r[5] | extra.get(r[0], set()) for r in rows}
    assert {r.line for r in rules.violations(df).where("rule_id = 'DA008'").collect()} == {3}


def test_consensus_against_brute_force(spark):
    import random

    rank = {s: i for i, s in enumerate(T.SEVERITIES)}

    def brute(issues):
        out, taken = [], set()
        for a in sorted(issues, key=lambda x: (x[1], x[2])):
            if a[2] in taken:
                continue
            near = [x for x in issues if x[2] not in taken and abs(x[1] - a[1]) <= 3]
            agents = {x[3] for x in near}
            if len(agents) >= 2:
                w = min(near, key=lambda x: (rank[x[4]], x[1], x[2]))
                out.append((w[1], w[2], round(min(1.0, w[5] + 0.15), 6), ",".join(sorted(agents - {w[3]}))))
                taken |= {x[2] for x in near}
            else:
                out.append((a[1], a[2], round(a[5], 6), ""))
                taken.add(a[2])
        return sorted(out)

    rng = random.Random(9)
    rows = [(f"f{rng.randrange(8)}", rng.randrange(60), i, rng.choice("abc"), rng.choice(T.SEVERITIES), rng.randrange(50, 100) / 100) for i in range(250)]
    df = spark.createDataFrame(rows, "file string, line int, seq bigint, agent string, severity string, confidence double")
    got = {}
    for r in review.consensus(df, "file").collect():
        got.setdefault(r.file, []).append((r.line, r.seq, round(r.confidence, 6), r.others))
    assert {k: sorted(v) for k, v in got.items()} == {f: brute([r for r in rows if r[0] == f]) for f in {r[0] for r in rows}}


SOURCES = {
    "python": ("import os\nimport re\n\n\n\nfrom a import b\n\n@dec(1)\ndef f(x):\n    g(x)\n    self.h()\n    print(x)\n\nclass A(B):\n    '''doc'''\n\n    @p\n    def m(self):\n        def inner():\n            k()\n        return inner()\n\n    def __repr__(self):\n        return ''\n",
               [("import", "imports", None), ("import", "imports", None), ("function", "f", None), ("class_head", "A", None), ("method", "m", "A")]),
    "swift": ("import A\n\nclass V: UIViewController, D {\n    // func no() {\n    class func make() -> V { return V() }\n    func load(_ x: Int) {\n        api.fetch(x)\n    }\n}\n", [("import", "imports", None), ("class_head", "V", None), ("method", "make", "V"), ("method", "load", "V")]),
    "kotlin": ("package a\nimport b.c\n\ndata class A(val x: Int) : B(x) {\n    @Inject\n    fun m(a: Int): Int {\n        return n(a)\n    }\n}\n\nfun top() = 1\n", [("import", "imports", None), ("class_head", "A", None), ("method", "m", "A"), ("function", "top", None)]),
    "rust": ("use std::io;\n\npub struct S<'a> { x: &'a str }\n\nimpl S {\n    pub async fn m(&self) -> u8 {\n        b'}'\n    }\n}\n", [("import", "imports", None), ("class_head", "S", None), ("method", "m", "S")]),
    "dart": ("import 'a.dart';\n\nclass W extends StatelessWidget {\n  @override\n  Widget build(BuildContext c) {\n    return Text('}');\n  }\n}\n", [("import", "imports", None), ("class_head", "W", None), ("method", "build", "W")]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_parsers(spark, language):
    text, want = SOURCES[language]
    assert [(s.kind, s.name, s.parent) for s in parsers.parse(language, text)] == want
    df = spark.createDataFrame([(1, language, text), (2, language, None), (3, "cobol", text), (4, language, ""), (5, language, "(" * 50)], "file_id bigint, language string, content string")
    got = parsers.symbols(df).where("file_id = 1").orderBy("seq").collect()
    assert [(r.kind, r.name, r.parent) for r in got] == want and all(r.start_line <= r.end_line for r in got)
    cache = parsers.symbols(df).join(df.select("file_id", F.md5("content").alias("content_md5")), "file_id")
    assert parsers.cached_symbols(df, cache).count() == parsers.symbols(df).count()


def test_python_calls():
    f = parsers.parse("python", SOURCES["python"][0])[2]
    assert sorted(f.calls) == ["dec", "g", "self.h"] and f.decorators == ("@dec(1)",) and (f.start, f.end) == (9, 12)


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "x.PY").write_text("a = 1\r\nb = 2\n")
    (tmp_path / "src" / "bin.dat").write_bytes(b"\x00\xff")
    files = corpus.with_lines(corpus.scan(spark, str(tmp_path / "src"), "o__r"))
    got = {r.path: (r.extension, r.raw_lines, r.size_bytes) for r in files.collect()}
    assert got["a/x.PY"] == (".py", ["a = 1", "b = 2"], 13) and got["bin.dat"][0] == ".dat"
    corpus.record_event(spark, f"{tmp_path}/log", "r1", "stage_start", name="x", odd=object())
    corpus.record_event(spark, f"{tmp_path}/log", "r1", "stage_end", ms=3)
    (tmp_path / "log" / "broken.json").write_text("{nope\n\n")
    assert [r.run_id for r in corpus.read_events(spark, f"{tmp_path}/log", "stage_end").collect()] == ["r1"] and corpus.read_events(spark, f"{tmp_path}/log").count() == 2
    c = spark.createDataFrame([("c1", "o__r", "x")], "chunk_id string, repo_name string, content string")
    for fmt in ("parquet", "json"):
        corpus.write_chunks(c, f"{tmp_path}/c_{fmt}", fmt)
        back = corpus.read_chunks(spark, f"{tmp_path}/c_{fmt}", {"chunk_id": "string", "repo_name": "string", "layer": "string"}, fmt).first()
        assert (back.chunk_id, back.repo_name, back.layer) == ("c1", "o__r", None)
    old, new = (spark.createDataFrame(x, "k string, h string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted(map(tuple, corpus.merged(old, new, ["k"]).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert sorted(map(tuple, corpus.patched(old, new, "k", ["h"]).collect())) == [("a", "1"), ("b", "3")]


def test_evaluation(spark):
    f = spark.createDataFrame([("x", "A", "HIGH"), ("x", "B", "LOW"), ("x", "C", None)], "case_id string, rule_id string, severity string")
    m = spark.createDataFrame([("x", "A", None), ("x", "D", "LOW")], "case_id string, rule_id string, severity string")
    n = spark.createDataFrame([("x", "B", "LOW")], "case_id string, rule_id string, severity string")
    r = telemetry.scores(telemetry.evaluated(f, m, n)).first()
    assert (r.tp, r.fn, r.fp, r.unexpected, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5)


def test_streaming(spark, tmp_path):
    from lodestone.streaming import events as E

    rows = [(i, f"2025-01-01 {i // 6:02}:{i % 6 * 10:02}:00", i % 3, "click", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    s = E.windowed(E.source(spark, f"{tmp_path}/in"), "1 hour").writeStream.format("memory").queryName("w").outputMode("append")
    q = s.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] >= 36  # the last windows wait for the watermark
    q = E.source(spark, f"{tmp_path}/in").select("event_id", "value").writeStream.foreachBatch(E.upsert_to(f"{tmp_path}/t", ["event_id"])).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = E.versions(spark, f"{tmp_path}/t")[-1]
    assert spark.read.parquet(f"{tmp_path}/t/v{last}").count() == 60
    assert E.sessions(df, "15 minutes").count() == 60


def test_package_names_no_training_text():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lodestone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"lodestone\.llm", p.read_text()), p


def test_long_parts(spark):
    import random

    from lodestone.operators.context import long_parts

    rng = random.Random(3)
    rows = [(f"s{i}", rng.randrange(1, 50), n) for i, n in enumerate([151, 160, 300, 1000, 2345, 100])]
    s = spark.createDataFrame([(k, a, a + n - 1) for k, a, n in rows], "chunk_id string, start_line int, end_line int")
    blanks = {k: sorted(rng.sample(range(a, a + n), n // 12)) for k, a, n in rows if k != "s1"}
    b = spark.createDataFrame(list(blanks.items()), "chunk_id string, lines array<int>")
    out = {}
    for r in long_parts(s, b).orderBy("chunk_id", "part").collect():
        out.setdefault(r.chunk_id, []).append((r.part_start, r.part_end))
    assert set(out) == {"s0", "s1", "s2", "s3", "s4"}
    for k, a, n in rows[:5]:
        p = out[k]
        assert p[0][0] == a and p[-1][1] == a + n - 1 and all(y - x < 150 for x, y in p)
        assert all(c == y - 14 for (_, y), (c, _) in zip(p, p[1:])) and all(y in blanks.get(k, []) or y == x + 149 for x, y in p[:-1])
