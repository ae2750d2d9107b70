import json
import textwrap

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import flow as W
from lodestone.operators import reporting as O
from lodestone.operators import standards
from lodestone.sources import stores

ISSUE = "chunk_id string, rule_id string, severity string, title string, description string, file_path string, start_line int, end_line int, suggestion string, language string, category string, agent string, is_pre_flagged boolean, confidence double, layer string"


def issue(rule, severity, line, agent="general", confidence=0.8, flagged=False, file="a.py", chunk="c"):
    return (chunk, rule, severity, f"T {rule}", "why", file, line, line, "do", "python", "general", agent, flagged, confidence, "data")


def test_chain(spark):
    rows = [
        issue("A1", "HIGH", 42, "security", 0.8), issue("B1", "MEDIUM", 43, "architecture", 0.7), issue("C1", "LOW", 90, confidence=0.4), issue("D1", "LOW", 120, confidence=None), issue("E1", "LOW", 200, confidence=0.6),
        issue("E1", "LOW", 200, confidence=0.5, flagged=True), issue("F1", "INFO", 10), issue("G1", "CRITICAL", 11), issue("A1", "HIGH", 42, "security", 0.8, file=None),
    ]
    got = W.ordered(W.deduplicated(spark.createDataFrame(rows, ISSUE).selectExpr("*", "1 AS seq", "2 AS line"))).collect()
    assert [(r.file_path, r.rule_id, r.start_line, r.confidence, r.corroborated_by) for r in got] == [
        ("a.py", "G1", 11, 0.8, ""), (None, "A1", 42, 0.8, ""), ("a.py", "A1", 42, 0.9500000000000001, "architecture"), ("a.py", "E1", 200, 0.5, ""), ("a.py", "F1", 10, 0.8, ""),
    ]
    assert W.deduplicated(spark.createDataFrame([], ISSUE)).count() == 0


def test_sources_and_gate(spark):
    v = spark.createDataFrame([("c1", "GEN001", "MEDIUM", 7), ("c1", "ZZ999", "LOW", 8), ("gone", "GEN001", "MEDIUM", 1)], "chunk_id string, rule_id string, severity string, line int")
    c = spark.createDataFrame([("c1", "a.py", None, None, "f", 1, 9), ("c2", "b.py", "python", "data", None, 1, 9)], "chunk_id string, file_path string, language string, layer string, symbol_name string, start_line int, end_line int")
    r = spark.createDataFrame([("GEN001", "style", "Short", "Keep short"), ("GEN001", "zzz", "x", "y")], "rule_id string, category string, title string, description string")
    found = {x.rule_id: x for x in W.preflagged(v, c, r).collect()}
    assert found["GEN001"].category == "style" and found["ZZ999"].category == "general" and found["ZZ999"].title == "ZZ999" and found["GEN001"].suggestion.endswith("standards/unknown.md for the required fix.")
    radius = spark.createDataFrame([("c2", 50), ("c1", 49)], "node string, radius int")
    notes = W.radius_notes(c, radius).collect()
    assert [(n.chunk_id, n.severity, n.category) for n in notes] == [("c2", "INFO", "architecture")]
    assert W.together(W.preflagged(v, c, r), W.radius_notes(c, radius)).count() == 3
    d = spark.createDataFrame([("x", "ABORT"), ("y", "WARN")], "repo_name string, decision string")
    assert [q.repo_name for q in W.gated(spark.createDataFrame([("x",), ("y",), ("z",)], "repo_name string"), d).orderBy("repo_name").collect()] == ["y", "z"]
    assert {x.category for x in W.with_category(spark.createDataFrame([("GEN001",), ("Q",)], "rule_id string"), r).collect()} == {"style", "general"}


def test_queue_with_and_without_a_cap(spark):
    o = spark.createDataFrame([(f"c{i:02}", i % 3 + 1, i % 5) for i in range(40)], "chunk_id string, tier int, lines int")
    want = [f"c{i:02}" for i in sorted(range(40), key=lambda i: (i % 3 + 1, -(i % 5), i))]
    for most in (0, 7, 300):
        got = {r.place: r.chunk_id for r in W.queue(o, most).collect()}
        assert [got[k] for k in sorted(got)] == want[: most or 40]


def test_attribution(spark):
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "bundle_id int, position int, chunk_id string")
    f = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, -1), (1, None), (2, 0)], "bundle_id int, chunk_index int")
    assert sorted(r.chunk_id for r in W.attributed(f, b).collect()) == ["x", "y"]


def test_prompt_leaves_out_empty_sections(spark):
    c = spark.createDataFrame([("a", "f.py", "python", "s", "x\n" * 200), ("b", "g.py", "go", None, None)], "chunk_id string, file_path string, language string, symbol_name string, content string")
    t = spark.createDataFrame([("a", "ctx")], "chunk_id string, text string")
    r = spark.createDataFrame([("python", "RULES")], "language string, text string")
    v = spark.createDataFrame([("a", "GEN001", 3), ("a", "GEN001", 3)], "chunk_id string, rule_id string, line int")
    got = {x.chunk_id: x.prompt for x in W.prompts(c, t, r, v).collect()}
    assert got["a"].count("- GEN001 at line 3") == 1 and "## Context\nctx" in got["a"] and "RULES" in got["a"] and "(200 lines total)" in got["a"]
    assert got["b"] == "File: g.py\nSymbol: \n\n## Code\n"


def test_wrapping_equals_the_library(spark):
    texts = ["", "one", "word " * 40, "a" * 100 + " b " + "c" * 70, "  lead\n and  tail  ", "x " * 35 + "y" * 71]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(O.wrapped(F.col("t")).alias("w")).collect()]
    for t, w in zip(texts, got):
        assert w == textwrap.fill(" ".join(t.split()), 72, initial_indent="  ", subsequent_indent="  ", break_long_words=False, break_on_hyphens=False).rstrip(), t


def test_reports(spark):
    i = spark.createDataFrame([issue("A1", "HIGH", 1), issue("A1", "LOW", 2), issue("B1", "LOW", 2, file="<b>.py")], ISSUE)
    page = O.page(O.counts(i), i.groupBy("file_path").agg(F.count("*").alias("issues"), F.min("severity").alias("worst")), "R & D")
    assert "R &amp; D" in page and "&lt;b&gt;.py" in page and "HIGH: 1" in page
    rows = {r.file_path: json.loads(r.report) for r in O.file_reports(i, ["language"]).collect()}
    assert rows["a.py"]["issue_count"] == 2 and [x["start_line"] for x in rows["a.py"]["issues"]] == [1, 2]
    assert O.page(O.counts(i.limit(0)), i.limit(0).select("file_path", F.lit(1).alias("issues"), F.lit("LOW").alias("worst")), "x").count("<td>") == 0
    assert O.rendered(O.with_issues(i.limit(0), ["file_path"]), "github").count() == 0


def test_stores(spark, tmp_path):
    s = stores.ChunkStore(spark, f"{tmp_path}/store")
    assert s.read().count() == 0
    s.ensure()
    rows = spark.createDataFrame([("a", "r", "f.py", 2, "x"), ("b", "r", "f.py", 1, "y"), ("a", "r", "f.py", 2, "x"), (None, "r", "f.py", 9, "z")], "chunk_id string, repo_name string, file_path string, start_line int, content string")
    full = rows.selectExpr("*", "'python' AS language", "'block' AS chunk_type", "'s' AS symbol_name", "3 AS end_line", "null AS parent_symbol", "null AS parent_chunk_id", "null AS prev_chunk_id", "null AS next_chunk_id", "cast(null AS string) AS summary", "'data' AS layer", "md5(content) AS content_hash")
    v = spark.createDataFrame([("a", "B2"), ("a", "A1"), ("a", "A1")], "chunk_id string, rule_id string")
    s.upsert(stores.payload(full, v))
    assert [(r.chunk_id, r.violations, r.summary, r.layers) for r in s.by_file("r", "f.py").collect()] == [("b", [], "", ["data"]), ("a", ["A1", "B2"], "", ["data"])]
    s.upsert(stores.payload(full.where("chunk_id = 'a'").withColumn("content", F.lit("new")), v))
    assert s.by_id("a").first().content == "new" and s.read().count() == 2 and s.by_id("nope").count() == 0
    (tmp_path / "store" / "9").mkdir()  # an upsert that died
    assert s.read().count() == 2
    s.ensure(recreate=True)
    assert s.read().count() == 0
    assert stores.load_index(spark, f"{tmp_path}/none").count() == 0
    p = spark.createDataFrame([("t", "a", 3, 1)], stores.POSTINGS)
    stores.save_index(p, f"{tmp_path}/index")
    assert stores.load_index(spark, f"{tmp_path}/index").collect() == p.collect()


def test_golden_cases(spark, tmp_path):
    root = tmp_path / "golden"
    for path, expected, code in (("plain", {"language": "python", "chunk_type": "function", "must_find": [{"rule_id": "SEC001", "severity": "CRITICAL"}]}, "x = 1\n"), ("style/bare", {"language": "go", "layer": "data", "must_not_find": [{"rule_id": "A1"}]}, "y"), ("style/none", None, "z")):
        (root / path).mkdir(parents=True)
        (root / path / "input.py").write_text(code)
        if expected is not None:
            (root / path / "expected.json").write_text(json.dumps(expected))
    got = {r.name: r for r in stores.golden_cases(spark, str(root)).collect()}
    assert set(got) == {"plain", "bare"} and got["plain"].category == "misc" and got["plain"].layer == "unknown" and got["plain"].must_find[0].rule_id == "SEC001"
    assert got["bare"].category == "style" and got["bare"].must_find == [] and got["bare"].must_not_find[0].severity is None and got["bare"].content == "y"
    assert stores.golden_cases(spark, f"{tmp_path}/none").count() == 0


def test_stage_spans(spark):
    e = [("r", 1.0, "stage_start", "scan", None), ("r", 2.5, "stage_end", "scan", True), ("r", 3.0, "stage_start", "parse", None), ("r", 4.0, "stage_start", "parse", None), ("r", 5.0, "stage_end", "parse", False), ("q", 1.0, "stage_end", "scan", True), ("r", 9.0, "other", "scan", None)]
    got = sorted((r.stage, r.started, r.ok, r.ms) for r in stores.stage_spans(spark.createDataFrame(e, "run_id string, ts double, event_type string, stage string, ok boolean")).collect())
    assert got == [("parse", 3.0, None, None), ("parse", 4.0, False, 1000), ("scan", 1.0, True, 1500)]


def test_standards_folder(spark, tmp_path):
    rule = "## {}\n\n### {} — A rule\n- **Severity**: HIGH\n- **Language**: {}\n- Do it well.\n- **Bad:**\n```\na\nb\nc\nd\n```\n"
    assert standards.read(spark, f"{tmp_path}/std", f"{tmp_path}/one.md").count() == 0
    (tmp_path / "one.md").write_text(rule.format("General Rules", "GEN009", "all"))
    assert [r.rule_id for r in standards.read(spark, f"{tmp_path}/std", f"{tmp_path}/one.md").collect()] == ["GEN009"]
    (tmp_path / "std").mkdir()
    (tmp_path / "std" / "b.md").write_text(rule.format("Python Rules", "PY009", "python"))
    (tmp_path / "std" / "a.md").write_text(rule.format("General Rules", "GEN008", "all"))
    table = standards.read(spark, f"{tmp_path}/std", f"{tmp_path}/one.md")
    assert sorted((r.rule_id, r.category) for r in table.collect()) == [("GEN008", "general"), ("PY009", "python")]
    assert standards.grave(table).count() == 2 and standards.by_category(table, "PYTHON").count() == 1
    langs = spark.createDataFrame([("python",), ("go",)], "language string")
    text = {r.language: r.text for r in standards.blocks(standards.for_languages(table, langs)).collect()}
    assert text["go"].startswith("CODING STANDARDS (1 rules, language=go):\n[GEN008] [HIGH] A rule\n  → ") and text["python"].index("GEN008") < text["python"].index("PY009") and "\nd" not in text["go"]


def test_small_functions(spark):
    df = spark.createDataFrame([('```json\n["a"]\n```', "https://h/v1/chat/completions/", "https://github.com/o/r"), ("[1, 2]", " http://h// ", None), ("no", "http://h", "git@github.com:o/r")], "a string, u string, g string")
    got = df.select(T.json_list(F.col("a"), F.lit(1)).alias("l"), T.service_base(F.col("u")).alias("b"), T.hosted_repository(F.col("g")).alias("h")).collect()
    assert [(r.l, r.b, r.h) for r in got] == [(["a"], "https://h/v1", True), (None, "http://h", False), (None, "http://h", False)]
