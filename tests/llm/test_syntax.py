import pytest

from lodestone.llm import syntax as S

VALID = {
    "python": ["def f(a: int = 1) -> int:\n    return a\n", "", "x = '''\n<<<<<<< HEAD\n'''\n"],
    "javascript": ["const a = /x[/]y/g.test(b) ? 1 : 2;\nlet {c, d} = e;\n({f} = g);\nclass A extends B { static x = 1; get y() { return this.z?.w ?? 0 } async *g() { yield* h() } }\n", "import a, { b as c } from './x';\nfor await (const x of y) {}\nx = y => ({b: 1});\n", "const t = `\n<<<<<<< HEAD\n=======\n`;\n"],
    "typescript": ["export function f<T extends A>(x: T, y?: string): Promise<Record<string, unknown>> { return x as any }\nenum C { X = 1 }\n", "let u: string[] = [], v!: number;\nconst w = foo!.bar;\n"],
    "java": ["package a.b;\nimport static a.B.*;\n@Named(\"x\") public final class A<T extends B> extends C { @Override String f(int a) throws X { for (int i = 0; i < 3; i++) { } return (String) x; } }\n", "enum Q { A, B(1) { void f() {} }; }\n"],
    "go": ["package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\nfunc (r *A) F(a int, b ...string) (c *D, err error) {\n\tfor k, v := range m {\n\t}\n\tif x := f(); x != nil {\n\t}\n\tch <- 1\n}\n"],
    "kotlin": ["package a.b\n\ndata class A(val a: Int) : B(a) {\n    companion object { const val Z = 1 }\n}\nfun String.ext() = this.length\nval z = if (a) 1 else 2\n"],
    "swift": ["import A\n\npublic final class B: C {\n    @Published private(set) var x: Int = 1\n    func f(_ a: Int..., b c: inout String) throws -> [Int] {\n        guard let a = b, a > 1 else { return [] }\n        for i in 0..<10 where i > 2 { }\n    }\n}\n"],
    "dart": ["import 'a.dart' as c show D;\n\nclass A extends B {\n  final int x;\n  const A(this.x, {required this.q});\n  @override\n  Future<void> f() async { a..b()..c = 1; }\n}\n"],
    "json": ['{"a": [1, null, "x"]}', "3"],
    "yaml": ["a:\n  b: 1\n  c: [x,\n    y]\nd:\n- e: 'f'\n  g: |\n    free: text\n      here\n- h\n", "--- \nx: \"a: b\"\n", "", "text: plain\n  goes on\n"],
}
INVALID = {
    "python": [("def f(:\n", 1), ("x = (\n", 1), ("x = “a”\n", 1)],
    "javascript": [("function f() {\n", 1), ("const a = f(1];\n", 1), ('x = "a\n', 1), ("<<<<<<< HEAD\nx = 1;\n=======\nx = 2;\n>>>>>>> b\n", 1), ("package a.b;\n", 1), ("function f(a: number): void {\n}\n", 1), ("  {{ a.b }} = 3;\n", 1), ("<%= x %>\nlet y = 1;\n", 1)],
    "typescript": [("<!DOCTYPE html>\n<html></html>\n", 1), ("def f(a):\n    return 1\n", 1)],
    "java": [("package a\nimport b.C\nclass D {}\n", 1), ("class A { void f() { g((1; } }", 1)],
    "go": [("const a = 1;\n", 1), ("package a\nfunc f() {\n\tx[1)\n}\n", 1), ("", 0)],
    "kotlin": [("package a\nfun f() {\n    if x < 1 {\n    }\n}\n", 1), ("protected int f() {\n}\n", 1)],
    "swift": [("package store\n\nimport (\n\t\"x\"\n)\n", 1), ("let a = “b”\n", 1)],
    "dart": [("package main\n\nimport (\n\t\"x\"\n)\n", 1)],
    "json": [("", 1), ("{'a': 1}", 1), ('{"a": 1,}', 1), ('{"a": NaN}', 1), ("{}{}", 1)],
    "yaml": [("a:\n\tb: 1\n", 1), ("a:\n  b: 1\n c: 2\n", 1), ("a: [1, 2\n", 1), ('a: "x\n', 1), ("a: {% x %}\n", 1)],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        for t in (text, text.replace("\n", "\r\n"), text.replace("\n", "\r")):
            assert S.verdict(language, t).cost == 0, (t, S.verdict(language, t))


@pytest.mark.parametrize("language", INVALID)
def test_invalid(language):
    for text, least in INVALID[language]:
        assert (S.verdict(language, text).cost > 0) == bool(least), text


def test_dyck_cost_is_least():
    import itertools

    def brute(s):  # fewest edits by breadth-first search over all strings
        seen, now, n = {s}, {s}, 0
        while not any(not S.residue(x) for x in now):
            n += 1
            now = {y for x in now for i in range(len(x) + 1) for y in [x[:i] + x[i + 1 :], *(x[:i] + c + x[i:] for c in "()[]"), *(x[:i] + c + x[i + 1 :] for c in "()[]")]} - seen
            seen |= now
        return n

    for k in range(1, 5):
        for s in map("".join, itertools.product("()[]", repeat=k)):
            left = "".join(s[i] for i in S.residue(s))
            assert S.dyck_cost(left) == brute(s), s


def test_kinds():
    assert S.verdict("java", "class A {\n    void f() {\n").kind == "truncation"
    assert S.verdict("javascript", "a();\n<<<<<<< HEAD\nb();\n=======\nc();\n>>>>>>> x\n").kind == "conflict"
    assert S.verdict("typescript", "<!DOCTYPE html>\n<html></html>\n").kind == "mismatch"
    assert S.verdict("javascript", "a(1];\nb();\n").kind == "syntax"


def test_tables(spark):
    files = spark.createDataFrame([(1, ".PY", "2025-01-01"), (1, ".js", "2024-01-01"), (2, ".js", "2025-01-01"), (3, None, "2025-01-01"), (5, ".md", "2025-01-01"), (6, ".json", "2025-01-01")], "file_id bigint, extension string, scanned_at string")
    rows = [(1, "r", "a.py", "def f(:\n"), (1, "r", "a.py", "def f(:\n"), (2, "r", "a.js", "f();\n" * 50_000 + "g("), (3, None, "b.yaml", "a: 1\n"), (4, "r", "c.json", None), (5, "r", "x.md", "(("), (6, "r", None, "{}"), (7, "r", None, "x")]
    df = spark.createDataFrame(rows, "file_id bigint, repo_name string, path string, content string").selectExpr("*", "'z' AS extension", "1 AS cost")
    got = {r.file_id: (r.language, r.cost > 0, r.line) for r in S.check(df, files).collect()}
    assert got == {1: ("python", True, 1), 2: ("javascript", True, 50_001), 3: ("yaml", False, None), 4: ("json", True, 1), 6: ("json", False, None)}
    rates = {(r.repo_name, r.language): r.rate for r in S.rates(S.check(df, files)).collect()}
    assert rates[("r", "json")] == 0.5 and rates[(None, "yaml")] == 0
    assert S.check(df.limit(0), files).count() == 0
