import pytest

from lodestone.llm import docpairs as D

DOC = "Given a seat, works out which tooltip should rewind next."


def pairs(language, text):
    return [n for n, d, _ in D.functions_of(language, text) if d and not D.trivial(d, n)]


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("python", f'@x\nasync def f(a: list[str] = (1, 2)) -> dict:\n    r"""{DOC}"""\n    return 1\n\ndef g():\n    # {DOC}\n    return 2\n\ndef h():\n    x = """{DOC}"""\n', ["f"]),
        ("python", f"class A:\n    def m(self):\n        '{DOC}'\n\n    def n(self):\n        f'{DOC}'\n", ["m"]),
        ("python", f'# def no():\ns = """\ndef fake():\n    \'\'\'{DOC}\'\'\'\n"""\n', []),
        ("javascript", f"/**\n * {DOC}\n * @param a x\n */\nexport async function f(a) {{ }}\n\n// {DOC}\n\nfunction gap() {{}}\n// {DOC}\nconst g = (a, b) => {{ }}\n", ["f", "g"]),
        ("typescript", f"/** {DOC} */\n@dec()\nexport function f<T>(a: T): Record<string, unknown> {{ }}\nclass A {{\n  /** {DOC} */\n  private async m(a: string): Promise<void> {{ }}\n}}\n", ["f", "m"]),
        ("java", f'class A {{\n    /** {DOC} */\n    @Named("a")\n    @Override\n    public static Map<String, List<Integer>> f(final int a) throws X {{ }}\n    int x = 1; // {DOC}\n    void g() {{ }}\n}}', ["f"]),
        ("go", f"// {DOC}\nfunc (r *T) F(a int) (string, error) {{\n}}\n\n// freshReceipt := previewAxis(decodeWeight)\n// firstModule(refreshBudget)\nfunc G() {{}}\n", ["F"]),
        ("kotlin", f"/** {DOC} */\nprivate suspend fun <T> List<T>.f(a: Int): Int = 1\n", ["f"]),
        ("swift", f"/// {DOC}\n/// - Parameter a: x\npublic func f(a: Int) -> Int {{ }}\n", ["f"]),
        ("dart", f"/// {DOC}\n@override\nFuture<void> f(int a) async {{ }}\n", ["f"]),
        ("cobol", DOC, []),
        ("java", "", []),
    ],
)
def test_pairs(language, text, names):
    assert pairs(language, text) == names
    assert pairs(language, text.replace("\n", "\r\n")) == names
    assert pairs(language, text.replace("\n", "\r")) == names


@pytest.mark.parametrize(
    ("doc", "name", "is_trivial"),
    [
        (f"/** {DOC} */", "f", False), ("// Move the thread.", "moveThread", True), ("TODO: someone should write a proper description of this one day", "f", True),
        ("Placeholder text, to be replaced with the real description later on", "f", True), ("// NOLINTNEXTLINE(readability-function-size, misc-unused)", "f", True), ("// -------- //", "f", True),
        ("/**\n * @param a the first of them all\n * @return result of it\n */", "f", True), ("Short one here now", "f", True), ("// eslint-disable-next-line max-len, no-console, complexity", "f", True),
        ("\n    Prüft den Index und schreibt das Ergebnis zurück.\n\n    Args:\n        a: x\n    ", "f", False), ("{@inheritDoc}", "f", True), ("", "f", True), ("受信箱を次の処理へ渡します。", "f", False),
    ],
)
def test_trivial(doc, name, is_trivial):
    assert D.trivial(doc, name) == is_trivial


def test_tables(spark):
    text = f'def f():\n    """{DOC}"""\n    return 1\n\n\ndef g():\n    return 2\n'
    rows = [("a", "function", "Python", text, "x"), ("a", "function", "Python", text, "x"), ("b", "module", "python", text, "x"), ("c", "method", None, text, "x"), ("d", "class", "python", None, "x"), ("e", "class", "python", "", "x"), ("f", "class", "python", text + "# y\n" * 100_000, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_type string, language string, content string, documentation string")
    got = {(r.chunk_id, r.symbol_name): r.code for r in D.pairs(df).collect()}
    assert set(got) == {("a", "f"), ("f", "f")}
    assert got[("a", "f")].startswith("def f") and "return 1" in got[("a", "f")] and "def g" not in got[("a", "f")]
    assert D.pairs(df.limit(0)).count() == 0
