import pytest

from lodestone.llm import syntax as S

BRACES = ("javascript", "typescript", "java", "go", "kotlin", "swift", "dart")
START = {"go": "package a\n\nfunc f() {\n", "java": "class A { void f() {\n"}
END = {"go": "}\n", "java": "} }\n"}


def inside(language, text):
    return START.get(language, "") + text + END.get(language, "")


@pytest.mark.parametrize("language", BRACES)
def test_clause_without_head(language):
    bad = ["else {\n}\n"]
    bad += ["if (a) {\n}\ncatch (e) {\n}\n"] * (language != "go") + ["case 1:\n"] * (language != "kotlin") + ["if () {\n}\n", "while () {\n}\n"] * (language not in ("go", "swift")) + ["val x 5\n", "val x \"5\"\n"] * (language == "kotlin")
    for text in bad:
        assert S.verdict(language, inside(language, text)).cost > 0, text


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("javascript", "if (a) for (;;) { b(); } else if (c) { d(); } else { e(); }\np\n  .catch(f).finally(g);\nconst o = {else: 1, case: 2};\nswitch (x) {\n  case 1:\n    y();\n}\nclass A { static async catch(x) { } }\n"), ("typescript", "interface A { case?: string; else: number }\ntry { f(); } catch { g(); } finally { h(); }\n"),
        ("java", "class A { void f() { if (a) b(); else c(); switch (x) { case 1: { y(); } default: z(); } try { a(); } catch (E e) { } catch (F e) { } finally { } } }\n"), ("go", "package a\n\nfunc f() {\n\tselect {\n\tcase x := <-c:\n\t\tg(x)\n\t}\n\tif a {\n\t} else if b {\n\t} else {\n\t}\n}\n"),
        ("kotlin", "fun f() {\n    when (x) {\n        1 -> a()\n        else -> b()\n    }\n    val y = try { a() } catch (e: E) { 1 } finally { c() }\n    val z = 1 shl 5\n    val q by lazy { 1 }\n}\n"),
        ("swift", "enum A {\n    case b\n    indirect case c(A)\n}\nfunc f() {\n    guard case .b = x else { return }\n    if case .c = x, case .b = y { }\n    do { try g() } catch { }\n    switch x {\n    case .b: break\n    }\n}\n"), ("dart", "var l = [if (a) 1 else 2];\nvoid f() { if (x case 1) { } try { } on E catch (e) { } finally { } switch (x) { case 1: break; } }\n"),
    ],
)
def test_clause_with_head(language, text):
    for t in (text, text.replace("\n", "\r\n")):
        assert S.verdict(language, t).cost == 0, S.verdict(language, t)
