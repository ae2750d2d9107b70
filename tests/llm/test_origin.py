import pytest

from lodestone.llm import origin as O

CODE = "import logging\n\n\ndef f(a):\n    return a + 1\n\n\n" * 8


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a/x.py", "# Code generated by tool v1. DO NOT EDIT.\n" + CODE, "generated"), ("a/x.py", "# licence\n# @generated by tool\n" + CODE, "generated"), ("a/x.py", "# Not generated: edit freely.\n" + CODE, ""),
        ("a/x.py", "# Once generated by tool, now maintained by hand.\n" + CODE, ""), ("a/x.py", CODE + '\ns = "@generated by tool"\n', ""), ("a/x.g.dart", "int f() {\n  return 1;\n}\n" * 20, ""),
        ("a/x.js", "!function(e,t){e.x=t(4)}(y,z);" * 60, "minified"), ("a/x.min.js", "function f(a) {\n  return a + 1;\n}\n" * 20, ""), ("a/x.java", "class A {\n    void f() {\n        int a = 1;\n    }\n" * 20 + 'String s = "' + "x" * 9000 + '";\n}', ""),
        ("a/x.py", "ROWS = [\n" + '    "grade-1", "lyric-2", "cart-3",\n' * 60 + "]\n", "data"), ("a/x.ts", 'export const x: string = "' + "iQ3" * 900 + '";\n', "data"), ("package-lock.json", "{}", "lock"), ("a/lock_job.py", CODE, ""),
        ("deps/foo/foo.py", "# foo v1.2.3\n# Copyright (c) the foo authors. Released under the MIT license.\n" + CODE, "vendored"), ("a/__init__.py", "", ""), ("", CODE, ""),
    ],
)
def test_judge(path, text, kind):
    assert O.judge(path, text) == kind


def test_trees(spark):
    lib = CODE + "# shared\n"
    rows = [
        (1, "a__x", "third/lib/core.py", lib), (2, "b__y", "deps/lib2/other.py", lib.replace("\n", "\r\n")), (3, "a__x", "third/lib/__init__.py", ""), (4, "b__y", "deps/lib2/__init__.py", ""),
        (5, "a__x", "src/__init__.py", ""), (6, "b__y", "src/__init__.py", ""), (7, "a__x", "src/own.py", CODE + "# a\n"), (8, "a__z", "src/own.py", CODE + "# a\n"), (9, "b__y", None, None), (10, None, "q/p.py", CODE + "# q\n"), (1, "a__x", "third/lib/core.py", lib),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo_name string, path string, content string").selectExpr("*", "'x' AS kind", "1 AS d1")
    got = {r.file_id: r.kind for r in O.not_hand_written(df).collect()}
    assert got == {1: "vendored", 2: "vendored", 3: "vendored", 4: "vendored"}  # two repositories of one owner are related
    assert O.not_hand_written(df.limit(0)).count() == 0
