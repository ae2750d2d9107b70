import pytest
from pyspark.sql import functions as F

from lodestone.llm import origin as O

CODE = "import logging\n\n\ndef first(value):\n    total = value + 1\n    logger.info(total)\n    return total\n\n\n" * 3


def _rows(repo, top, count, edited=()):
    return [(repo, f"{top}/f{i}.py", CODE + f"# {i}\n" + (f"x{repo} = 1\n" if i in edited else "")) for i in range(count)]


@pytest.mark.parametrize(
    ("path", "text", "made"),
    [
        ("a/order.pb.go", "package svc\n", True), ("a/order_pb2.py", CODE, True), ("a/order.freezed.dart", "int f() => 1;\n", True), ("generated_report.ts", "let a = 1;\n", False),
        ("a/order.g.dart", "// Once generated, now maintained by hand.\nint f() => 1;\n", False), ("a/order.pb.go", "  \n", False), ("", "", False), ("a/pb.go", "package svc\n", False),
    ],
)
def test_output_names(path, text, made):
    assert O.output_of_tool(path, text) is made


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        ("// Diese Datei wird von einem Werkzeug erzeugt und bei jedem Lauf ersetzt.", "generated"), ("// Ce fichier a été généré par un outil, ne pas modifier.", "generated"), ("// Este archivo fue generado por una herramienta.", "generated"),
        ("// Questo file è stato generato da uno strumento.", "generated"), ("// Prüft den Bestand und schreibt das Ergebnis zurück.", ""), ("// Diese Datei wurde nicht erzeugt, sondern von Hand geschrieben.", ""), ("// Convierte cada pedido en una lista ordenada.", ""),
    ],
)
def test_headers_in_other_languages(head, kind):
    assert O.judge("a/x.ts", head + "\nfunction f(a) {\n  return a + 1;\n}\n") == kind


@pytest.mark.parametrize(("text", "kind"), [('V = "1.2.3"\n', ""), ("N = [" + ", ".join(map(str, range(20))) + "]\n", "data"), ("!function(e,t){e.x=t(4);e.y=t(5);e.z=t(6)}(y,z);var a=1;var b=2;var c=f(a,b);g(a,b,c);h(c);k(a);m(b);n(c);o(a);\n", "minified")])
def test_layout_has_no_least_size(text, kind):
    assert O.judge("a/x.js" if kind == "minified" else "a/x.py", text) == kind


def test_trees_hash_digests_of_children(spark):
    rows = [(*r, 0, 0) for r in _rows("a__x", "lib/deep/er", 3) + _rows("b__y", "other/deep/er", 3) + _rows("c__z", "lib/deep/er", 2)] + [("d__w", "top.py", "", 0, 0)]
    leaf = spark.createDataFrame(rows, "repo_name string, path string, content string, k int, c int").select("repo_name", "path", F.xxhash64("content").alias("d1"), F.xxhash64("content", F.lit(1)).alias("d2"), F.lit(True).alias("known"), F.lit(False).alias("copied"))
    nodes = {(r.repo_name, r.path): (r.d1, r.d2, r.files) for r in O.subtrees(leaf).collect()}
    assert len(nodes) == 9 and nodes["a__x", "lib"][2] == 3
    assert nodes["a__x", "lib/deep"] == nodes["b__y", "other/deep"] != nodes["c__z", "lib/deep"]
    assert nodes["a__x", "lib/deep/er"][:2] != nodes["a__x", "lib/deep"][:2]
    assert O.subtrees(leaf.limit(0)).count() == 0


def test_edited_copies_stay_with_their_directory(spark):
    rows = _rows("a__x", "q/lib", 6, {2}) + _rows("b__y", "p/lib", 6) + [("a__x", f"q/src/own{i}.py", CODE.replace("first", f"own{i}")) for i in range(9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id bigint, repo_name string, path string, content string")
    got = {r.file_id for r in O.not_hand_written(df).collect()}
    assert got == set(range(12))  # the edited third file of a, whose directory is a copy for the most part, and all of b
    assert {r.file_id for r in O.not_hand_written(df, majority=1.0).collect()} == set(range(12)) - {2, 8}
