from lodestone.operators import build as B

BODY = "".join(f"    x{i} = {i}\n" + ("\n" if i % 40 == 39 else "") for i in range(300))
FILE = "import os\nimport sys\n\n\nclass A:\n    def f(self):\n        return os\n\n\ndef long():\n" + BODY + "\n" * 30 + "".join(f"y{i} = {i}\n" for i in range(25))


def test_every_file_is_cut_into_symbols_parts_and_windows():
    out = B.pieces("python", "a/b.py", FILE)
    ls = FILE.split("\n")[:-1]
    kinds = {p.kind for p in out}
    assert {"import", "method", "block"} <= kinds and all(1 <= p.start <= p.end <= len(ls) for p in out)
    f = next(p for p in out if p.kind == "method")
    assert f.content.startswith("# a/b.py:6\n    def f(self):") and f.parent == "A"
    parts = [p for p in out if p.name.startswith("long_block_")]
    assert parts[0].start == 10 and len(parts) > 1 and all(b.start == a.end - 14 for a, b in zip(parts, parts[1:])) and all(p.end - p.start + 1 <= 160 for p in parts)
    assert parts[-1].end == max(p.end for p in parts) and all(p.content == "\n".join(ls[p.start - 1 : p.end]) for p in parts)
    tail = [p for p in out if p.name.startswith("block_")]
    assert tail and tail[-1].end == len(ls)


def test_files_without_symbols_are_windows():
    text = "".join(f"line {i}\n" for i in range(1, 131))
    assert [(p.start, p.end) for p in B.pieces("unknown", "x", text)] == [(1, 60), (46, 105), (91, 130)]
    assert B.pieces("unknown", "x", "") == B.pieces("unknown", "x", "\n" * 99) == []
    assert [p.kind for p in B.pieces("python", "x.py", "def broken(:\n")] == ["block"]


def test_tables(spark):
    rows = [("o__r", "a/b.py", "python", FILE), ("o__r", "c.md", "unknown", "# a\n"), ("o__r", "d.py", "python", None), ("o__r", "e.py", "python", ""), (None, None, None, "x\n")]
    files = spark.createDataFrame(rows, "repo_name string, path string, language string, content string").selectExpr("*", "1 AS seq", "'k' AS kind", "2 AS start_line")
    got = B.chunked(files)
    assert got.where("chunk_type = 'module'").count() == 5 and got.where("file_path = 'd.py'").count() == 1
    ids = [r.chunk_id for r in got.where("file_path IS NOT NULL").collect()]
    assert len(ids) == len(set(ids))
    links = {r.chunk_id: r for r in B.linked(got.where("file_path = 'a/b.py'")).collect()}
    assert sum(r.prev_id is None for r in links.values()) == sum(r.next_id is None for r in links.values()) == 1
    assert sum(r.parent_id is not None for r in links.values()) == 1
    assert B.chunked(files.limit(0)).count() == 0
