"""Results hold everything: nothing is cut at a fixed number or a first line."""

from lodestone.operators import context


def test_neighbours_of_a_hub(spark):
    callers = [f"n{i:05}" for i in range(1200)]
    df = spark.createDataFrame([(c, "hub") for c in callers] + [("top", c) for c in callers] + [("top", callers[0])], "src string, dst string")
    got = {r.node: r for r in context.neighbour_lists(df).where("node IN ('hub', 'top')").collect()}
    assert got["hub"].n_in == 1200 and got["hub"].incoming == callers and got["hub"].outgoing is None
    assert got["top"].n_out == 1200 and got["top"].outgoing == callers and got["top"].incoming is None


def test_bm25_of_whole_texts(spark):
    """The blocks against the joins of bm25; the word that decides stands in a later line."""
    import random

    from lodestone.operators import retrieval as R

    rng = random.Random(4)
    rows = [(i, [f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(60))]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, terms array<string>")
    asked = df.where("doc_id % 20 = 0")
    slow = R.bm25(asked.withColumnRenamed("doc_id", "query_id"), R.postings(df, "doc_id", "terms"), "doc_id").where("query_id <> doc_id")
    want = {}
    for r in slow.collect():
        want.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    got = {}
    for r in R.bm25_top(asked, df, 15, block=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.doc_id)
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == {q: sorted(x)[:15] for q, x in want.items()}
    assert R.bm25_top(asked.limit(0), df, 15).count() == 0 and R.bm25_top(asked, df.limit(0), 15).count() == 0


def test_hybrid_asks_with_later_lines(spark, tmp_path):
    from lodestone.plans.retrieval import q_bm25_documents, q_hybrid

    texts = {0: "note\nzebra quagga", 1: "other words", 2: "zebra quagga", 3: "still more", 4: "nothing here", 5: "and so on"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, content string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert [(r.query_id, r.doc_id) for r in q_bm25_documents(spark, str(tmp_path)).collect()] == [(0, 2)]
    assert q_hybrid(spark, str(tmp_path)).where("rank = 1").select("query_id", "doc_id").first() == (0, 2)


def test_measures_of_the_code_itself(spark, tmp_path):
    from lodestone.plans import code_graph as Q

    rows = [("a", "r", "src/screens/a.py", "function", "f", None, 1, 2, "def f():\n    g()\n"), ("b", "r", "src/db/b.py", "function", "g", None, 1, 2, "def g():\n    h()\n"), ("c", "r", "src/db/c.py", "function", "h", None, 1, 2, "def h():\n    f()\n")]
    spark.createDataFrame(rows, "chunk_id string, repo_name string, file_path string, chunk_type string, symbol_name string, parent_symbol string, start_line int, end_line int, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert [r.cycle for r in Q.q_code_cycles3(spark, str(tmp_path)).collect()] == ["a>b>c"]
    assert {(r.src, r.dst) for r in Q.q_code_layer_violations(spark, str(tmp_path)).collect()} == {("a", "b"), ("c", "a")}
