import itertools
import json
import random

import pytest

from lodestone.llm import syntax as S


def edits(a: str) -> int:
    """Least edits to balance a short string, over all strings reachable."""
    seen, level, n = {a}, {a}, 0
    while True:
        if any(not S.residue(x) for x in level):
            return n
        n += 1
        level = {y for x in level for i in range(len(x) + 1) for y in ([x[:i] + c + x[i:] for c in "([{)]}"] + ([x[:i] + c + x[i + 1 :] for c in "([{)]}"] + [x[:i] + x[i + 1 :]] if i < len(x) else []))} - seen
        seen |= level


@pytest.mark.parametrize("seed", range(12))
def test_chart_against_search(seed):
    rng = random.Random(seed)
    for _ in range(4):
        a = "".join(rng.choices("([{)]}", k=rng.randrange(0, 6)))
        assert S.dyck_cost(a) == edits(a), a


@pytest.mark.parametrize(("text", "cost"), [("(" * 161 + ")" * 161, 0), ("(" * 5000, 2500), (")" * 301 + "[" * 301, 302), ("(]" * 200, 200), ("(]" * 3000, 3000), ("[(" * 30 + "]" + ")]" * 30, 1), ("", 0)])
def test_one_rule_for_any_length(text, cost):
    assert S.dyck_cost(text) == cost


@pytest.mark.parametrize("depth", [10, 200_000])
def test_json_of_any_depth(depth):
    good = "[" * depth + "1" + "]" * depth
    assert S.verdict("json", good).cost == 0
    assert S.verdict("json", good[:-1]).cost > 0 and S.verdict("json", "[" * depth + "1").cost > 0
    assert S.verdict("json", '{"a":' * depth + "1" + "}" * depth).cost == 0 and S.verdict("json", '{"a":' * depth + "1," + "}" * depth).cost > 0


def test_deep_json_scanner_agrees_with_the_parser():
    rng = random.Random(5)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', "1", "-0.5e3", "true", "null", "01", " ", '"\\u00e9"', '"\\x"', "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(4000)] + [json.dumps({"a": [1, {"b": None}], "c": "x"})] + ["".join(p) for p in itertools.product(pieces, repeat=2)]
    for t in texts:
        try:
            json.loads(t, parse_constant=S._refuse)
            good = True
        except ValueError:
            good = False
        assert (S._deep_json(t) < 0) is good, t


def test_python_deeper_than_the_parser():
    deep = "x = " + "-" * 200_000 + "1\n"
    assert S.verdict("python", deep).cost == 0
    assert S.verdict("python", deep + "y = (\n").cost > 0


def test_repeated_file_counts_as_its_worst_text(spark):
    texts = spark.createDataFrame([(1, "a__b", "x.json", "{}"), (1, "a__b", "x.json", "{"), (2, "a__b", "y.json", "1"), (2, "a__b", "y.json", "1")], "file_id bigint, repo_name string, path string, content string")
    files = spark.createDataFrame([], "file_id bigint, extension string, scanned_at timestamp")
    assert {(r.file_id, r.cost > 0) for r in S.check(texts, files).collect()} == {(1, True), (2, False)}
