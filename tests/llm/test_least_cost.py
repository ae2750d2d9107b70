import random

import pytest

from lodestone.llm import syntax as S


def table(s: str) -> int:
    """Least edits to balance a string, by the whole chart: every span, every partner of its first bracket."""
    n, codes = len(s), ["([{)]}".index(c) for c in s]
    cost = [[0] * (n + 1) for _ in range(n + 2)]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            best = cost[i + 1][j] + 1
            for k in range(i + 1, j):
                pair = 0 if codes[i] < 3 and codes[k] == codes[i] + 3 else 2 if codes[i] >= 3 > codes[k] else 1
                best = min(best, pair + cost[i + 1][k] + cost[k + 1][j])
            cost[i][j] = best
    return cost[0][n]


@pytest.mark.parametrize(("text", "cost"), [("(" + "[}" * 100 + ")", 100), ("([" * 90 + "}" + "])" * 90 + "]", 2), ("{" * 100 + "(]" * 90 + "}" * 100 + "[", 91), ("[" * 200_000 + "}", 100_001)])
def test_partners_at_any_distance(text, cost):
    assert S.dyck_cost(text) == cost


@pytest.mark.parametrize(("alphabet", "length"), [("([{)]}", 30), ("()[]", 30), ("(((((]})", 40), ("((((((((([)]]", 40), ("([{)]}", 260)])
def test_chart_against_the_whole_table(alphabet, length):
    rng = random.Random(length)
    for _ in range(40 if length < 100 else 1):
        a = "".join(rng.choices(alphabet, k=length))
        left = "".join(a[i] for i in S.residue(a))
        least, most = S._bounds(left)
        assert least <= S.dyck_cost(a) == table(a) <= most, a


def test_partners_that_many_spans_share():
    for a in ("([)]" * 45, "({[)}]" * 35, "([)" * 60):
        assert S.dyck_cost(a) == table(a), a


def test_cost_of_a_file_with_partners_far_apart():
    assert S.verdict("json", "[{" * 90 + ")" + "}]" * 90 + "]").cost == 2
