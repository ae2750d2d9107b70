import random
import unicodedata

import pytest

from lodestone.llm import leakage, mixing, skeleton
from lodestone.llm.leakage import words_of

ALIKE = [("naïve", "naïve"), ("code", "cоdе"), ("a b", "a b"), ("a b", "a　b"), ("value", "va​lue"), ("Token", "Ｔｏｋｅｎ"), ("TOP", "ΤОΡ"), ("soft", "so­ft"), ("ガ", "ガ"), ("カ", "ｶ")]
UNLIKE = [("Code", "code"), ("resume", "résumé"), ("x2", "x²"), ("1", "①"), ("o", "0"), ("l", "1"), ("a b", "a  b"), ("a b", "a\nb"), ("a\nb", "a\n\nb"), ("👩‍💻", "👩💻"), ("«a»", '"a"'), ("(", "（"), ("и", "u"), ("ß", "ss"), ("ﬁ", "fi")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert a != b and skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_unlike(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


def test_skeleton_is_idempotent():
    rng = random.Random(1)
    pool = [chr(c) for c in range(32, 0x3100)] + [chr(c) for c in range(0xFF00, 0xFFEF)] + list("👩💻🤷♂‍️")
    for _ in range(500):
        t = "".join(rng.choices(pool, k=30))
        s = skeleton.skeleton(t)
        assert skeleton.skeleton(s) == s and skeleton.skeleton(unicodedata.normalize("NFC", t)) == s


def test_look_alikes(spark):
    rows = [(1, "code"), (2, "cоde"), (3, "code"), (4, "Code"), (5, None), (6, ""), (7, "​"), (8, "x" * 500_000), (9, "x" * 499_999 + "х"), (2, "cоde"), (None, "code")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS s1", "'k' AS skeleton")
    got = sorted(tuple(r) for r in skeleton.look_alikes(df).collect())
    assert got == [(1, 2), (2, 3), (6, 7), (8, 9)]
    assert skeleton.look_alikes(df.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(30)] + ["the", "of", "naïve", "данные"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for i in range(25)]
    docs = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            w = rng.choice(items)[1].split()
            n = rng.randrange(8, 16)
            at = rng.randrange(max(1, len(w) - n))
            words[rng.randrange(len(words) + 1) : 0] = [x.upper().replace("O", "О") if rng.random() < 0.3 else x for x in w[at : at + n]]
        docs.append((i, rng.choice([" ", ", ", "_", "\n"]).join(words)))
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    D = spark.createDataFrame(docs + docs[:5] + [(900, None), (901, ""), (None, docs[0][1])], "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS token")
    I = spark.createDataFrame(items + items[:3] + [(99, None), (98, "")], "item_id bigint, content string").selectExpr("*", "0 AS pos")
    found = leakage.leaks(D, I)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    per = {r.item_id: r.documents for r in leakage.by_item(found, I).collect()}
    assert per[98] == 0 and sum(per.values()) == len(want)
    assert leakage.leaks(D.limit(0), I).count() == 0 and leakage.leaks(D, I.limit(0)).count() == 0


def test_mix(spark):
    docs = [(i, "words of the text " * (1 + i % 3), " Big-Source " if i % 2 else "big_source", "x", 1) for i in range(3000)] + [(5000 + i, "a small one here", "small", "x", 1) for i in range(40)] + [(9000, None, "small", "x", 1), (9001, "", None, "x", 1), (9002, "text", None, "x", 1)]
    D = spark.createDataFrame(docs, "doc_id bigint, text string, source string, mix_name string, copies int")
    T = spark.createDataFrame([("m", "BIG_SOURCE", 0.9, 1, 0.5), ("m", "small", 0.1, 4, 0.5), ("m", "none", 0.0, 2, 0.5), ("n", "big-source", 1.0, 3, 1.5)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    mixed, shares = mixing.mix(D, T)
    s = {(r.mix_name, r.source): r for r in shares.collect()}
    assert s["m", "none"].tokens == 0 and s["m", "none"].actual_share == 0
    assert s["m", "small"].most_copies == 4 and s["m", "small"].documents == 40  # the cap binds: all documents, four times
    assert abs(s["n", "big_source"].rate - 1.5 * (s["m", "small"].tokens / 4 + 1 + s["n", "big_source"].tokens / s["n", "big_source"].rate) / (s["n", "big_source"].tokens / s["n", "big_source"].rate)) < 0.02
    assert abs(sum(r.actual_share for k, r in s.items() if k[0] == "m") - 1) < 1e-5
    assert {r.copies for r in mixed.where("mix_name = 'n'").select("copies").distinct().collect()} == {1, 2}
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(D.repartition(7), T)[0].collect()))  # the same whatever the partitioning
    assert mixing.expand(mixed).count() == sum(r.copies for r in mixed.collect())
    assert mixing.mix(D.limit(0), T)[0].count() == 0 and mixing.mix(D, T.limit(0))[1].count() == 0


def test_public_table(spark):
    more = skeleton.confusables(spark)
    form = skeleton.Skeletons(more)
    assert len(more) > 200 and {form("α"), form("ι"), form("ρ"), form("υ"), form("ց")} == {"a", "i", "p", "u", "g"} and form("к") == form("κ")
    assert all(form(form(chr(c))) == form(chr(c)) for c in more)
    for a, b in UNLIKE:
        assert form(a) != form(b)
    assert [form(x) for x in ("ı", "ß", "²", "①", "З", "Ь")] == ["ı", "ß", "²", "①", "З", "Ь"]  # seen: another letter of the script, digits, other case


def test_popular_text_with_one_variant(spark):
    rows = [(i, "the same note") for i in range(300)] + [(900, "the ѕame note"), (901, "the sаme note"), (902, "another")]
    got = [tuple(r) for r in skeleton.look_alikes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) == 601 and all(a < b for a, b in got)
