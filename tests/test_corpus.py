import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, filters, rules, score, shape
from corpusloom.operators.rank import first_of, hash_rank


def records(spark, rows):
    return spark.createDataFrame(rows, "ord long, id string, objective string, language string, input string, output string, context string")


def test_first_failing_rule_names_the_drop(spark):
    df = records(spark, [(1, "a", "x", "en", "ok", "", ""), (2, "b", "x", "xx", "é" * 50, "", ""), (3, "c", "x", "en", "é" * 50, "", ""), (4, "d", "x", None, "ok", "", "")])
    got = {r["id"]: r["reason"] for r in filters.corpus_reasons(df, ["en"]).collect()}
    assert got == {"a": None, "b": "language_filtered", "c": "encoding_filtered", "d": "language_filtered"}
    # 10 of 50 characters, two of them the joining newlines: exactly a fifth is kept
    df = records(spark, [(1, "a", "x", "en", "é" * 10 + "a" * 38, "", "")])
    assert filters.corpus_reasons(df, ["en"]).first()["reason"] is None


def test_exact_dedup_keeps_objectives_apart(spark):
    df = records(spark, [(2, "b", "x", "en", "t", "", ""), (1, "a", "x", "en", "t", "", ""), (3, "c", "y", "en", "t", "", "")])
    kept = dedup.exact(df, ["objective", "language", "input", "output", "context"]).collect()
    assert sorted(r["id"] for r in kept) == ["a", "c"]


def test_greedy_keeps_the_end_of_a_chain(spark):
    base = [f"{i:032x}" for i in range(16)]
    b, c = base[:], base[:]
    b[0:3] = ["x0", "x1", "x2"]
    c[0:3], c[13:16] = b[0:3], ["y0", "y1", "y2"]
    sigs = spark.createDataFrame([(1, base), (2, b), (3, c), (4, base)], "ord long, sig array<string>")
    assert sorted(r[0] for r in dedup.greedy(sigs, 16, 0.8).collect()) == [1, 3]
    assert sorted(r[0] for r in dedup.greedy_windowed(sigs, 0.8).collect()) == [1, 3]


@pytest.mark.parametrize("n, t", [(16, 0.95), (32, 0.95), (64, 0.95), (32, 0.8)])
def test_bands_lose_no_pair(spark, n, t):
    r = random.Random(n)
    rows = []
    for k in range(12):
        base = [str(r.random()) for _ in range(n)]
        rows.append((2 * k, base))
        other = base[:]
        for i in r.sample(range(n), r.randint(0, n - math.ceil(t * n) + 1)):
            other[i] = str(r.random())
        rows.append((2 * k + 1, other))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and sum(p == q for p, q in zip(x, y)) >= math.ceil(t * n - 1e-9)}
    got = dedup.pairs(spark.createDataFrame(rows, "ord long, sig array<string>"), n, t)
    assert {(p["a"], p["b"]) for p in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20, 100])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(f"i{k}", f"r{k % max(n, 1)}", "o") for k in range(3 * n)], "id string, repo string, o string")
    got = shape.split_groups(df, "repo", ["o"]).collect()
    assert len(got) == 3 * n
    if n >= 3:
        by = {}
        for r in got:
            by.setdefault(r["repo"], set()).add(r["split"])
        assert all(len(s) == 1 for s in by.values())
        sizes = [sum(s == {x} for s in by.values()) for x in ("train", "val", "test")]
        a, b = max(1, int(n * 0.85)), max(1, int(n * 0.07))
        assert sizes == ([max(1, n - 2), 1, n - 1 - max(1, n - 2)] if a + b >= n else [a, b, n - a - b])
    elif n:
        assert {r["split"] for r in got} == {"train", "val", "test"}


def test_hash_rank_is_a_ranking_in_any_order(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 3 else "b") for i in range(500)], "id string, g string")
    one = {tuple(r) for r in hash_rank(df, ["g"], "id").collect()}
    assert {tuple(r) for r in hash_rank(df.repartition(7), ["g"], "id").collect()} == one
    for g in "ab":
        ranks = sorted(r for _, x, r in one if x == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_first_of(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "ord long, k string")
    assert sorted(r["ord"] for r in first_of(df, ["k"], "ord").collect()) == [1, 2]


def test_rebalance(spark):
    df = spark.createDataFrame([(f"i{k}", "en" if k < 60 else "de" if k < 90 else "xx") for k in range(100)], "id string, language string")
    got = shape.rebalance(df, {"en": 0.255, "de": 0.9}).groupBy("language").count().collect()
    assert {r[0]: r[1] for r in got} == {"en": 25, "de": 30}
    with pytest.raises(Exception, match="no rows"):
        shape.rebalance_least(df, ["en", "fr"]).collect()
    with pytest.raises(Exception, match="empty"):
        shape.collapse_guard(df.withColumn("split", F.lit("train"))).collect()


def test_metadata(spark):
    df = spark.createDataFrame([(1, '{"n": 1, "s": "x", "f": true}'), (2, '{"n": 2.5, "s": null}'), (3, "no object")], "ord long, metadata string")
    assert {r["key"]: r["kind"] for r in shape.metadata_types(df).collect()} == {"n": "double", "s": "string", "f": "boolean"}
    got = [r["metadata"].asDict() for r in shape.metadata_filled(df, {"n": "double", "s": "string", "f": "boolean"}).orderBy("ord").collect()]
    assert got == [{"f": True, "n": 1.0, "s": "x"}, {"f": False, "n": 2.5, "s": None}, {"f": False, "n": 0.0, "s": ""}]


def test_leaks_and_verdict(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("a", "test"), ("b", "val")], "id string, split string")
    assert [tuple(r) for r in rules.leaks(df, "id").collect()] == [("a", "test,train")]
    checks = spark.createDataFrame([("s", "x", True), ("s", "y", False)], "section string, name string, ok boolean")
    assert tuple(rules.verdict(checks).first()) == (False, 1, "s.y")


def test_broken_rows(spark):
    df = spark.createDataFrame([(1.0, [1.0]), (float("nan"), [1.0]), (1.0, [None]), (float("inf"), [1.0])], "a double, b array<double>")
    assert [r[0] for r in df.select(filters.broken(df.schema)).collect()] == [False, True, True, False]
    assert [r[0] for r in df.select(filters.broken(df.schema, True)).collect()] == [False, True, True, True]


def test_syntax(spark):
    rows = [(1, "a", "code_gen", "python", "def f():\n    return 1", "", ""), (2, "b", "code_gen", "python", "def f(:", "", ""), (3, "c", "bug_detection", "java", "class A { int x( {", "", ""), (4, "d", "bug_fix", "java", "", "", ""), (5, "e", "code_gen", "xx", "x", "", "")]
    got = {r["id"]: r["kept"] for r in filters.syntax_kept(records(spark, rows)).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_scores(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b c", "a b c"), (3, "", "x"), (4, "the cat sat on the mat", "the cat is on the mat")], "k long, c string, r string")
    got = {r["k"]: r["bleu"] for r in score.bleu(df, "k", "c", "r").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0 and 0 < got[4] < 1
    rouge = {r["k"]: r["x"] for r in df.select("k", score.rouge_l("c", "r").alias("x")).collect()}
    assert rouge == {1: 1.0, 2: 1.0, 3: 0.0, 4: pytest.approx(10 / 12)}


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(50):
        a, b = [r.choice("abc") for _ in range(r.randint(0, 9))], [r.choice("abc") for _ in range(r.randint(0, 9))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert score.common_subsequence(a, b) == t[-1][-1]


@pytest.mark.parametrize("band", [2, 5, 256])
@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_pairs_of_crowded_bands_are_brute_force(spark, band, threshold):
    """Signatures of few symbols, so that bands are shared by many: cut up, in blocks or at once, all similar pairs are found, each once."""
    import random

    r = random.Random(int(band * threshold * 100))
    base = [r.choice("ab") for _ in range(8)]
    rows = []
    for i in range(70):
        sig = base[:] if i % 2 else [r.choice("ab") for _ in range(8)]
        for _ in range(r.randrange(3)):
            sig[r.randrange(8)] = r.choice("abcdef")
        rows.append((i, sig))
    first = {}
    for i, sig in rows:
        first.setdefault(tuple(sig), i)
    reps = sorted((i, s) for s, i in first.items())
    want = {(i, j) for i, s in reps for j, t in reps if i < j and sum(x == y for x, y in zip(s, t)) / 8 >= threshold}
    got = dedup.pairs(spark.createDataFrame(rows, "ord long, sig array<string>"), 8, threshold, band).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)


def test_common_subsequences_by_bits():
    """Against the table of lengths, on texts of few and many tokens."""
    import random

    r = random.Random(3)
    for n in (0, 1, 5, 63, 64, 65, 150):
        a, b = (r.choices("abcdefgh", k=r.randrange(n + 1)) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert score.common_subsequence(a, b) == rows[-1][-1]
