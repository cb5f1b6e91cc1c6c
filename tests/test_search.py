"""Searches by stored structures give the rows of the scans, and read less."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, inverted, retrieve, vector


def files_read(df):
    """Files that the scans of a query read, by Spark's own count."""
    df.collect()
    found, steps = 0, [df._jdf.queryExecution().executedPlan()]
    while steps:
        step = steps.pop()
        kind = step.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            steps.append(step.executedPlan())
        elif kind.endswith("QueryStageExec"):
            steps.append(step.plan())
        elif kind == "FileSourceScanExec":
            found += step.metrics().apply("numFiles").value()
        below = step.children()
        steps += [below.apply(i) for i in range(below.size())]
    return found


WORDS = ["alpha", "beta", "Gamma", "naïve", "x", "ab", "the", "the", "the", "füße", "日本語", "🙂🙂🙂"]


@pytest.fixture(scope="module")
def texts(spark):
    dice = random.Random(4)
    rows = [(i, " ".join(dice.choices(WORDS, k=dice.randrange(8))) or None, f"src/{dice.choice(['One', 'two'])}/f{i}.py", ["lib", None]) for i in range(120)] + [(500, "zebra crossing", None, None)]
    return spark.createDataFrame(rows, "id long, content string, file_path string, imports array<string>").cache()


def test_postings_find_what_a_scan_finds(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(texts, path, parts=8)
    for symbols, fragments in ((["Zebra"], []), (["GAMMA", "naïve"], []), (["日本語"], ["one"]), (["🙂🙂"], []), (["the alp", "nothing here"], []), ([], ["f11"]), (["lib"], []), (["qqq"], ["zzz"]), ([], [])):
        want = retrieve.keyword_search(texts, symbols, fragments, 30).select("id", "score", "content").collect()
        assert inverted.search(spark, path, symbols, fragments, 30).select("id", "score", "content").collect() == want, (symbols, fragments)


def test_postings_read_few_files(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(texts, path, parts=8)
    rare, frequent = (files_read(inverted.search(spark, path, [w], [], 500)) for w in ("zebra", "the"))
    assert rare < frequent / 2
    lists = spark.read.parquet(f"{path}/grams")
    assert files_read(lists.where("part = 3")) < files_read(lists) / 4


def test_grams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("ababab",), ("é🙂x日",)], "t string")
    assert [sorted(r[0]) for r in df.select(inverted.grams(F.col("t"))).collect()] == [[], [], ["abc"], ["aba", "bab"], sorted(["é🙂x", "🙂x日"])]


def points_of(spark, n, dim=8):
    dice = random.Random(7)
    middles = [[dice.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [x + dice.gauss(0, 0.03) for x in middles[i % 12]]) for i in range(n)]
    return rows + [(9000 + i, rows[5][1]) for i in range(40)]


ODD = [(9990, [0.0] * 8), (9991, [1.0, 2.0]), (9992, None), (9993, []), (9994, [-float(x) for x in range(1, 9)]), (9995, [1e-200] * 8)]


def test_cells_find_what_a_scan_finds(spark, tmp_path):
    rows = points_of(spark, 400) + ODD
    points = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    path = str(tmp_path / "c")
    cells.build(points, path, 10)
    asked = points.where("id % 37 = 0 or id = 5 or id in (9990, 9991, 9994)").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    plain = points.where("vector is not null")
    for k, batch in ((1, 1024), (7, 5)):
        got = sorted(map(tuple, cells.search(spark, path, asked, k, batch).select("query", "id", F.round("score", 9), "rank").collect()))
        assert got == sorted(map(tuple, vector.search_batch(plain, asked, k).select("query", "id", F.round("score", 9), "rank").collect()))
    assert cells.search(spark, path, asked.limit(0), 3).count() == 0


def test_cells_score_few_points(spark, tmp_path):
    points = spark.createDataFrame(points_of(spark, 1200), "id long, vector array<double>")
    path = str(tmp_path / "c")
    cells.build(points, path, 24)
    asked = points.where("id % 100 = 7").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    assert cells.share_scored(spark, path, asked, 5) < 0.2
    assert math.isclose(spark.read.parquet(f"{path}/cells").agg(F.sum("n")).first()[0], 1240)


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<double>")
    cells.build(none, str(tmp_path / "c"), 4)
    asked = spark.createDataFrame([(1, [1.0])], "query long, qv array<double>")
    assert cells.search(spark, str(tmp_path / "c"), asked, 2).count() == 0
    none = spark.createDataFrame([], "id long, content string")
    inverted.build(none, str(tmp_path / "i"), parts=2)
    assert inverted.search(spark, str(tmp_path / "i"), ["abc"], ["ab"], 5).count() == 0 and inverted.search(spark, str(tmp_path / "i"), ["abc"], [], 5).columns == ["id", "content", "score"]
