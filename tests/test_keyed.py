"""Streams with state by key, over restarts."""

import datetime

from corpusloom.streaming import keyed

START = datetime.datetime(2026, 1, 1)


def scan(spark, top, rows):
    df = spark.createDataFrame([(p, s, START + datetime.timedelta(minutes=m)) for p, s, m in rows], "path string, sha256 string, seen timestamp")
    df.coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{top}/in")
    keyed.run(keyed.tracked(stream, 60_000), f"{top}/c", f"{top}/out")
    return spark.read.parquet(f"{top}/out")


def told(df):
    return sorted((r["path"], r["at"], r["change"], r["sha256"]) for r in df.collect())


def test_files_that_are_gone_are_told_once(spark, tmp_path):
    zero = int(START.timestamp() * 1000)
    scan(spark, tmp_path, [("a", "1", 0), ("b", "1", 0), (None, "0", 0)])
    scan(spark, tmp_path, [("a", "2", 5), ("a", "1", 4)])
    changes = scan(spark, tmp_path, [("a", "2", 5.5), ("c", None, 5.5)])
    # b and the null path go a minute after they were seen; a comes again and has changed
    want = [("a", zero, "indexed", "1"), ("b", zero, "indexed", "1"), ("b", zero + 60_000, "removed", None), ("c", zero + 330_000, "indexed", "")]
    got = [x for x in told(changes.where("path is not null"))]
    assert [x for x in got if x[0] in ("b", "c")] == [x for x in want if x[0] in ("b", "c")]
    assert [x[2:] for x in got if x[0] == "a"][0] == ("indexed", "1") and [x[2:] for x in got if x[0] == "a"][-1] == ("indexed", "2")
    assert changes.where("path is null").count() == 2
    assert {(r["path"], r["sha256"]) for r in keyed.current(changes).collect()} == {("a", "2"), ("c", "")}
    again = scan(spark, tmp_path, [("b", "1", 6)])
    assert told(again.where("path = 'b'"))[-1] == ("b", zero + 360_000, "indexed", "1")


def test_caps_hold_over_restarts(spark, tmp_path):
    for batch in range(3):
        spark.createDataFrame([(k, batch * 10 + i) for i in range(10) for k in ("x", "y")] + [("z", batch)], "k string, v long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "in"))
        keyed.run(keyed.capped(stream, "k", 12), str(tmp_path / "c"), str(tmp_path / "out"))
        counts = {r["k"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("k").count().collect()}
        assert counts == {"x": min(12, 10 * batch + 10), "y": min(12, 10 * batch + 10), "z": batch + 1}


def test_state_grows_by_buckets_not_by_files(spark, tmp_path):
    changes = scan(spark, tmp_path, [(f"f{i}", str(i), 0) for i in range(6000)])
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert held.count() <= 4096 and held.selectExpr("sum(size(value.files))").first()[0] == 6000
    assert changes.count() == changes.where("change = 'indexed' and sha256 = substr(path, 2)").count() == 6000


def test_files_of_one_bucket_end_each_at_its_time(spark, tmp_path):
    zero, out = int(START.timestamp() * 1000), str(tmp_path / "out")
    for rows in ([("a", "1", 0), ("b", "1", 0.5), ("c", "1", 2)], [("c", "1", 2.5), (None, "1", 2.5), ("d", "1", 3)], [("d", "2", 4)]):
        df = spark.createDataFrame([(p, s, START + datetime.timedelta(minutes=m)) for p, s, m in rows], "path string, sha256 string, seen timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keyed.run(keyed.tracked(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60_000, buckets=1), str(tmp_path / "c"), out)
        got = {(r["path"], r["at"] - zero) for r in spark.read.parquet(out).where("change = 'removed'").collect()}
        # after the first scan the watermark stands at minute 2, after the second at 3, after the third at 4: what ends just then is still there
        assert got == {2: {("a", 60_000), ("b", 90_000)}, 3: {("a", 60_000), ("b", 90_000)}, 4: {("a", 60_000), ("b", 90_000), ("c", 210_000), (None, 210_000)}}[int(rows[-1][2])]
    told = [(r["path"], r["sha256"]) for r in spark.read.parquet(out).where("change = 'indexed'").orderBy("at", "path").collect()]
    assert told == [("a", "1"), ("b", "1"), ("c", "1"), (None, "1"), ("d", "1"), ("d", "2")]
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert [r["value"]["files"] for r in held.collect()] == [["d"]]
