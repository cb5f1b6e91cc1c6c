import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import quality, sharding


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c a b c\na b c\n\nx"), (4, "a b c a b c\na b c\n\nx"), (None, "# $ <x>"), (5, "word " * 30000), (6, "é ü ß 漢字")]


def brute(text):
    blank = " \t\n\x0b\x0c\r"
    words, w = [], ""
    for ch in (text or "") + " ":
        if ch in blank:
            words, w = words + [w] * bool(w), ""
        else:
            w += ch
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(blank)]
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    df = docs(spark, [r for r in EDGE if r[0] != 5] + [(5, "word " * 3000)])
    got = quality.verdicts(df).collect()
    assert len(got) == len(EDGE)
    texts = dict(df.rdd.map(tuple).collect())
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_the_columns_and_clean_texts(spark):
    good = " ".join(f"the w{i} of and b{i}." for i in range(40))
    df = docs(spark, [(1, good), (2, "### $$$ " * 40), (3, None)]).withColumns({"__q": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(0)})
    got = quality.keep(df)
    assert got.columns == df.columns
    assert [r["doc_id"] for r in got.collect()] == [1]
    assert quality.keep(df.limit(0)).count() == 0 and quality.verdicts(df.limit(0)).count() == 0


def test_sharding(spark):
    df = docs(spark, EDGE + [(7, "hot")] * 20000)
    got = sharding.assign(df.withColumn("shard", F.lit("clash")), [1.0] * 24, [1.0] * 25).collect()
    assert len(got) == len(EDGE) + 20000
    slots, where = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for w in where.values())
    by = {r["doc_id"]: r for r in got}
    for i, t in EDGE:
        b = (t or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"]) == (len(b) + 8, zlib.crc32(b))
    assert sharding.assign(df.limit(0), [1.0]).count() == 0


def test_places_are_brute_force(spark):
    """Rendezvous hashing in plain Python: of all shards the one with the smallest -ln(u) / weight."""
    weights = [1.0] * 24 + [2.5, 0.0]

    def placed(key):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        draws = [(-math.log(((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53) / w, s) for s, w in enumerate(weights) if w]
        return min(draws)[1]

    keys = [None, 0, -1, 2**62, *range(7, 60000, 31)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", sharding.place(F.col("doc_id"), weights).alias("s")).collect()}
    assert got == {k: placed(k) for k in keys}


def test_weights(spark):
    df = spark.range(30000)
    one = df.select(sharding.place(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("s"), sharding.place(F.col("id"), [1.0, 4.0, 0.0, 1.0]).alias("t"))
    n = {r["s"]: r["count"] for r in one.groupBy("s").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] - 15000) < 600 and abs(n[0] - 7500) < 500
    assert one.where("s <> t and t <> 1").count() == 0  # a heavier shard only takes
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), [0.0])
