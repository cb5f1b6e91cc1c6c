import glob
import hashlib
import os
import sys

import duckdb
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from corpusloom.llm import bpe, catalog, decontaminate, secrets  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert columns == df.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, result.fetchall()))


def test_stages_against_brute_force(spark, sf):
    """Each stage on its own input, from the tables."""
    from .test_duplicates import fingerprint, united
    from .test_native import brute
    from .test_text_ops import hits

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            for i, r in before.items():
                n, _, _, _, again = brute(r["text"])
                if n < 50 or 100 * again > 50 * n:
                    assert i not in after
            labels = dict(map(tuple, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id", "quality").collect()))
            assert all(i in after for i, r in before.items() if i in labels and brute(r["text"])[0] >= 50 and 100 * brute(r["text"])[4] <= 50 * brute(r["text"])[0])
        elif k == 1:
            ids = sorted(before)
            fps = [fingerprint(before[i]["text"]) for i in ids]
            root = united(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
            assert set(after) == {min(i for i, q in zip(ids, root) if q == p) for p in set(root)}
        elif k == 2:
            held = decontaminate.Windows([(str(i), t) for i, t in items], 10)
            for i, r in before.items():
                assert (i in after) == (not held.scan(r["text"])[1].any())
            some = sorted(before)[:3] + sorted(set(before) - set(after))[:2]
            assert all(hits(before[i]["text"][:3000], items)[4] == held.scan(before[i]["text"][:3000])[1].any() for i in some)
        elif k == 3:
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["text"] == secrets.redacted(before[i]["text"]) and r["n_chars"] == len(r["text"])
        else:
            codec = bpe.Codec.load(*bpe.default_files())
            library = tiktoken.Encoding("own", pat_str=bpe.default_files()[1], mergeable_ranks=codec.ranks, special_tokens={})
            for i, r in after.items():
                assert r["token_ids"] == library.encode_ordinary(before[i]["text"])
                assert r["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(after)


GOOD = "the cat and a dog of this house are with us for it is on that we have "


def edge_rows():
    """Null and empty texts, null ids, repeated rows, ties, a long text, a benchmark passage, a secret."""
    import random

    r = random.Random(8)
    words = lambda n: " ".join(r.choice(["the", "and", *("".join(r.choices("abcdefgh", k=5)) for _ in range(9))]) for _ in range(n))
    long, passage, plain = words(30000), words(12), words(90)
    rows = [(1, None), (2, ""), (3, " \n "), (4, plain), (4, plain), (5, plain), (None, plain), (6, long), (7, words(70) + " " + passage + " " + words(20)), (8, words(80) + " token=abcdef12345 " + words(9)), (None, None)]
    return [(i, t, "en", "s", None if t is None else len(t), "clash", 3, "x") for i, t in rows], passage


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __kept string, row long, fingerprint string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_cases(spark, tmp_path, empty):
    rows, passage = edge_rows()
    docs = spark.createDataFrame([] if empty else rows, SCHEMA)
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sizes, texts = [], {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 1:  # the stages behind the rules get null and empty texts too
            docs = spark.createDataFrame([] if empty else rows, SCHEMA)
        out = stage(spark, docs.repartition(3), str(tmp_path))
        held = out.collect()
        sizes.append(len(held))
        if k < 4:
            assert out.columns == docs.columns
            texts[k] = sorted(((r["doc_id"], r["text"]) for r in held), key=str)
            out.write.parquet(str(tmp_path / f"stage{k}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        else:
            assert len({r["doc_id"] for r in held}) == len({i for i, _ in texts[3]})
    if empty:
        assert sizes == [0] * 5
        return
    plain = rows[3][1]
    assert [i for i, _ in texts[0]] == [4, 4, 5, 6, 7, 8, None] and sizes[0] == 7  # null and empty texts go, repeated rows don't
    assert [i for i, _ in texts[1]] == [1, 4, 6, 7, 8]  # of empty ones the smallest id, of equal ones one row
    assert [i for i, _ in texts[2]] == [1, 4, 6, 8] and dict(texts[2])[1] is None  # a null text has no window
    assert "[SECRET]" in dict(texts[3])[8] and dict(texts[3])[4] == plain and dict(texts[3])[1] is None
    assert sizes[4] == 4


def test_shuffled_frames_are_cut(spark, tmp_path):
    """Frames of rows that Python or an RDD gives are cut too: only files and checkpoints give the same order each time."""
    from corpusloom.llm import common

    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    for odd in (df.repartition(4), df.distinct(), df.repartition(4).cache(), df.orderBy("text"), df.limit(9), df, spark.createDataFrame(df.rdd.repartition(3), df.schema)):
        assert not common.plain_scan(odd) and common.plain_scan(common.settled(odd))
    df.write.parquet(str(tmp_path / "p"))
    plain = spark.read.parquet(str(tmp_path / "p")).where("doc_id > 3").select("doc_id")
    assert common.settled(plain) is plain
