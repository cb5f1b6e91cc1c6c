import hashlib
import itertools
import math
import random
import re
import secrets as rs
import statistics
import time

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, secrets, toxicity

EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x" * 40000), (5, "漢字 🙂 é"), (6, "the cat " * 4000)]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(*bpe.default_files())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=bpe.default_files()[1], mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'srevlmdt\n\t1漢é-_!", max_size=120) | st.text(max_size=60).filter(lambda t: t.isprintable() or True))
def test_bpe_is_the_librarys(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    leaves = bpe.TEXT_LEAF, bpe.PIECE_LEAF
    bpe.TEXT_LEAF, bpe.PIECE_LEAF = 8, 6
    codec.known.clear()
    try:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    finally:
        bpe.TEXT_LEAF, bpe.PIECE_LEAF = leaves


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 20000, " " * 20000, "'" * 9000, "é" * 9000])
def test_bpe_of_pieces_without_breaks(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_bpe_rows(spark, library):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    made = bpe.encode(df, *bpe.default_files())
    got = made.collect()
    texts = dict(EDGE)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["payload"]) for r in bpe.decode(made, *bpe.default_files()).collect()}
    assert back[5] == texts[5].encode()
    assert len(got) == len(EDGE) and bpe.encode(df.limit(0), *bpe.default_files()).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits(doc, items, size=10):
    w, hit, found = words_of(doc), set(), set()
    for i, t in items:
        v = words_of(t)
        n = min(size, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(i)
    return len(w), len(hit), len(found - {None}), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination(spark, bound):
    r = random.Random(2)
    vocabulary = ["The", "cat", "sat", "é", "x1", "on-a", "mat."]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30])] + [(None, "cat cat cat cat"), (20, None), (5, "zz " * 12)]
    rows = [(i, " ".join(r.choices(vocabulary[1:4], k=r.randint(0, 60)))) for i in range(20)] + [(100, items[6][1] + " " + items[4][1]), (101, None), (102, ""), (102, ""), (103, "ZZ  zz," * 30)]
    df, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(df, b, most_words=bound).collect()
    assert sorted(map(str, [(x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in got])) == sorted(map(str, [(i, *hits(t, items)) for i, t in rows]))
    clean = decontaminate.clean(df.withColumn("row", F.lit(1)), b, most_words=bound)
    assert clean.columns == ["doc_id", "text", "row"]
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(i for i, t in rows if not hits(t, items)[1])
    assert decontaminate.scan(df, b.limit(0), most_words=bound).where("contaminated").count() == 0
    assert decontaminate.scan(df.limit(0), b, most_words=bound).count() == 0


CASES = [
    ("password=abc123", "assign:0:15"), ("password=abc", ""), ('API_KEY : "q_r+/=.x"', "assign:0:19"), ("secret=token: abcdefgh", ""), ("tokeN=abcdefg secret:'zzzzzz'", "assign:0:13,assign:14:28"),
    ("AKIA" + "A" * 15, ""), ("é AKIA" + "A" * 16, "access:2:22"), ("x" + "0a" * 12, "hex:1:25"), ("0a" * 11, ""), ("paſſword=abcdefg", ""), ("token = " + "ab12" * 6, "assign:0:32,hex:8:32"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_fixed_patterns(text, want):
    assert secrets._joined([s for s in secrets.spans(text) if s[1] < 3]) == want


def naive_spans(text):
    """The three fixed patterns, read letter by letter."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    def assigned(at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                end = at + len(name)
                end += text[end : end + 1] in ("'", '"') and end < len(text)
                end = run(end, " ")
                if text[end : end + 1] not in (":", "=") or end == len(text):
                    continue
                # The value may begin with = or at the first letter after blanks and a quotation mark
                end = run(end + 1, " ")
                if end < len(text) and text[end] in "'\"":
                    end += 1
                if run(end, value) > end:
                    return end, run(end, value)
        return None

    found, at = [], 0
    while at < len(text):
        if got := assigned(at):
            if got[1] - got[0] >= 6:
                found.append((at, 0, got[1]))
            at = got[1]
        else:
            at += 1
    for kind, start, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(start), letters) if text.startswith(start, at) else at
            if end > at + len(start):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(found)


def test_fixed_patterns_are_the_naive_ones():
    r = random.Random(12)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", "'", '"', "AKIA", "AKIA" + "Z9" * 8, "0a" * 12, "0f" * 13, "abc", "x.y-z", "\n", "é", "ſ", "q/" * 4, "F00D", "\t"]
    n = 0
    for _ in range(20000):
        text = "".join(r.choices(parts, k=r.randint(1, 9)))
        want = naive_spans(text)
        n += len(want)
        assert [s for s in secrets.spans(text) if s[1] < 3] == want, text
    assert n > 5000


@pytest.mark.parametrize("letters", sorted({x[1] for x in secrets.ENCODINGS}))
def test_even_tokens_of_any_length(letters):
    for n in range(1, 400):
        name, chance, text = secrets.battery(letters * n)
        assert 0 <= chance <= 1 and 0 <= text <= 1
    assert secrets.spans(" " + letters * 49) is not None


def test_random_strings_are_found_and_text_is_not():
    found = sum(bool(secrets.random_spans(f"see {rs.token_urlsafe(30)} here")) for _ in range(200))
    assert found >= 190
    r = random.Random(4)
    common = "internationalization straightforwardness misunderstanding responsibilities characteristically".split()
    texts = ["".join(r.choices(common, k=2)) for _ in range(100)] + ["/".join(r.choices(common, k=3)) for _ in range(100)] + ["_" * 40, "aaaa" * 10, "1234567890123456789"]
    assert sum(bool(secrets.random_spans(t)) for t in texts) <= 4


def test_chi_squared_approximation():
    r = np.random.default_rng(1)
    for df, far in ((15, 0), (15, 30), (63, 120)):
        x = r.noncentral_chisquare(df, far, 20000) if far else r.chisquare(df, 20000)
        for q in (0.05, 0.5, 0.95):
            assert abs(secrets._below(float(np.quantile(x, q)), df, far) - q) < 0.02


def naive_battery(token):
    """The three tests over a token, from counts of their own, and the chance as text."""
    name, letters, same = next((n, x, same) for n, x, same in secrets.ENCODINGS if set(token) <= set(x))
    n, k = len(token), len(letters)
    places = [letters.index(c) for c in token]
    chi = sum((places.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    phi = statistics.NormalDist().cdf

    def below(x, df, far):  # of a noncentral chi-squared, by the cube root
        scale = (df + 2 * far) / (df + far)
        free = (df + far) ** 2 / (df + 2 * far)
        return phi(((max(x, 0) / scale / free) ** (1 / 3) - 1 + 2 / 9 / free) / math.sqrt(2 / 9 / free))

    middle = sorted(places)[n // 2]
    sides = "".join("+" if p >= middle else "-" for p in places)
    runs, high = len(list(itertools.groupby(sides))), sides.count("+")
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    run_chance = 2 * phi(-abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    apart = np.array(places) - np.mean(places)
    total = float(apart @ apart)
    serial = 2 * phi(-abs((float(apart[:-1] @ apart[1:]) / total * n + 1) / math.sqrt(n))) if total else 0.0
    return name, min(1.0, 3 * min(1 - below(chi, k - 1, 0), run_chance, serial)), below(chi, k - 1, n * (k * same - 1))


def naive_random(text):
    found = [(naive_battery(m[0]), m.span()) for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text) if not m[0].isdigit() and any(set(m[0]) <= set(x) for _, x, _ in secrets.ENCODINGS)]
    ranked = sorted(found, key=lambda f: (f[0][2], f[0][1], f[1]))
    good = [i for i, f in enumerate(ranked) if f[0][2] <= 0.01 * (i + 1) / len(ranked)]
    return sorted(f[1] for f in ranked[: max(good, default=-1) + 1] if f[0][1] >= 0.001)


def test_the_battery_is_the_naive_one():
    r = random.Random(8)
    for _ in range(400):
        letters = r.choice(secrets.ENCODINGS)[1]
        token = "".join(r.choices(letters[: r.choice([3, len(letters)])], k=r.randrange(16, 80)))
        if not token.isdigit():
            got, want = secrets.battery(token), naive_battery(token)
            assert got[0] == want[0] and got[1:] == pytest.approx(want[1:], abs=1e-9)
    words = "internationalization straightforwardness ab_cd_ef_gh_ij_kl 1234567890123456 path/to/some/other/file".split()
    n = 0
    for _ in range(150):
        text = " ".join(r.choice(words) if r.random() < 0.6 else "".join(r.choices(r.choice(secrets.ENCODINGS)[1], k=r.randrange(16, 60))) for _ in range(r.randrange(1, 12)))
        want = naive_random(text)
        n += len(want)
        assert sorted(secrets.random_spans(text)) == want
    assert n > 200


def test_many_secrets_of_one_text_take_linear_time():
    """Spans of some megabytes of secrets, each random one inside a base span or not: in seconds, and the same as by all pairs."""
    r = random.Random(5)
    letters = secrets.ENCODINGS[5][1]
    lines = [f"password = {''.join(r.choices(letters, k=40))} and {''.join(r.choices(letters, k=24))}" for _ in range(400)]
    text = "\n".join(lines)
    base = [s for s in secrets.spans(text) if s[1] < 3]
    inside = lambda a, b: any(x <= a and b <= y for x, _, y in base)
    assert [s for s in secrets.spans(text) if s[1] == 3] == sorted((a, 3, b) for a, b in secrets.random_spans(text) if not inside(a, b))
    began = time.monotonic()
    found = secrets.spans("\n".join(lines * 40))
    assert len(found) > 16000 and time.monotonic() - began < 40


def test_secret_rows(spark):
    rows = EDGE + [(9, "token=" + "ab12" * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[9]["n_assign"], got[9]["n_hex"]) == (1, 1)
    out = secrets.redact(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()}[9] == "[SECRET]"
    assert secrets.redacted("a token=abcdef b") == "a [SECRET] b" and secrets.redacted(None) is None
    assert secrets.scan(df.limit(0)).count() == 0


def graded(n, r):
    bad = {1: ["meh"], 2: ["nasty", "mean"], 3: ["vile", "cruel", "foul"]}
    out = []
    for i in range(n):
        g = r.randrange(4)
        words = [f"w{r.randrange(300)}" for _ in range(30)] + [w for k in range(1, g + 1) for w in bad[k]]
        r.shuffle(words)
        out.append((i, " ".join(words), g))
    return out


def test_ordinal_grades_on_held_out_texts(spark):
    r = random.Random(7)
    rows = graded(900, r)
    df = spark.createDataFrame([x[:2] for x in rows] + EDGE[:2], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:600]] + [(None, 1), (3, None), (4, 9)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, 4)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {x["doc_id"]: x for x in toxicity.predict(df.withColumn("grade", F.lit("c")), model).collect()}
    held = rows[600:]
    assert sum(got[i]["grade"] == g for i, _, g in held) / len(held) > 0.9
    assert sum(abs(got[i]["severity"] - g) for i, _, g in held) / len(held) < 0.35
    assert toxicity.predict(df.limit(0), model).count() == 0
    assert toxicity.train(df, labels.limit(0), 4).weights == {}


def test_toxic_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(df, labels.where("doc_id % 5 <> 0"))
    held = toxicity.predict(df, model).join(labels.where("doc_id % 5 = 0").withColumnRenamed("toxic", "label"), "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in held.groupBy("label", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.85
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) <= 0.01


def test_shares_of_grades_do_not_depend_on_the_sample(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices("abcdefghijkl", k=6))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    for cap in (4000, 100):
        got = toxicity.predict(df, toxicity.train(df, labels, rows_per_grade=cap)).collect()
        assert abs(sum(x["severity"] for x in got) / len(got) - 0.1) < 0.05


@pytest.mark.parametrize("texts", [[], ["", "", "", "", "", ""], ["same words here"] * 20, ["a b", "c d", "e f", "g h"]])
def test_without_features_the_model_has_the_shares(texts):
    grades = np.array([int(i % 4 == 0) for i in range(len(texts))], int)
    model = toxicity.fit([np.array(sorted(toxicity.features(t)), np.uint32) for t in texts], grades, 2)
    assert len(model.thresholds) == 1 and all(np.isfinite(model.thresholds))
    severity, grade = model.predict(np.zeros(2))
    assert np.isfinite(severity).all()


def test_an_id_of_many_rows_sends_one_text_to_the_driver(spark, monkeypatch):
    """A third of all rows have one id; the driver gets one row for each label row that is fitted, and bounded bytes."""
    rows = [(7, f"word{i} filler") for i in range(3000)] + [(i, f"word{i} calm") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1)] + [(i, 0) for i in range(100, 200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, grades, n, counts: seen.append((len(texts), sum(t.nbytes for t in texts), grades.tolist(), counts)))
    toxicity.train(df, labels)
    assert seen[0][0] == 102 and seen[0][2].count(1) == 2
    toxicity.train(df, labels, bytes_per_grade=200)
    assert seen[1][1] <= 400 and abs(seen[1][3].sum() - 102) < 1e-9


def test_a_benchmark_of_blanks_or_vast_words_is_not_collected(spark):
    """Few words, many bytes: the join takes over, with the same hits."""
    plain = spark.createDataFrame([("a", "one two three"), ("b", "four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "Four!"), (3, "five"), (4, None)], "doc_id long, text string")
    want = sorted(map(str, decontaminate.scan(docs, plain).collect()))
    for vast in (F.concat(F.repeat(F.lit(" "), decontaminate.MOST_BYTES), F.lit("nine")), F.repeat(F.lit("w"), decontaminate.MOST_BYTES + 1)):
        more = plain.unionByName(spark.range(1).select(F.lit("c").alias("item_id"), vast.alias("text")))
        assert not decontaminate._small(more.select("text"), decontaminate.MOST_WORDS) and decontaminate._small(plain, decontaminate.MOST_WORDS)
        assert sorted(map(str, decontaminate.scan(docs, more).collect())) == want
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, more).collect()) == [3, 4]


def test_a_benchmark_at_the_bound_stays_in_bytes(monkeypatch):
    """Windows of random words, the worst case: what is broadcast and its pickle stay below what the bound says."""
    import pickle

    r = random.Random(3)
    items = [(str(i), " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(2000))) for i in range(20)]
    held = decontaminate.Windows(items, 10)
    n = 20 * 2000
    assert held.nbytes() <= n * 224 and len(pickle.dumps(held)) <= n * 224
    assert held.scan(items[3][1])[1].all() and held.scan(items[3][1])[2] == {"3"}
