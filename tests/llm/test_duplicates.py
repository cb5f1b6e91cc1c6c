import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, exchange, passages, simhash, suffix


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, a text that repeats itself, short and empty ones."""
    r = random.Random(seed)
    rows = [(i, sentence(r, r.choice([3, 40, 120, 300]))) for i in range(40)]
    passage, line = sentence(r, 60), sentence(r, 9)
    rows += [(100 + i, sentence(r, 30) + "\n" + passage + " " + sentence(r, 20)) for i in range(12)]
    rows += [(200 + i, line + "\n" + sentence(r, 80)) for i in range(12)]
    base = sentence(r, 400).split()
    for i in range(12):
        words = base[:]
        words[r.randrange(400)] = "edit"
        rows.append((300 + i, " ".join(words)))
    rows += [(400 + i, rows[2][1]) for i in range(8)] + [(500, "ab cd " * 400), (501, "x" * 3000), (502, "x" * 49), (503, "é" * 200)]
    rows += [(0, rows[0][1]), (600, ""), (601, None), (602, " \n"), (None, rows[5][1]), (None, None), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "g": F.lit(1), "component": F.lit(2)}).repartition(5).cache()


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def united(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_masks_meet_every_pair_within_the_radius():
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), 3):
            b ^= 1 << k
        first = [i for i, m in enumerate(simhash._FIRST) if not (a ^ b) & m % (1 << 64)]
        assert first
        assert all(any(not (a ^ b) & m % (1 << 64) for m in simhash._SECOND[i]) for i in first)
    assert all((m % (1 << 64)).bit_count() >= 46 for row in simhash._SECOND for m in row)


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash_components(df, rows, bucket):
    fps = [fingerprint(t) for _, t in rows]
    root = united(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for k, (i, _) in zip(root, rows):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    want = sorted(str((i, f"{f:016x}", least[k])) for (i, _), f, k in zip(rows, fps, root))
    assert sorted(str(tuple(x)) for x in simhash.near_duplicates(df, bucket=bucket).collect()) == want


def test_simhash_keeps_one_of_each(df, rows):
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    fps = [fingerprint(t) for _, t in rows]
    root = united(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert len(got) == len(set(root))
    assert len({fingerprint(t) for _, t in got}) == len(got)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 301)} == {0} and {got[1000 + k] for k in range(1, 200)} == {1000}


@pytest.mark.parametrize("share", [1 / 2000, 1 / 20, 10])
def test_components_are_brute_force(spark, monkeypatch, share):
    """Random graphs; nodes with many edges are broadcast, some of them, or none."""
    monkeypatch.setattr(common, "SHARE", share)
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(-5, k) for k in range(1000, 1100)] + [(2**62, 2**62 - 1), (3, 3)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    pairs = {(max(a, b), min(a, b)) for a, b in edges}
    root = united(len(nodes), lambda i, j: (nodes[i], nodes[j]) in pairs or (nodes[j], nodes[i]) in pairs)
    least = {}
    for k, x in zip(root, nodes):
        least[k] = min(least.get(k, x), x)
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n: got.get(n, n) for n in nodes} == {n: least[k] for k, n in zip(root, nodes)}


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def removed(rows, length):
    first, texts = {}, [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for j in range(len(b) - length + 1):
            first[b[j : j + length]] = min(first.get(b[j : j + length], 1 << 62), i)
    out = []
    for (doc, _), (i, b) in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0])), hashlib.sha256(left).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("group_bytes, hot, length", [(4 << 20, 4 << 20, 50), (6000, 4 << 20, 50), (6000, 1, 50), (6000, 200, 50), (6000, 100, 17), (1500, 300, 50)])
@pytest.mark.parametrize("bucket", [1 << 20, 300])
def test_repeats(monkeypatch, df, rows, group_bytes, hot, length, bucket):
    """hot: bytes of a minimizer's pieces from which they are cut into strings; few keys a bucket make many buckets, ranges and supergroups."""
    plan = exchange.Plan.of
    monkeypatch.setattr(exchange.Plan, "of", classmethod(lambda cls, keys, own=0: plan(keys, bucket)))
    got = suffix.remove_repeats(df, length, group_bytes=group_bytes, hot_bytes=hot)
    assert sorted(str(tuple(r)) for r in got.collect()) == removed(rows, length)


def test_keys_survive_their_way():
    r = np.random.default_rng(2)
    for buckets in (1, 40, 3000, 1 << 22):
        plan = exchange.Plan.of(buckets * exchange.BUCKET)
        keys = r.integers(0, 1 << 63, 500).astype(np.uint64)
        cut = np.unique(plan.cut(keys))
        code = r.integers(0, 256, len(cut)).astype(np.uint8)
        back = exchange.decoded(exchange.encoded(cut, code, plan.width), plan.width)
        assert (back[0] == cut).all() and (back[1] == code).all()
        assert (np.diff(plan.bucket(cut)) >= 0).all() and plan.bucket(cut).max() < plan.buckets
    sizes = np.array([1, 2, 3, 100, 1e6])
    assert (exchange._sizes(exchange._coded(sizes, np.zeros(5, bool))) >= sizes * 0.999).all() and (exchange._sizes(exchange._coded(sizes, np.ones(5, bool))) <= sizes * 1.2).all()


def test_repeats_give_texts(df, rows):
    got = suffix.remove_repeats(df, texts=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_interval_expansion(seed):
    r = random.Random(seed)
    letters, length = r.choice([b"ab", b"abcd", b"a", bytes(range(256))]), r.choice([2, 3, 5, 9])
    pieces = [bytes(r.choices(letters, k=r.randint(length, 40))) for _ in range(r.randint(1, 60))]
    pieces += pieces[: r.randint(0, 5)]
    strings = [p[j : j + length] for p in pieces for j in range(len(p) - length + 1)]
    classes = suffix.equal_strings(pieces, length)
    assert len(classes) == len(strings) and len(set(zip(strings, classes.tolist()))) == len(set(strings)) == len(set(classes.tolist()))


@pytest.mark.parametrize("group_bytes, hot, bucket", [(4 << 20, 4 << 20, 1 << 18), (6000, 4 << 20, 30), (6000, 1, 1 << 18), (6000, 1, 30)])
def test_passages(monkeypatch, df, rows, group_bytes, hot, bucket):
    plan = exchange.Plan.of
    monkeypatch.setattr(exchange.Plan, "of", classmethod(lambda cls, keys, own=0: plan(keys, bucket)))
    monkeypatch.setattr(exchange, "VAST_HOT", 16 if bucket == 30 else 1)
    got = passages.near_passages(df, group_bytes=group_bytes, hot_bytes=hot).collect()
    assert len(got) == len(rows)
    words = [(t or "").encode().lower().split() for _, t in rows]
    runs = [{tuple(w[j : j + 50]) for j in range(len(w) - 49)} for w in words]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k, (i, _) in enumerate(rows):
        shared = any(runs[k] & runs[j] for j in range(len(rows)) if j != k)
        if i is not None and shared:
            assert all(r["n_passages"] > 0 for r in by[i] if r["n_words"] == len(words[k]))
            for j, (other, _) in enumerate(rows):
                if other is not None and runs[k] & runs[j]:
                    assert by[i][0]["class_id"] == by[other][0]["class_id"]
    for i in [*range(200, 212), 600, 601, 602, 502, 501, 503]:  # a common line and unlike texts aren't near
        assert by[i][0]["n_passages"] == 0 and by[i][0]["class_id"] == i
    assert all(by[i][0]["n_passages"] > 0 for i in range(300, 312))
    assert passages.near_passages(df.limit(0)).count() == 0


def test_spans_hold_the_passage(spark):
    r = random.Random(9)
    p = sentence(r, 55)
    df = spark.createDataFrame([(1, sentence(r, 13) + " " + p), (2, p + " " + sentence(r, 5)), (3, sentence(r, 100))], "doc_id long, text string")
    got = {x["doc_id"]: x for x in passages.near_passages(df).collect()}
    a, b = map(int, got[1]["spans"].split(":"))
    assert a <= 18 and b >= 62 and got[2]["class_id"] == 1 and got[3]["n_passages"] == 0


def test_near_needs_enough_equal_tokens():
    r = np.random.default_rng(1)
    one = r.integers(1, 60000, (1, passages.SPAN)).astype(np.uint16)
    for gap, want in ((0, True), (5, True), (6, True), (30, False)):
        other = one.copy()
        other[0, : passages.WIDTH - 1] = 0
        other[0, passages.WIDTH + 10 : passages.WIDTH + 10 + gap] += 1
        if gap <= 5:
            assert passages.near(one, other).any() == want
    shifted = np.roll(one, 1, axis=1)
    assert passages.near(one, shifted).any()


def test_edited_copies_meet_through_equal_ones():
    """The lowest row and the highest have an edit each and aren't near each other, but both are near the copies between."""
    r = np.random.default_rng(4)
    contexts = np.zeros((4, passages.SPAN), np.uint16)
    contexts[:, 22:68] = r.integers(1, 1 << 15, 46) | 1
    contexts[0, 24:29] += 2
    contexts[3, 60:65] += 2
    links, spans = passages.meet(np.full(4, 8, np.uint64), np.arange(4), np.full(4, 60), contexts)[:2]
    linked = {tuple(x) for x in links.tolist()}
    assert len(set(united(4, lambda i, j: (j, i) in linked))) == 1 and set(spans[:, 0].tolist()) == {0, 1, 2, 3}


@pytest.mark.parametrize("pairs", [32, 2])
@pytest.mark.parametrize("seed", range(8))
def test_meet_is_brute_force(monkeypatch, seed, pairs):
    """Contexts with other edits in each, shifted tails and a line that others go on from: the classes of all near pairs that share a string."""
    monkeypatch.setattr(passages, "PAIRS", pairs, raising=False)
    r = np.random.default_rng(seed)
    bases = [r.integers(1, 1 << 15, passages.SPAN) for _ in range(4)]
    for b in bases[1:]:
        b[30:60] = bases[0][30:60]
    found = []
    for k in range(150):
        x = bases[k % 4].copy()
        if k % 3:
            at = int(r.integers(0, passages.SPAN - 5))
            if k % 5 == 0:
                x[at:] = np.roll(x[at:], 1)
            x[at : at + 5] = r.integers(1, 1 << 15, len(x[at : at + 5]))
        if k % 4 == 3:
            x[: int(r.integers(0, 30))] = r.integers(1, 1 << 15)
            x[60 + int(r.integers(0, 20)) :] = r.integers(1, 1 << 15)
        found.append(x)
    contexts = np.array(found).astype(np.uint16) | np.uint16(1)
    contexts[:, passages.WIDTH - 1] = contexts[0, passages.WIDTH - 1]
    n = len(contexts)
    links, spans = passages.meet(np.full(n, 8, np.uint64), np.arange(n), np.zeros(n, np.int64), contexts)[:2]
    meets = lambda i, j: any((contexts[i, a : a + passages.SHARED] == contexts[j, a : a + passages.SHARED]).all() for a in passages._SHARED_AT)
    near = lambda i, j: passages.near(contexts[j : j + 1], contexts[i : i + 1]).any()
    close = {(j, i) for i in range(n) for j in range(i) if meets(i, j) and near(i, j) and near(j, i)}
    assert {tuple(x) for x in links.tolist()} <= close
    same = lambda roots: [roots.index(x) for x in roots]
    linked = {tuple(sorted(x)) for x in links.tolist()}
    assert same(united(n, lambda i, j: (j, i) in linked)) == same(united(n, lambda i, j: (j, i) in close))
    assert set(spans[:, 0].tolist()) == {x for p in close for x in p}


def test_hot_windows_find_the_same_pairs(spark):
    """Passages of 50 words that differ in a word near the middle: what meets by hash meets by the strings of hot hashes too."""
    r, rows = random.Random(21), []
    for k in range(40):
        base = sentence(r, 50).split()
        for i in range(2):
            words = base[:]
            words[23 + k % 4] = f"edit{i}"
            rows.append((2 * k + i, sentence(r, 12) + " " + " ".join(words) + " " + sentence(r, 12)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, hot = ({x["doc_id"]: (x["class_id"], x["spans"]) for x in passages.near_passages(df, group_bytes=2000, hot_bytes=n).collect()} for n in (4 << 20, 1))
    assert sum(c % 2 == 0 and c != i for i, (c, _) in plain.items()) >= 30 and hot == plain


def test_quotes_before_a_passage_do_not_hide_it(spark):
    """A text that quotes parts of 30 words of a passage of 50, then has it whole, and a text that has it whole."""
    r, rows = random.Random(33), []
    for k in range(100):
        base = sentence(r, 50).split()
        quotes = [" ".join(base[i : i + 30]) + " " + sentence(r, 5) for i in range(21)]
        rows += [(2 * k, " ".join([*quotes, *base, sentence(r, 9)])), (2 * k + 1, " ".join([sentence(r, 9), *base, sentence(r, 9)]))]
    got = {x["doc_id"]: x for x in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, x in got.items() if x["n_passages"] == 0 or x["class_id"] != i // 2 * 2] == []


def jaccard(a, b):
    """The largest similarity of 50 words of one and 50 words of the other, by five-word shingles."""
    sets = [[frozenset(tuple(w[j : j + 5]) for j in range(i, i + 46)) for i in range(len(w) - 49)] for w in (a, b)]
    return max(len(x & y) / len(x | y) for x in sets[0] for y in sets[1])


@pytest.mark.parametrize("hot", [4 << 20, 1])
def test_recall_of_near_passages(spark, hot):
    """Pairs that have 50 words each with a similarity of 0.8, by brute force, in texts that are unlike else: nine in ten of them, at least, are linked."""
    r, rows, want = random.Random(77), [], {}
    for n, edits in ((50, 1), (60, 1), (60, 2), (120, 2), (200, 3), (200, 4)):
        for _ in range(60):
            base = sentence(r, n).split()
            copy = base[:]
            for _ in range(edits):
                at, kind = r.randrange(1, len(copy)), r.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 2 else [f"edit{r.randrange(9)}"]
            a, b = [sentence(r, 8).split() + x + sentence(r, 8).split() for x in (base, copy)]
            want[len(rows)] = (n, edits, jaccard(a, b) >= 0.8)
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in passages.near_passages(df, group_bytes=20000, hot_bytes=hot).collect()}
    by = {}
    for i, (n, edits, near) in want.items():
        if near:
            by.setdefault((n, edits), []).append(got[i + 1] == i)
    shares = {k: (sum(v) / len(v), len(v)) for k, v in by.items()}
    print(shares)
    assert all(n >= 5 and s >= 0.9 for s, n in shares.values()), shares
    assert all(got[i + 1] == i + 1 for i, (_, _, near) in want.items() if not near)
