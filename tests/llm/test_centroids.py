"""Centroid clustering against plain Python in whole numbers."""

import hashlib
import math
import random

from corpusloom.llm import centroids

KIND = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(middle)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), middle


def vectors(n, dims, seed=2):
    dice = random.Random(seed)
    single = lambda x: round(x * 4096) / 4096  # noqa: E731  the same as a float
    return [(i, [single(dice.gauss(i % 5, 0.3)) for _ in range(dims)]) for i in range(n)]


def check(spark, rows, k=4, rounds=5, dims=6):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", q int, EMBEDDING string").repartition(3)
    found = centroids.cluster(df, k=k, rounds=rounds, dims=dims)
    members, middle = brute(rows, k, rounds, dims)
    assert sorted((tuple(r) for r in found.members.collect()), key=str) == members
    assert found.centroids == middle and sum(found.n) == len(members) and sum(found.inertia) == sum(m[2] for m in members)


def test_against_plain_python(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [float("nan")] + [1.0] * 5), (906, [float("-inf")] + [1.0] * 5), (907, [1e30] + [-1e30] * 5), (None, [0.5] * 6), (908, [-0.0001] * 6)]
    check(spark, vectors(200, 6) + bad)


def test_hot_vectors_and_repeated_rows(spark):
    rows = vectors(60, 6) + [(1000 + i, [0.25] * 6) for i in range(500)] + [(7, [3.0] * 6)] * 5
    check(spark, rows)
    check(spark, rows, k=200, rounds=3)


def test_few_and_no_vectors(spark):
    check(spark, vectors(2, 6))
    check(spark, [(1, None)])
    none = centroids.cluster(spark.createDataFrame([], KIND))
    assert none.members.count() == 0 and none.centroids == []
