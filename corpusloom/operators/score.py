"""Scores of predictions: BLEU, ROUGE-L, exact match, tables by objective."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import col


def _clipped(candidate: list[str], reference: list[str], longest: int) -> list[dict]:
    """Of the n-grams of each length up to longest, those of the candidate that the reference has too, each at most as often as there, and all of the candidate."""
    out = []
    for n in range(1, longest + 1):
        a, b = (Counter(zip(*(words[k:] for k in range(n)))) for words in (candidate, reference))
        out.append({"n": n, "overlap": sum(min(x, b[g]) for g, x in a.items() if g in b), "total": sum(a.values())})
    return out


def counted(candidate: Column | str, reference: Column | str, longest: int = 4) -> Column:
    """struct(candidate_len, reference_len, grams: array of (n, overlap, total)) of two texts. A row's counts need no other row: nothing is shuffled."""

    @F.pandas_udf("array<struct<n:int,overlap:long,total:long>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_clipped(list(x), list(y), longest) for x, y in zip(a, b)])

    words = [X.eval_tokens(F.coalesce(col(c), F.lit(""))) for c in (candidate, reference)]
    return F.struct(F.size(words[0]).alias("candidate_len"), F.size(words[1]).alias("reference_len"), run(*words).alias("grams"))


def overlaps(df: DataFrame, key: str, candidate: str, reference: str, longest: int = 4) -> DataFrame:
    """(key, n, overlap, total, candidate_len, reference_len): clipped n-gram overlaps."""
    held = df.select(key, counted(candidate, reference, longest).alias("x"))
    return held.select(key, "x.candidate_len", "x.reference_len", F.explode("x.grams").alias("g")).select(key, "g.n", "g.overlap", "g.total", "candidate_len", "reference_len")


def bleu(df: DataFrame, key: str, candidate: str, reference: str, longest: int = 4, smoothing: float = 1.0) -> DataFrame:
    """(key, bleu): geometric mean of smoothed precisions of 1 to longest tokens, times the brevity penalty. A candidate of fewer tokens scores 0."""
    held = df.select(key, counted(candidate, reference, longest).alias("x")).select(key, "x.*")
    good = ~F.exists("grams", lambda g: g["total"] == 0) & (F.col("reference_len") > 0)
    logs = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.log((g["overlap"] + smoothing) / (g["total"] + smoothing)))
    penalty = F.when(F.col("candidate_len") > F.col("reference_len"), 1.0).otherwise(F.exp(1.0 - F.try_divide(F.col("reference_len").cast("double"), F.col("candidate_len"))))
    return held.select(key, F.when(good, penalty * F.exp(logs / longest)).otherwise(0.0).alias("bleu"))


_TOKEN = re.compile(r"\w+|[^\w\s]")


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a bit for each place of b, a whole number's worth of them at a time.

    A bit is 0 where the table's row grows. For each item of a, the carry of an addition moves each growth to the first
    place further on that the item matches.
    """
    if not a or not b:
        return 0
    places: dict = {}
    for i, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole
    for t in a:
        met = row & places.get(t, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


def rouge_l(candidate: Column | str, reference: Column | str) -> Column:
    """F1 of the longest common subsequence of tokens."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            left, right = _TOKEN.findall((x or "").lower()), _TOKEN.findall((y or "").lower())
            n = common_subsequence(left, right)
            out.append(2 * n / (len(left) + len(right)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return run(col(candidate), col(reference))


def by_objective(scores: DataFrame) -> DataFrame:
    """Means of exact, bleu and rouge by objective, and over all (objective ALL)."""
    named = scores.groupingSets([["objective"], []], "objective").agg(
        F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("exact"), F.avg("bleu").alias("bleu"), F.avg("rouge").alias("rouge"), F.grouping("objective").alias("g")
    )
    return named.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("objective")).alias("objective"), "n", "exact", "bleu", "rouge")
