"""Reports and checks: counts, shares, retention, coverage, limits, leakage, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import hash_sample


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Counts with their share of all, rounded to six places; the total is of the counted groups."""
    by = counts(df, *keys)
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def retention(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, raw, kept, retention), and a row ALL over all keys."""
    tagged = before.select(F.col(key), F.lit(1).alias("raw"), F.lit(0).alias("kept")).unionByName(after.select(F.col(key), F.lit(0).alias("raw"), F.lit(1).alias("kept")))
    sums = tagged.rollup(key).agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"), F.grouping(key).alias("g"))
    share = F.round(F.try_divide(F.col("kept").cast("double"), F.col("raw")), 6)
    return sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(key)).alias(key), "raw", "kept", share.alias("retention"))


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits): keys that more than one split has."""
    found = df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("k"))
    return found.where("k > 1").select(key, "splits")


def coverage(df: DataFrame, group: str, value: str, wanted: list[str]) -> DataFrame:
    """(group, missing): the wanted values that a group has not."""
    every = F.array(*[F.lit(v) for v in sorted(wanted)])
    return df.groupBy(group).agg(F.array_join(F.array_except(every, F.collect_set(value)), ",").alias("missing"))


def limits(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """measured (section, name, actual) against bounds (section, name, low, high): with ok. What isn't measured fails."""
    held = bounds.join(measured, ["section", "name"], "left")
    ok = F.col("actual").isNotNull() & (F.col("low").isNull() | (F.col("actual") >= F.col("low"))) & (F.col("high").isNull() | (F.col("actual") <= F.col("high")))
    return held.select("section", "name", "actual", "low", "high", ok.alias("ok"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: all checks hold, how many failed, and their names in order."""
    failed = F.when(~F.col("ok"), F.concat_ws(".", "section", "name"))
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ready"), F.count_if(~F.col("ok")).alias("failed"), F.array_join(F.sort_array(F.collect_list(failed)), ",").alias("blockers"))


def merge_checks(merged: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(section, name, ok) for a merged corpus (id, objective, split, input): counts, prefixes, ids, leaks and coverage, in one pass and a leak count."""
    aggs = [F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in expected]
    tagged = F.col("input").startswith(F.concat(F.lit("[TASK: "), F.col("objective"), F.lit("]")))
    row = merged.agg(
        *aggs, F.count_if(~F.coalesce(tagged, F.lit(False))).alias("untagged"), F.count_if(F.coalesce("id", F.lit("")) == "").alias("no_id"),
        *[F.count_distinct(F.when(F.col("split") == s, F.col("objective"))).alias(f"objectives_{s}") for s in expected], F.count_distinct("objective").alias("objectives"),
    )
    leaked = leaks(merged, "id").agg(F.count("*").alias("leaked"))
    row = row.crossJoin(leaked)
    made = [("counts", s, F.col(f"rows_{s}") == n) for s, n in expected.items()] + [("prefix", "all", F.col("untagged") == 0), ("ids", "present", F.col("no_id") == 0), ("leakage", "ids", F.col("leaked") == 0)]
    made += [("coverage", s, F.col(f"objectives_{s}") == F.col("objectives")) for s in expected]
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), c.alias("ok")) for a, b, c in made])).alias("c")).select("c.*")


def sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of df by the rank of their hashed keys, in the order of the key."""
    return hash_sample(df, key, n, seed).orderBy(key)


def diversity(df: DataFrame, session: str, file: Column | str) -> DataFrame:
    """(session, sources, files, diversity): distinct files by sources, three places; 0 without sources."""
    out = df.groupBy(session).agg(F.count("*").alias("sources"), F.count_distinct(file).alias("files"))
    return out.withColumn("diversity", F.round(F.coalesce(F.try_divide(F.col("files").cast("double"), F.col("sources")), F.lit(0.0)), 3))


def index_diff(current: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, changed, unchanged or removed, by content hash."""
    c, s = current.select(F.col(key), F.col(digest).alias("__new")), state.select(F.col(key), F.col(digest).alias("__old"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return c.join(s, key, "full_outer").select(key, status.alias("status"))
