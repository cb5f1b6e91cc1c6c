"""Ranks and first rows of groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, group: list[str], key: str, out: str = "rank", seed: str = "42", digits: int = 3) -> DataFrame:
    """out: the rank from 1 of each row in its group, by the SHA-1 of seed and key, then by key.

    Rows fall into 16^digits parts of a group by the first digits of the hash; the parts are counted, and a row's rank
    is what the parts before hold and its place in its own. So a group of any size is ranked by many tasks.
    """
    hashed = df.withColumn("__h", F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("__p", F.substring("__h", 1, digits))
    parts = hashed.groupBy(*group, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    parts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__q"), "__before")
    same = hashed["__p"] == parts["__q"]
    for i, g in enumerate(group):
        same &= hashed[g].eqNullSafe(parts[f"__g{i}"])
    inside = Window.partitionBy(*group, "__p").orderBy("__h", key)
    ranked = hashed.withColumn("__r", F.row_number().over(inside)).join(parts, same)
    return ranked.select(*df.columns, (F.col("__r") + F.col("__before")).cast("long").alias(out))


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """The rows whose hash_rank over all of df is at most n, in no order: each task keeps n, and nothing is shuffled but those."""
    return df.orderBy(F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest order, which must be unique: a minimum that combines early, and a semi-join."""
    first = df.groupBy(*key).agg(F.min(order).alias("__first")).select("__first")
    return df.join(first, df[order] == first["__first"], "left_semi")
