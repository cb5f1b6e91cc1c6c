"""Verification of a corpus: measured facts against bounds, what a rewrite must keep, and a verdict with its blockers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules
from .filters import REQUIRED, broken
from .rank import hash_sample

# Fixed values
SPLIT_SHARES = {"train": (0.85, 0.05), "val": (0.07, 0.04), "test": (0.08, 0.04)}
RETENTION = 0.95
LINES_OFF = 0.05
BOUNDS = T.StructType([T.StructField("section", T.StringType()), T.StructField("name", T.StringType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def around(expected: float, off: float) -> tuple[float, float]:
    return expected - off, expected + off


def bounds(spark: SparkSession, rows: list[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """(section, name, low, high); a None is no bound."""
    return spark.createDataFrame([(s, n, None if a is None else float(a), None if b is None else float(b)) for s, n, a, b in rows], BOUNDS)


def split_bounds(shares: dict[str, tuple[float, float]] = SPLIT_SHARES) -> list[tuple]:
    return [("splits", s, *(round(x, 9) for x in around(*v))) for s, v in shares.items()]


def line_bounds(expected: dict[str, int], off: float = LINES_OFF) -> list[tuple]:
    return [("lines", k, n * (1 - off), n * (1 + off)) for k, n in expected.items()]


def _facts(row: DataFrame, made: list[tuple[str, str, str]]) -> DataFrame:
    """One row's columns as (section, name, actual)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(c).cast("double").alias("actual")) for s, n, c in made])).alias("f")).select("f.*")


def corpus_facts(df: DataFrame, objectives: list[str], splits: list[str] = ("train", "val", "test"), required: list[str] = REQUIRED) -> DataFrame:
    """(section, name, actual) of a corpus of records with split, in one pass: rows, shares of splits, rows of objectives, and
    how many rows lack a required column, are blank, have no tag, hold NaN in metadata, or have an id of another split too."""
    tag = F.concat(F.lit("[TASK: "), F.col("objective"), F.lit("]"))
    lacks = {f"missing.{c}": (F.col(c).isNull() if c in df.columns else F.lit(True)) for c in required}
    lacks |= {f"blank.{c}": F.coalesce(F.trim(c) == "", F.lit(False)) for c in ("input", "output") if c in df.columns}
    lacks["untagged"] = ~F.coalesce(F.col("input").startswith(tag), F.lit(False))
    if "metadata" in df.columns:
        lacks["metadata"] = broken(df.select("metadata").schema)
    aggs = [F.count("*").alias("rows"), *[F.coalesce(F.try_divide(F.count_if(F.col("split") == s).cast("double"), F.count("*")), F.lit(0.0)).alias(f"split_{s}") for s in splits]]
    aggs += [F.count_if(F.col("objective") == o).alias(f"objective_{o}") for o in objectives]
    aggs += [F.count_if(c).alias(f"bad_{i}") for i, c in enumerate(lacks.values())]
    made = [("rows", "all", "rows"), *[("splits", s, f"split_{s}") for s in splits], *[("objectives", o, f"objective_{o}") for o in objectives], *[("fields", n, f"bad_{i}") for i, n in enumerate(lacks)]]
    leaked = rules.leaks(df, "id").agg(F.count("*").cast("double").alias("actual")).select(F.lit("leakage").alias("section"), F.lit("ids").alias("name"), "actual")
    return _facts(df.agg(*aggs), made).unionByName(leaked)


def table_facts(df: DataFrame, section: str, name: str, value: str) -> DataFrame:
    """(section, name, actual) of a small table: rows or bytes of sources, sizes of files, lines, retention by data set."""
    return df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("actual"))


def spot_checks(df: DataFrame, key: str, n: int = 25, seed: str = "42") -> DataFrame:
    """(section, name, actual): how many of n rows, by the rank of their hashed keys, have a blank input or output or no objective."""
    some = hash_sample(df, key, n, seed)
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    row = some.agg(F.count("*").alias("seen"), F.count_if(blank("input")).alias("input"), F.count_if(blank("output")).alias("output"), F.count_if(blank("objective")).alias("objective"))
    return _facts(row, [("spot", c, c) for c in ("seen", "input", "output", "objective")])


def checked(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(section, name, actual, low, high, ok, message) of facts against bounds; what isn't measured fails."""
    held = rules.limits(facts, wanted)
    span = F.concat(F.lit("["), F.coalesce(F.col("low").cast("string"), F.lit("")), F.lit(", "), F.coalesce(F.col("high").cast("string"), F.lit("")), F.lit("]"))
    told = F.when(F.col("actual").isNull(), "not measured").when(~F.col("ok"), F.concat(F.col("actual").cast("string"), F.lit(" is outside "), span))
    return held.withColumn("message", F.coalesce(told, F.lit("ok")))


def kept_rows(before: DataFrame, after: DataFrame, key: str, column: str, keys: list[str]) -> DataFrame:
    """(section, name, ok) of a rewrite of records: as many rows, the same keys as often, and in column an object with exactly keys.

    Rows are counted by key on both sides, so a row that is lost and another that is doubled don't make up for each other.
    """
    tagged = before.select(F.col(key).alias("k"), F.lit(1).alias("d"), F.lit(1).alias("b")).unionByName(after.select(F.col(key).alias("k"), F.lit(-1).alias("d"), F.lit(0).alias("b")))
    by = tagged.groupBy("k").agg(F.sum("d").alias("d"), F.sum("b").alias("b")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("off"), F.count_if(F.col("d") != 0).alias("apart"))
    kind = after.schema[column].dataType
    if isinstance(kind, T.StructType):
        wrong = F.col(column).isNull() | F.lit(sorted(kind.names) != sorted(keys))
    elif isinstance(kind, T.MapType):
        wrong = F.coalesce(F.array_sort(F.map_keys(column)) != F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(True))
    else:
        named = F.array_sort(F.json_object_keys(column))
        wrong = F.coalesce(named != F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(True))
    held = by.crossJoin(F.broadcast(after.agg(F.count_if(wrong).alias("wrong"))))
    made = [("rows", F.col("off") == 0), ("keys", F.col("apart") == 0), (column, F.col("wrong") == 0)]
    return held.select(F.explode(F.array(*[F.struct(F.lit("rewrite").alias("section"), F.lit(n).alias("name"), c.alias("ok")) for n, c in made])).alias("c")).select("c.*")
