"""Shaping a corpus: rebalancing, leak-free splits, merging, metadata, ingestion.

Random choices are ranks by the SHA-1 of a seed and the row's key: the same on any cluster, in any order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .filters import validity
from .rank import hash_rank

SPLITS = ("train", "val", "test")


def rebalance(df: DataFrame, ratios: dict[str, float], language: str = "language", key: str = "id") -> DataFrame:
    """Of each language at most floor(all rows * its ratio) rows; languages without a ratio go."""
    total = df.agg(F.count("*").alias("total"))
    share = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])
    ranked = hash_rank(df.where(F.col(language).isin(list(ratios))), [language], key, "rank")
    cap = F.floor(F.col("total") * F.element_at(share, F.col(language)))
    return ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= cap).select(*df.columns)


def rebalance_least(df: DataFrame, languages: list[str], language: str = "language", key: str = "id") -> DataFrame:
    """Each language cut to the size of the smallest; raises if one has no rows."""
    wanted = df.where(F.col(language).isin(languages))
    sizes = wanted.groupBy(language).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n").alias("least"), F.count("*").alias("found"))
    least = least.select(F.when(F.col("found") == len(languages), F.col("least")).otherwise(F.raise_error(F.lit("a target language has no rows")).cast("long")).alias("least"))
    ranked = hash_rank(wanted, [language], key, "rank")
    return ranked.crossJoin(F.broadcast(least)).where(F.col("rank") <= F.col("least")).select(*df.columns)


def _sizes(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Sizes of train and val out of n, each at least one, and at least one left where n allows."""
    a, b = F.greatest(F.lit(1), F.floor(n * train)), F.greatest(F.lit(1), F.floor(n * val))
    full = a + b >= n
    return F.when(full, F.greatest(F.lit(1), n - 2)).otherwise(a), F.when(full, F.lit(1)).otherwise(b)


def _named(rank: Column, a: Column, b: Column) -> Column:
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def split_rows(df: DataFrame, group: list[str], key: str = "id", train: float = 0.85, val: float = 0.07) -> DataFrame:
    """df with split, row by row within each group; groups of one or two rows are all train."""
    ranked = hash_rank(df, group, key, "__rank")
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n")) if group else df.agg(F.count("*").alias("__n"))
    joined = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))
    a, b = _sizes(F.col("__n"), train, val)
    return joined.select(*df.columns, F.when(F.col("__n") <= 2, "train").otherwise(_named(F.col("__rank"), a, b)).alias("split"))


def split_groups(df: DataFrame, repo: str, group: list[str], key: str = "id", train: float = 0.85, val: float = 0.07) -> DataFrame:
    """df with split, so that a repo lies in one split of its group.

    Groups of fewer than three repos, or in which a split stays empty, are split row by row.
    """
    repos = df.select(*group, F.col(repo).alias("__repo")).distinct()
    ranked = hash_rank(repos, group, "__repo", "__rank")
    sizes = repos.groupBy(*group).agg(F.count("*").alias("__n")) if group else repos.agg(F.count("*").alias("__n"))
    joined = ranked.join(sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))
    a, b = _sizes(F.col("__n"), train, val)
    placed = joined.select(*group, "__repo", "__n", _named(F.col("__rank"), a, b).alias("__split"))
    # Three repos or more always fill all splits, so the fallback is for fewer.
    names = {c: f"__{c}" for c in group}
    placed = placed.withColumnsRenamed(names)
    same = df[repo].eqNullSafe(placed["__repo"])
    for c, other in names.items():
        same &= df[c].eqNullSafe(placed[other])
    marked = df.join(placed, same, "left").drop("__repo", *names.values())
    many = marked.where("__n >= 3").select(*df.columns, F.col("__split").alias("split"))
    few = split_rows(marked.where("__n < 3").select(*df.columns), group, key, train, val)
    return many.unionByName(few)


def split_global(df: DataFrame, repo: str, train: float = 0.85, val: float = 0.07) -> DataFrame:
    """df with split: repos cut at floor(train * n) and floor((train + val) * n), with no least size."""
    repos = df.select(F.col(repo).alias("__repo")).distinct()
    ranked = hash_rank(repos, [], "__repo", "__rank").crossJoin(F.broadcast(repos.agg(F.count("*").alias("__n"))))
    cut = lambda r: F.floor(F.col("__n") * F.lit(r))
    named = F.when(F.col("__rank") <= cut(train), "train").when(F.col("__rank") <= cut(train + val), "val").otherwise("test")
    placed = ranked.select("__repo", named.alias("split"))
    return df.join(placed, df[repo].eqNullSafe(placed["__repo"])).drop("__repo")


def collapse_guard(df: DataFrame) -> DataFrame:
    """Rows per split; raises if there are three rows or more and a split has none."""
    counts = df.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("total"))
    bad = (F.col("total") >= 3) & (F.least(*SPLITS) == 0)
    return counts.select(*SPLITS, F.when(bad, F.raise_error(F.lit("a split is empty")).cast("boolean")).otherwise(F.lit(True)).alias("ok"))


def merged(df: DataFrame) -> DataFrame:
    """Rows of a known split, with the task's tag before the input; split is trimmed and in lower case."""
    split = F.lower(F.trim(F.coalesce("split", F.lit(""))))
    return df.withColumn("split", split).where(F.col("split").isin(*SPLITS)).withColumn("input", X.task_prefixed("input", "objective"))


def metadata_types(df: DataFrame, column: str = "metadata") -> DataFrame:
    """(key, kind) over JSON objects in column: boolean, long, double or string. The first kind seen wins, and a double widens a long.

    Kinds are seen in the order of ord.
    """
    entry = F.explode(F.from_json(column, "map<string,string>"))
    raw = df.select("ord", column, entry.alias("key", "text")).where("text is not null")
    kind = F.when(F.col("text").isin("true", "false"), "boolean").when(F.col("text").rlike(r"^-?\d+$"), "long").when(F.col("text").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double").otherwise("string")
    kinds = raw.select("ord", "key", kind.alias("kind"))
    first = kinds.groupBy("key").agg(F.min_by("kind", "ord").alias("first"), F.max((F.col("kind") == "double").cast("int")).alias("wide"))
    return first.select("key", F.when((F.col("first") == "long") & (F.col("wide") == 1), "double").otherwise(F.col("first")).alias("kind"))


def metadata_filled(df: DataFrame, types: dict[str, str], column: str = "metadata") -> DataFrame:
    """df with column as a struct of the keys in types: a missing key, or one of a value that is no object, gets its kind's default; a null stays null."""
    zero = {"boolean": "false", "long": "0", "double": "0.0", "string": ""}
    held = F.from_json(column, "map<string,string>")
    fields = []
    for key, kind in sorted(types.items()):
        there = F.coalesce(F.map_contains_key(held, key), F.lit(False))
        fields.append(F.when(there, F.try_element_at(held, F.lit(key))).otherwise(F.lit(zero[kind])).cast(kind).alias(key))
    return df.withColumn(column, F.struct(*fields))


def capped(df: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """df with reason: over_cap for what goes beyond the first cap rows of a group, by order; else null."""
    ranked = hash_rank_by_order(df, group, order)
    return ranked.withColumn("reason", F.when(F.col("__rank") > cap, "over_cap")).drop("__rank")


def hash_rank_by_order(df: DataFrame, group: list[str], order: str, width: int = 4096) -> DataFrame:
    """df with __rank, the place from 1 in its group by the integer column order; parts of width values are counted first."""
    from pyspark.sql import Window

    cut = df.withColumn("__part", F.floor(F.col(order) / width))
    parts = cut.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__part").orderBy(order)
    ranked = cut.withColumn("__r", F.row_number().over(inside)).join(parts, [*group, "__part"])
    return ranked.select(*df.columns, (F.col("__r") + F.col("__before")).alias("__rank"))


@dataclass
class Source:
    """A data set: raw, a DataFrame or a function that loads one, None where there is no raw data; its converter to records; caps."""

    raw: DataFrame | Callable[[], DataFrame] | None
    converter: Callable[[DataFrame], DataFrame] | None
    objective: str
    cap: int = 0


CAP_REASON = "max_per_dataset_cap"
REPORT = "dataset string, status string, error string"


def ingest(spark: SparkSession, sources: dict[str, Source], objectives: list[str], cap: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of all sources that can be read and converted.

    rows are the converted records with dataset and reason: null for those that are kept, or pipeline_ and the rule that
    they fail, or max_per_dataset_cap for valid ones behind the first cap (of all sources, or the source's own) by ord.
    The report has a row a source: status (success, skipped for an objective that isn't wanted, missing_raw, load_failed,
    converter_error), error, raw, kept, dropped, retention and reasons, a map of counts. Loaders and converters are
    someone else's code, so what they raise while they plan is reported and the others go on.
    """
    found, told, counted, caps = [], [], [], {}

    def failed(name: str, status: str, error: str = "") -> None:
        told.append((name, status, error[:200]))

    for name, source in sources.items():
        if source.objective not in objectives:
            failed(name, "skipped", f"objective '{source.objective}' is not wanted")
            continue
        if source.raw is None:
            failed(name, "missing_raw")
            continue
        try:
            raw = source.raw() if callable(source.raw) else source.raw
            raw.schema  # noqa: B018
        except Exception as e:
            failed(name, "load_failed", str(e))
            continue
        try:
            if source.converter is None:
                raise ValueError("no converter")
            rows = source.converter(raw)
        except Exception as e:
            failed(name, "converter_error", str(e))
            continue
        if "ord" not in rows.columns:
            rows = rows.withColumn("ord", F.monotonically_increasing_id())
        rows = validity(rows).withColumn("reason", F.when(F.col("reason").isNotNull(), F.concat(F.lit("pipeline_"), "reason")))
        found.append(rows.withColumn("dataset", F.lit(name)))
        counted.append(raw.agg(F.count("*").alias("raw")).withColumn("dataset", F.lit(name)))
        told.append((name, "success", None))
        if cap or source.cap:
            caps[name] = cap or source.cap
    statuses = spark.createDataFrame(told, REPORT)
    if not found:
        return spark.createDataFrame([], "dataset string, reason string"), statuses.selectExpr("*", "0L as raw", "0L as kept", "0L as dropped", "0.0D as retention", "cast(map() as map<string,bigint>) as reasons")
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    rows = union(found)
    if caps:
        limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("dataset"))
        ranked = hash_rank_by_order(rows.where("reason is null"), ["dataset"], "ord")
        kept = ranked.withColumn("reason", F.when(F.col("__rank") > limit, CAP_REASON)).drop("__rank")
        rows = kept.unionByName(rows.where("reason is not null"))
    by = rows.groupBy("dataset", "reason").agg(F.count("*").alias("n"))
    entry = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    sums = by.groupBy("dataset").agg(F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("dropped"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("reasons"))
    report = statuses.join(union(counted), "dataset", "left").join(sums, "dataset", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.round(F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("raw")), F.lit(0.0)), 6)
    empty = F.map_from_entries(F.array().cast("array<struct<reason:string,n:bigint>>"))
    return rows, report.select("dataset", "status", "error", zero("raw"), zero("kept"), zero("dropped"), share.alias("retention"), F.coalesce("reasons", empty).alias("reasons"))


def struct_of(types: dict[str, str]) -> T.StructType:
    kinds = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in sorted(types.items())])
