"""Exact vector search by cells: points lie with the nearest of some pivots, and angles say which cells and points can't be near.

Angles between vectors are a metric. If a query is a from a pivot and a point is t from it, they are |a - t| apart at
least. So a cell whose points are between low and high from its pivot holds nothing nearer than max(a - high, low - a), and
what is farther than the k-th hit so far is passed over. No hit is lost, unlike with approximate indexes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import vector as V
from .vector import BATCH, cosine, dot, norm

#: Angles are held to be this much smaller than they are computed: rounding near 0 and pi is far below it.
SLACK = 1e-6
#: The cell of points that have no direction or another number of components; it is never passed over.
NOWHERE = -1


def _angle(score: Column) -> Column:
    return F.acos(F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0)))


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def build(points: DataFrame, path: str, n: int, key: str = "id", vector: str = "vector") -> None:
    """Writes points to the folder path, one folder a cell: key, vector, cell, angle (to the cell's pivot); and the table of cells.

    Pivots are the n points of the smallest hashes of their vectors. Null vectors are left out. Cells of any size are spread over files by ranges of
    the keys.
    """
    spark = points.sparkSession
    held = points.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    proper = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & (norm(F.col("vector")) > 0) & (norm(F.col("vector")) < float("inf"))
    sizes = held.where(proper).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    proper &= F.size("vector") == dim
    # of equal vectors one is enough
    first = held.where(proper).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(n).collect()
    pivots = spark.createDataFrame([(i, r["vector"]) for i, r in enumerate(first)], "cell int, pivot array<double>").withColumn("pivot", _unit(F.col("pivot")))
    pivots.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    # the list of pivots is a column of one broadcast row
    listed = spark.read.parquet(f"{path}/pivots").agg(F.sort_array(F.collect_list(F.struct("cell", "pivot"))).alias("pivots"))
    near = F.array_max(F.transform("pivots", lambda p: F.struct(dot(F.col("vector"), p["pivot"]).alias("s"), (-p["cell"]).alias("c"))))
    placed = held.crossJoin(F.broadcast(listed)).withColumn("m", F.when(proper, near)).drop("pivots")
    placed = placed.select("key", "vector", F.coalesce(-F.col("m.c"), F.lit(NOWHERE)).alias("cell"), F.coalesce(_angle(F.col("m.s") / norm(F.col("vector"))), F.lit(0.0)).alias("angle"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(tasks, "cell", "angle", "key").sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/points")
    spark.createDataFrame([(key, points.schema[key].dataType.simpleString(), dim)], "key string, kind string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    stored = _points(spark, path)
    cells = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    cells.join(F.broadcast(spark.read.parquet(f"{path}/pivots")), "cell", "left").select("cell", "n", "low", "high", "pivot").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _points(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/about").first()["kind"]
    return spark.read.schema(f"key {kind}, vector array<double>, angle double, cell int").parquet(f"{path}/points")


def _met(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Points with the queries (query, qv, cell, a, reach) that need their cells and whose angles a are within reach of theirs."""
    within = F.col("reach").isNull() | (F.col("cell") == NOWHERE) | (F.abs(F.col("angle") - F.col("a")) <= F.col("reach"))
    return points.join(F.broadcast(asked), "cell").where(within)


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, batch: int = BATCH) -> DataFrame:
    """(query, key, score, rank): the k nearest points of each query (query, qv), ties by key: what vector.search_batch gives.

    Queries go in batches of at most batch. The cells nearest to a query that hold k points are scored first; of the
    others only those that may hold something as near as the k-th of these, and in them only points whose angle allows it. Queries without a
    direction are compared with all points. Only the cells' folders that some query of a batch needs are read.
    """
    facts = spark.read.parquet(f"{path}/about").first()
    total = queries.count()
    parts, out = -(-total // batch) or 1, None
    for part in range(parts):
        some = queries.select("query", F.col("qv").cast("array<double>").alias("qv"))
        some = some.where(F.pmod(F.xxhash64("query", F.lit("batch")), F.lit(parts)) == part) if parts > 1 else some
        found = _batch(spark, path, facts["dim"], some, k)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", facts["key"])


def planned(cells: DataFrame, dim: int, some: DataFrame, k: int) -> DataFrame:
    """(query, qv, cell, a, least, seed): for each query and cell the angle to the pivot, the least angle to a point, and whether the cell is scored first."""
    proper = (F.size("qv") == dim) & ~F.exists("qv", lambda x: x.isNull() | F.isnan(x)) & (norm(F.col("qv")) > 0) & (norm(F.col("qv")) < float("inf"))
    met = some.crossJoin(F.broadcast(cells))
    a = F.when(proper & (F.col("cell") != NOWHERE), _angle(dot(F.col("qv"), F.col("pivot")) / norm(F.col("qv"))))
    met = met.withColumn("a", a).withColumn("least", F.coalesce(F.greatest(F.col("a") - F.col("high"), F.col("low") - F.col("a"), F.lit(0.0)), F.lit(0.0)))
    before = Window.partitionBy("query").orderBy("least", "a", "cell").rowsBetween(Window.unboundedPreceding, -1)
    seed = F.col("a").isNull() | (F.coalesce(F.sum(F.when(F.col("cell") != NOWHERE, F.col("n"))).over(before), F.lit(0)) < k)
    return met.withColumn("seed", seed).select("query", "qv", "cell", "a", "least", "seed")


def _steps(spark: SparkSession, path: str, dim: int, some: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries and cells that are scored first, the k best of them, queries and cells that are scored then)."""
    plan = checkpointed(planned(spark.read.parquet(f"{path}/cells"), dim, some, k))
    seeds = plan.where("seed").withColumn("reach", F.lit(None).cast("double"))
    best = checkpointed(_best(_scored(spark, path, dim, seeds, k), k).drop("rank"))
    far = best.groupBy("query").agg(F.count("*").alias("hits"), F.min("score").alias("worst"))
    reach = F.when(F.col("hits") >= k, _angle(F.col("worst")) + SLACK)
    rest = checkpointed(plan.where("not seed").join(F.broadcast(far), "query", "left").withColumn("reach", reach).where("reach is null or least <= reach").drop("hits", "worst"))
    return seeds, best, rest


def _blocks(points: DataFrame, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(query, key, score) of at least the k best points of each cell for each query that needs it: a cell's points are dealt into blocks, and a block meets its queries by vector.block_best."""
    parts = F.broadcast(cells.select("cell", F.ceil(F.col("n") / V.POINTS).cast("int").alias("parts")))
    left = points.join(parts, "cell").withColumn("p", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    right = asked.join(parts, "cell").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query", "qv", "cell", "a", "reach", "p")
    schema = f"query {asked.schema['query'].dataType.simpleString()}, key {points.schema['key'].dataType.simpleString()}, score double"

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        low, high = points["angle"].min(), points["angle"].max()
        asked = asked[asked["reach"].isna() | ((asked["a"] - asked["reach"] <= high) & (asked["a"] + asked["reach"] >= low))]
        return V.block_best(points, asked, k) if len(points) and len(asked) else pd.DataFrame({"query": asked["query"][:0], "key": points["key"][:0], "score": pd.Series([], dtype="float64")})

    return left.groupBy("cell", "p").cogroup(right.groupBy("cell", "p")).applyInPandas(run, schema)


def _scored(spark: SparkSession, path: str, dim: int, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, score): pairs of queries (query, qv, cell, a, reach) and points of their cells, the k best of each query among them. Vectors that rounding could spoil meet row by row."""
    points = _points(spark, path).where(F.col("cell").isin([r[0] for r in asked.select("cell").distinct().collect()]))
    plain, good = F.col("a").isNotNull() & V._proper(F.col("qv"), dim), (F.col("cell") != NOWHERE) & V._proper(F.col("vector"), dim)
    rows = _met(points.where(~good), asked).unionByName(_met(points.where(good), asked.where(~plain)))
    rows = rows.select("query", "key", cosine("vector", "qv").alias("score"))
    return _blocks(points.where(good), asked.where(plain), spark.read.parquet(f"{path}/cells"), k).unionByName(rows)


def _batch(spark: SparkSession, path: str, dim: int, some: DataFrame, k: int) -> DataFrame:
    _, best, rest = _steps(spark, path, dim, some, k)
    return _best(best.unionByName(_scored(spark, path, dim, rest, k)), k).select("query", "key", "score", "rank")


def share_scored(spark: SparkSession, path: str, queries: DataFrame, k: int) -> float:
    """Of all pairs of a query (at most BATCH of them) and a point, the share that angles don't rule out."""
    some = queries.select("query", F.col("qv").cast("array<double>").alias("qv"))
    first, _, then = _steps(spark, path, spark.read.parquet(f"{path}/about").first()["dim"], some, k)
    points = _points(spark, path)
    return (_met(points, first).count() + _met(points, then).count()) / (some.count() * spark.read.parquet(f"{path}/cells").agg(F.sum("n")).first()[0])
