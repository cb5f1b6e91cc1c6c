"""Shared plumbing: tables, checkpoints, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import plain_scan, spread  # noqa: F401

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers find this package; Arrow batches stay small, as one text may be megabytes long."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns of df with just these names, under new ones. Others are left aside, even where they differ from them in case alone."""
    numbered = df.toDF(*[str(i) for i in range(len(df.columns))])
    return numbered.select(*[numbered[str(df.columns.index(name))].alias(new) for new, name in names.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; where it is unset, a temporary one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: no lineage, no second computation, safe if executors go."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df itself where files or a checkpoint give its rows, which come in the same order each time; else df, cut. For frames that are numbered in one read and used in another."""
    return df if plain_scan(df) else cut(df)


#: Nodes with more than this share of the edges' ends (so fewer than 1 / SHARE of them) get their minima by a broadcast.
SHARE = 1 / 2000


def _lowest(ends: DataFrame, n: int) -> DataFrame:
    """ends (u, v) with m, the smallest v of each u. n: how many ends there are, or more.

    The few nodes that have a large share of all ends are joined by a broadcast of at most 1 / SHARE rows, the others by
    a shuffle, in which none of them has more than that share.
    """
    low = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    hot = F.broadcast(low.where(F.col("__n") > n * SHARE).select("u", F.col("m").alias("__m")))
    rest = low.where(F.col("__n") <= n * SHARE).select("u", "m")
    marked = ends.join(hot, "u", "left")
    near = marked.where("__m is not null").select("u", "v", F.col("__m").alias("m"))
    return near.unionByName(marked.where("__m is null").select("u", "v").join(rest, "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b: longs) reaches.

    Alternating large-star and small-star steps over an edge table that is cut after each round. Each step is a
    minimum with map-side combining and a join on the node, in which nodes with very many edges aren't shuffled (see
    _lowest), so no task gathers a component. Edges only ever move towards smaller nodes, and the loop ends when a
    round changes nothing, by number and two 64-bit hash sums of the edges: O(log^2) rounds for any graph.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    hashed = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    state = lambda df: tuple(df.agg(F.count("*"), hashed("u", "v"), hashed("v", F.lit(1), "u")).first())
    seal = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, 2 * seal[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _lowest(large, seal[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        new = state(now)
        if new == seal:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seal = new
    raise RuntimeError("components did not settle")
