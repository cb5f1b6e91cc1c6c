"""Sinks: JSON lines, partitioned tables, reports, an atomic swap of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> int:
    """Write df as JSON lines; the number of rows is counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def partitioned(df: DataFrame, path: str, *by: str, rows: int = 1_000_000) -> None:
    """Parquet by the values of the columns; files hold at most rows rows. Partitions are balanced first, large values over several files."""
    df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def report(df: DataFrame, path: str) -> None:
    """The rows of a small report as one pretty JSON array."""
    df.agg(F.to_json(F.collect_list(F.struct("*")), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def swapped(df: DataFrame, path: str) -> None:
    """Replace the Parquet folder path by df: written beside it, then renamed, with the old one kept until the new one stands. Works on any Hadoop file system."""
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    here, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
