"""Structured streams: first-wins deduplication, ingestion with a cap, session histories, incremental indexing, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators.rules import index_diff
from ..sources import readers


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table or folder as a stream, with the schema of what is there now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark.read.parquet(path).select("_metadata.file_path").first()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if single and single[0].rstrip("/").endswith("/" + name):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def deduplicated(stream: DataFrame, columns: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each fingerprint. With an event time, state goes when the watermark passes."""
    held = stream.withColumn("fp", X.fingerprint(*columns))
    return held.withWatermark(time, late).dropDuplicatesWithinWatermark(["fp"]) if time else held.dropDuplicates(["fp"])


def collected(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over what there is, write it to path as Parquet, and read that."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def ingested(stream: DataFrame, checkpoint: str, path: str, keep: Callable[[DataFrame], DataFrame], most: int) -> int:
    """Write kept rows of each micro-batch until most are there, over all runs from the same checkpoint; gives how many are.

    What is there is counted from the folders of the batches before, so a query that starts again goes on at its count,
    and a batch that is run again overwrites its own folder.
    """
    spark = stream.sparkSession

    def held(before: int | None = None) -> int:
        if not readers.exists(spark, path):  # no batch has been written yet
            return 0
        rows = spark.read.parquet(path)
        return (rows if before is None else rows.where(F.col("batch") < before)).count()

    def batch(df: DataFrame, number: int) -> None:
        left = most - held(number)
        if left > 0:
            keep(df).limit(left).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held()


HISTORY = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("events", T.StringType()), T.StructField("n", T.LongType())])
_KEPT = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("kinds", T.ArrayType(T.StringType()))])


def history(stream: DataFrame, most: int = 10) -> DataFrame:
    """Per user the last most events by id, as they stand after each batch: keyed state of a bounded size."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, kinds = state.get if state.exists else ([], [])
        held = list(zip(ids, kinds))
        for b in batches:
            held = sorted({*held, *zip(b["event_id"].tolist(), b["event_type"].tolist())})[-most:]
        state.update(([i for i, _ in held], [k for _, k in held]))
        yield pd.DataFrame({"user_id": [key[0]], "events": [",".join(f"{i}:{k}" for i, k in held)], "n": [len(held)]})

    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(update, HISTORY, _KEPT, "update", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, checkpoint: str, path: str, key: str, order: str) -> DataFrame:
    """Run an update stream over what there is, and give the last row of each key."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path).drop("b")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "__batch")]), F.struct("__batch", order)).alias("r"))
    return last.select(key, "r.*")


def reindexed(files: DataFrame, state: DataFrame, index: DataFrame, chunks: Callable[[DataFrame], DataFrame], key: str = "path", digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(index, state) after a scan: chunks of added and changed files anew, those of removed files gone, the rest as it was. Fits foreachBatch."""
    diff = index_diff(files, state, key, digest)
    gone = diff.where("status in ('changed', 'removed')").select(key)
    new = files.join(diff.where("status in ('changed', 'added')").select(key), key, "left_semi")
    return index.join(gone, key, "left_anti").unionByName(chunks(new), allowMissingColumns=True), files.select(key, digest)


def indexing(stream: DataFrame, checkpoint: str, top: str, chunks: Callable[[DataFrame], DataFrame], key: str = "path", digest: str = "sha256") -> None:
    """Index the files of a stream by content: each batch writes chunks and hashes of the files that are new or changed, below top.

    A batch is compared with what the batches before it have left, and one that is run again overwrites its own folders.
    Nothing written before is touched; indexed() gives what counts. Of rows of one file in a batch any one is taken.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.dropDuplicates([key])
        if readers.exists(spark, f"{top}/state"):  # else this is the first batch
            seen = _latest(spark.read.parquet(f"{top}/state").where(F.col("batch") < number), key, digest)
            fresh = fresh.join(seen.select(key, digest), [key, digest], "left_anti")
        chunks(fresh).write.mode("overwrite").parquet(f"{top}/index/batch={number}")
        fresh.select(key, digest).write.mode("overwrite").parquet(f"{top}/state/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _latest(state: DataFrame, key: str, digest: str) -> DataFrame:
    return state.groupBy(key).agg(F.max(F.struct("batch", digest)).alias("s")).select(key, f"s.{digest}", "s.batch")


def indexed(spark: SparkSession, top: str, key: str = "path", digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(index, state) that the batches of indexing() have left: of each file the chunks of its last version."""
    state = _latest(spark.read.parquet(f"{top}/state"), key, digest)
    return spark.read.parquet(f"{top}/index").join(state.select(key, "batch"), [key, "batch"], "left_semi").drop("batch"), state.drop("batch")


def windowed(stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by time window and keys; late rows are dropped when the watermark has passed their window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
