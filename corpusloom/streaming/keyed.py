"""Streams with state by key: caps per key, and files that later scans no longer hold.

State lies with Spark's transformWithState in RocksDB, checkpointed with the stream, so a query that starts again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys that the files of tracked() are dealt to.
BUCKETS = 4096


def run(df: DataFrame, checkpoint: str, path: str) -> None:
    """Appends what a stream with state has to give now to the Parquet folder path."""
    spark = df.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


class _Cap(StatefulProcessor):
    """Lets the first most rows of a key pass; keeps their number."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for row in rows:
            if n < self.most:
                n += 1
                yield row
        self.count.update((n,))

    def close(self) -> None:
        pass


def capped(stream: DataFrame, key: str, most: int) -> DataFrame:
    """The first most rows of each key, over all batches and restarts, in the order they come; of a key only a number is kept."""
    return stream.groupBy(key).transformWithState(_Cap(most), stream.schema, "Append", "None")


class _Sightings(StatefulProcessor):
    """Of each file of a bucket when it was seen last, and its digest then; a timer at the first of their ends tells those that aren't seen again.

    A call to the state costs far more than a file, so a bucket takes the same few however many files of it a batch has.
    """

    def __init__(self, row: Row, kind: str, ttl: int):
        self.row, self.kind, self.ttl = row, kind, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"files array<{self.kind}>, ats array<long>, digests array<string>")

    def files(self) -> dict:
        files, ats, digests = self.held.get() or ((), (), ())
        return dict(zip(files, zip(ats, digests)))

    def keep(self, files: dict) -> None:
        if files:
            self.held.update((list(files), *map(list, zip(*files.values()))))
        else:
            self.held.clear()

    def end(self, files: dict) -> int | None:
        return min(at for at, _ in files.values()) + self.ttl if files else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = {}
        for r in rows:
            file, sight = r["file"], (r["at"], r["digest"] or "")
            last[file] = max(last.get(file, sight), sight)
        held = self.files()
        before, told = self.end(held), []
        for file, (at, digest) in last.items():
            old = held.get(file)
            if old is not None and at < old[0]:  # a scan that comes late says nothing new
                continue
            held[file] = (at, digest)
            if old is None or old[1] != digest:
                told.append(self.row(file, "indexed", digest, at))
        self.keep(held)
        if self.end(held) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(self.end(held))
        yield from told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the watermark may have passed the ends of further files than the first
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs()) - self.ttl
        held = self.files()
        left = {file: sight for file, sight in held.items() if sight[0] > passed}
        self.keep(left)
        if left:
            self.handle.registerTimer(self.end(left))
        for file, (at, _) in held.items():
            if at <= passed:
                yield self.row(file, "removed", None, at + self.ttl)

    def close(self) -> None:
        pass


def tracked(scans: DataFrame, ttl: int, late: str = "0 seconds", key: str = "path", digest: str = "sha256", seen: str = "seen", buckets: int = BUCKETS) -> DataFrame:
    """(path, change, sha256, at) of a stream of scans (path, sha256, seen): indexed where a file is new or has changed, removed where no scan has it for ttl milliseconds.

    A file is told removed once the watermark, late behind the last scan, has passed. Its state is dropped then, so state
    is bounded by the files that were seen within ttl. at is event time in milliseconds. State lies by buckets of files,
    some hundred bytes a file, and one is rewritten by each batch that has a file of it: with hundreds of millions of
    files take more. Like the number of shuffle partitions, that of buckets stays with a checkpoint.
    """
    kind = scans.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    held = scans.withWatermark(seen, late).select(bucket, F.col(key).alias("file"), F.col(digest).alias("digest"), F.unix_millis(seen).alias("at"), F.col(seen).alias("seen"))
    row = Row(key, "change", "sha256", "at")
    return held.groupBy("bucket").transformWithState(_Sightings(row, kind, ttl), f"{key} {kind}, change string, sha256 string, at long", "Append", "eventTime")


def current(changes: DataFrame, key: str = "path") -> DataFrame:
    """(path, sha256) of the files that are there by tracked()'s changes so far: those whose last change isn't a removal."""
    last = changes.groupBy(key).agg(F.max(F.struct("at", "change", "sha256")).alias("c"))
    return last.where("c.change = 'indexed'").select(key, "c.sha256")
