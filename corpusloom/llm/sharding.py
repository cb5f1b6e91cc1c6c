"""Sharding by weighted rendezvous hashing of record keys, in Spark functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, read

#: Rows that a slot-numbering block has on average.
BLOCK_ROWS = 4096


def place(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the one with the smallest -ln(u) / weight, u being uniform by key and shard.

    A shard's draw does not depend on the other shards, so a new shard only takes rows, and a changed weight moves
    rows to or from that shard alone. Shards get rows in proportion to their weights; weight 0 takes none. Equal draws go to the lower shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(shard).alias("s")))
    return F.array_min(F.array(*draws))["s"]


def assign(df: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 8. slot numbers the rows of a shard from 0 without gaps. Numbering
    never gathers a shard: rows fall into blocks of about BLOCK_ROWS by a salted hash, blocks are counted, and a
    block's rows start where the blocks before it end. The salt keeps equal keys apart, so a key that holds a
    third of the rows fills no block. A null id is a key like any other; a null text has no bytes (size 8, CRC 0);
    repeated rows each get a slot; an empty table gives an empty result; further columns are left aside.
    """
    text = F.coalesce(df[text_col], F.lit("")).cast("binary")
    rows = df.select(
        df[id_col].alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(df[id_col], weights).alias("shard"),
        (place(df[id_col], grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("salt"),
    )
    rows = cut(rows)
    blocks = max(1, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("salt")
    slots = rows.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "block"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)
