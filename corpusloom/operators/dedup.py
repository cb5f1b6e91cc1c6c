"""Exact and near deduplication of records.

Near-duplicates are found by MinHash signatures cut into bands. With n slots and a threshold t, a pair passes if at
most m = n - ceil(t * n) slots differ; with m + 1 bands such a pair agrees on a whole band, so the equi-join on bands
loses no pair. Equal signatures are one node before the join, so a group of copies never meets itself there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.minhash import slots
from ..session import checkpointed, python_path, spread
from .rank import first_of

#: Words of a shingle.
SHINGLE = 5


def exact(df: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """The first row of each fingerprint over columns."""
    return first_of(df.withColumn("fp", X.fingerprint(*columns)), ["fp"], order)


def groups(df: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """Fingerprints that several rows have: fp, n, first."""
    return df.withColumn("fp", X.fingerprint(*columns)).groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def signatures(df: DataFrame, text: str = "input", n: int = 32, order: str = "ord") -> DataFrame:
    """(ord, sig): for each of n salts the smallest MD5 of salt and shingle, as hex of fixed width, whose order is the number's.

    Hashes never leave the row: no shingle is shuffled. A task hashes the shingles of a batch of rows as arrays.
    """
    python_path(df.sparkSession)
    held = spread(df.select(F.col(order).alias("ord"), F.col(text).alias("text")))
    return held.select("ord", slots(F.array_join(X.padded_tokens("text", SHINGLE), " "), n, SHINGLE).alias("sig"))


def similarity(a, b):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def band_count(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def bands(sig, n: int, count: int):
    """Keys of count contiguous slices: md5 over place and slots."""
    edges = [n * k // count for k in range(count + 1)]
    return F.array(*[F.md5(F.concat_ws(",", F.lit(str(k)), F.slice(sig, edges[k] + 1, edges[k + 1] - edges[k]))) for k in range(count)])


def classes(sigs: DataFrame) -> DataFrame:
    """Signatures with their rows' smallest ord and number: sig, ord, n."""
    return sigs.groupBy("sig").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))


#: Signatures of one band that are compared with each other at once; a larger band is cut up.
BAND = 256


def pairs(sigs: DataFrame, n: int = 32, threshold: float = 0.95, band: int = BAND) -> DataFrame:
    """Pairs (a < b, sim) of class representatives whose signatures agree in at least threshold of their slots.

    Signatures that share a band and are more than band get a second key: a similar pair differs in at most m slots in
    all, so of m + 1 slices of the slots outside the band one agrees too. What then still is larger is dealt into
    blocks of band by hash, and blocks meet each other one by one, so no task compares more than band rows with band.
    """
    count = band_count(n, threshold)
    reps = checkpointed(classes(sigs).select("ord", "sig"))
    keyed = reps.select("ord", "sig", F.posexplode(bands(F.col("sig"), n, count)).alias("slice", "band"))
    keyed = _cut_up(keyed, n, count, band)
    sizes = keyed.groupBy("band").agg(F.count("*").alias("__n")).where("__n > 1")
    held = checkpointed(keyed.join(sizes, "band").withColumn("parts", F.ceil(F.col("__n") / band).cast("int")))
    block = F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")
    # Block i meets blocks i .. parts - 1: the row goes to each pair of blocks that has its own
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("x"), F.greatest(F.col("block"), j).alias("y")))
    spread_rows = held.withColumn("block", block).select("ord", "sig", "band", "block", F.explode(met).alias("m")).select("ord", "sig", "band", "block", "m.x", "m.y")
    left = spread_rows.where("block = x").select(F.col("ord").alias("a"), F.col("sig").alias("sa"), "band", "x", "y")
    right = spread_rows.where("block = y").select(F.col("ord").alias("b"), F.col("sig").alias("sb"), "band", "x", "y")
    found = left.join(right, ["band", "x", "y"]).where("x < y or a < b").withColumn("sim", similarity(F.col("sa"), F.col("sb")))
    found = found.where(F.col("sim") >= threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()


def _cut_up(keyed: DataFrame, n: int, count: int, most: int) -> DataFrame:
    """keyed (ord, sig, slice, band) with bands of more than most rows cut by a slice of the other slots each: (ord, sig, band)."""
    sizes = keyed.groupBy("band").agg(F.count("*").alias("__n"))
    large = sizes.where(F.col("__n") > most).select("band")
    edges = F.array(*[F.lit(n * k // count) for k in range(count + 1)])
    wide = keyed.join(large, "band")
    outside = F.concat(F.slice("sig", F.lit(1), F.get(edges, F.col("slice"))), F.slice("sig", F.get(edges, F.col("slice") + 1) + 1, F.lit(n)))
    cuts = lambda rest: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.struct(j.alias("j"), F.slice(rest, F.floor(F.size(rest) * j / count).cast("int") + 1, (F.floor(F.size(rest) * (j + 1) / count) - F.floor(F.size(rest) * j / count)).cast("int")).alias("s")))
    again = wide.select("ord", "sig", "band", F.explode(X.let(outside, cuts)).alias("c")).where(F.size("c.s") > 0)
    again = again.select("ord", "sig", F.md5(F.concat_ws(",", "band", F.col("c.j").cast("string"), F.array_join("c.s", ","))).alias("band"))
    return keyed.join(large, "band", "left_anti").select("ord", "sig", "band").unionByName(again)


def greedy(sigs: DataFrame, n: int = 32, threshold: float = 0.95, rounds: int = 100) -> DataFrame:
    """The ords that a pass in order keeps, which drops a row if it is similar to an earlier row that is kept.

    Undecided rows without an earlier neighbour that is undecided or kept are kept, and rows with an earlier kept
    neighbour go, until none is undecided. Of a class only its first row can be kept.
    """
    sigs = checkpointed(sigs)
    links = checkpointed(pairs(sigs, n, threshold).select("a", "b"))
    todo = classes(sigs).select("ord")
    kept = checkpointed(todo.join(links.select(F.col("b").alias("ord")), "ord", "left_anti"))
    todo = checkpointed(todo.join(kept, "ord", "left_anti"))
    for _ in range(rounds):
        if todo.isEmpty():
            return kept
        gone = links.join(kept.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord"))
        todo = checkpointed(todo.join(gone, "ord", "left_anti"))
        waiting = links.join(todo.select(F.col("ord").alias("a")), "a", "left_semi").select(F.col("b").alias("ord"))
        new = checkpointed(todo.join(waiting, "ord", "left_anti"))
        kept = checkpointed(kept.unionByName(new))
        todo = checkpointed(todo.join(new, "ord", "left_anti"))
    raise RuntimeError("greedy resolution did not settle")


def greedy_windowed(sigs: DataFrame, threshold: float = 0.95, window: int = 2000) -> DataFrame:
    """The same pass, comparing with the last window kept rows only; one task reads all rows in order, so this is for parity tests."""
    import pandas as pd

    def run(batches):
        held: list = []
        for batch in batches:
            keep = []
            for sig in batch["sig"]:
                near = any(sum(x == y for x, y in zip(sig, k)) / max(1, len(sig)) >= threshold for k in held[-window:])
                keep.append(not near)
                if not near:
                    held.append(list(sig))
            yield pd.DataFrame({"ord": batch["ord"][pd.Series(keep, index=batch.index)]})

    return sigs.coalesce(1).sortWithinPartitions("ord").mapInPandas(run, "ord long")
