"""SimHash near-dedup by covering locality-sensitive hashing.

Each bit position i gets a vector p(i) in GF(2)^4; table v (any of the 15 vectors but zero) keeps the bits whose p(i)
has an odd product with v. Three differing bits span at most three dimensions, so some v is orthogonal to all of
them: that table keeps none of them, and the pair meets there. No pair within the radius is lost, whatever the data.
"""

from itertools import repeat
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, components, cut, prepare, read, settled, spread

RADIUS, BITS, SHINGLE, SEED = 3, 64, 3, 42
TABLES = 2 ** (RADIUS + 1) - 1
#: Fingerprints in a bucket that are compared at once; a larger bucket is hashed again, over the bits it doesn't fix.
BUCKET = 256
_ROWS = 1 << 15


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the hashes of the text's three-word shingles. Signed 64-bit."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _ROWS):
        ones += np.unpackbits(hashes[k : k + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (a running number), doc_id, fp."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["row", "doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return spread(rows).mapInArrow(run, f"row long, doc_id {kind}, fp long")


def masks(positions: list[int]) -> list[int]:
    """The 15 tables' masks over the given bit positions, as signed longs. p(i) goes round the vectors but zero, so tables are alike in size."""
    out = []
    for v in range(1, TABLES + 1):
        mask = sum(1 << b for i, b in enumerate(positions) if ((i % TABLES + 1) & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


_FIRST = masks(list(range(BITS)))
_SECOND = [[m | n for n in masks([b for b in range(BITS) if not m >> b & 1])] for m in _FIRST]


def _keys(fp: Column, table: Column | None) -> Column:
    """The keys (table, bits) of a fingerprint; of the second tables of a first one, if given."""
    struct = lambda t, m: F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("k"))
    if table is None:
        return F.array(*[struct(t, m) for t, m in enumerate(_FIRST)])
    wide = F.array(*[F.array(*[F.lit(m) for m in row]) for row in _SECOND])
    return F.transform(F.get(wide, table), lambda m, i: F.struct((table * TABLES + i + TABLES).alias("t"), fp.bitwiseAND(m).alias("k")))


def _forest(group: np.ndarray, radius: int) -> list[dict]:
    """Pairs that connect what links connect: each fingerprint with the first of its component in the group."""
    n, label = len(group), np.arange(len(group))
    step = max(1, (1 << 20) // n)
    while True:
        new = label.copy()
        for k in range(0, n, step):
            near = np.bitwise_count(group[k : k + step, None] ^ group[None, :]) <= radius
            new[k : k + step] = np.where(near, label[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [{"a": int(a), "b": int(b)} for a, b in zip(group, group[label]) if a != b]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints fps (column fp) that span the components of the links.

    Buckets are counted first. Small ones are compared as they are. Members of larger ones go to second tables over
    the bits that the first table leaves open; those buckets fix all but some 16 bits, so they hold 2^16 fingerprints
    at the very most, and the pairs of a bucket are compared in blocks. No bucket gives more pairs than members.
    """

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def forest(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: _forest(np.asarray(g, np.int64), RADIUS))

    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), None)).alias("x")).select("fp", "x.t", "x.k")
    counts = cut(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    full = keyed.join(counts, ["t", "k"])
    again = full.where(F.col("n") > bucket).select("fp", F.explode(_keys(F.col("fp"), F.col("t"))).alias("x"))
    parts = full.where(F.col("n") <= bucket).select("fp", "t", "k").unionByName(again.select("fp", "x.t", "x.k"))
    groups = parts.groupBy("t", "k").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
    return groups.select(F.explode(forest("g")).alias("e")).select("e.a", "e.b")


def _labelled(rows: DataFrame, bucket: int) -> DataFrame:
    """Per distinct fingerprint of rows (row, doc_id, fp): fp, n (rows that have it), and first: the component's smallest (null id?, doc_id, row)."""
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    reps = rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    found = components(links(reps.select("fp"), bucket))
    reps = reps.join(found, reps.fp == found.node, "left").select("fp", "n", F.coalesce("component", "fp").alias("c"), "first")
    firsts = reps.groupBy("c").agg(F.min("first").alias("first"))
    return reps.select("fp", "n", "c").join(firsts, "c").select("fp", "n", "first")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node however many rows have them; nodes link at three or fewer differing bits.
    component_id is the smallest doc_id reachable. Null and empty texts have fingerprint zero and link like others;
    null ids count as largest; repeated rows each get a row; an empty table gives an empty result; further columns
    are left aside. The rows of the most frequent fingerprints (at most 1 / SHARE) get their components by a broadcast.
    """
    rows = cut(fingerprints(df, id_col, text_col))
    found = cut(_labelled(rows, bucket).select("fp", F.col("first.id").alias("component_id"), F.lit(True).alias("hot"), "n"))
    often = F.col("n") > rows.count() * SHARE
    marked = rows.select("doc_id", "fp").join(F.broadcast(found.where(often).drop("n")), "fp", "left")
    rest = marked.where("hot is null").select("doc_id", "fp").join(found.where(~often).select("fp", "component_id"), "fp")
    out = marked.where("hot").select("doc_id", "fp", "component_id").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The rows of df, one of each component: that with the smallest id, or the first of several. Columns as they were.

    Null and empty texts are one component; a null id counts as largest; of repeated rows one stays; an empty table stays
    empty. df is read twice, so one that files or checkpoints don't give is cut first.
    """
    df = settled(df)
    rows = cut(fingerprints(df, id_col, text_col))
    kept = _labelled(rows, bucket).select(F.col("first.row").alias("__kept_row")).distinct()
    whole = df.select(F.monotonically_increasing_id().alias("__kept_row"), F.struct(*[df[c] for c in df.columns]).alias("__kept"))
    return whole.join(kept, "__kept_row", "left_semi").select("__kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
