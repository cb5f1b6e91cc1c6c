"""Benchmark decontamination: windows of test-set words, looked up in every training text.

A set of up to MOST_WORDS words and MOST_BYTES bytes of items is broadcast whole. Of a larger one only a filter of FILTER_BITS bits is, which
says of a window's hash that no item has it, or that one may; windows that may be one's are joined with the items by their words.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import cut, prepare, read, spread

WINDOW = 10
#: Words of item texts up to which their windows are broadcast: at most 64 bytes a window and 160 a distinct word, so 115 MB at the very worst.
MOST_WORDS = 1 << 19
#: Bytes of item texts up to which they are collected and broadcast, whatever their words: an item may be all blanks, or one vast word.
MOST_BYTES = 1 << 24
#: Bits of the filter for larger benchmarks: 64 MB.
FILTER_BITS = 1 << 29

#: A-Z to a-z; other ASCII that is no letter or digit to a space. Bytes of other characters are word bytes.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word, as Spark's functions find it.
_WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size consecutive ids."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = out * _BASE + ids[k : k + len(out)]
    return out


class Windows:
    """The windows of items, in arrays: by window length the hashes in order, the word numbers, and the items of each.

    Holds 4 bytes a word of each distinct window, 8 for its hash and 4 for each of its items, and a dictionary of the distinct words.
    """

    def __init__(self, items: list[tuple], size: int):
        self.number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        found: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words(text)), np.uint32)
            length = min(size, len(ids))
            if length:
                rows = np.lib.stride_tricks.sliding_window_view(ids, length)
                found.setdefault(length, []).append(np.column_stack([rows, np.full(len(rows), k, np.uint32)]))
        self.tables = {}
        for length, parts in found.items():
            table = np.unique(np.concatenate(parts), axis=0)  # windows in order, each with its items
            first = np.flatnonzero(np.concatenate([[True], (table[1:, :-1] != table[:-1, :-1]).any(1)]))
            ends = np.append(first[1:], len(table))
            hashes = _rolled(table[first, :-1].astype(np.uint64).ravel(), length)[::length]
            order = np.argsort(hashes, kind="stable")
            self.tables[length] = hashes[order], table[first[order], :-1], first[order], ends[order], table[:, -1].copy()

    def nbytes(self) -> int:
        return sum(a.nbytes for t in self.tables.values() for a in t) + sum(120 + len(w) for w in self.number)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words of the text, a mark for each that is inside an occurrence, and the items that occur."""
        found = words(text)
        ids = np.fromiter(map(self.number.get, found, [0] * len(found)), np.uint64, len(found))
        marks, items = np.zeros(len(found) + 1, np.int64), set()
        for length, (hashes, table, first, ends, owners) in self.tables.items():
            rolled = _rolled(ids, length)
            at = np.searchsorted(hashes, rolled)
            at[at == len(hashes)] = 0
            for k in np.flatnonzero(hashes[at] == rolled).tolist():
                i = int(at[k])
                while i < len(hashes) and hashes[i] == rolled[k]:
                    if (table[i] == ids[k : k + length]).all():
                        items.update(owners[first[i] : ends[i]].tolist())
                        marks[k] += 1
                        marks[k + length] -= 1
                    i += 1
        return len(found), np.cumsum(marks[:-1]) > 0, {self.names[i] for i in items}


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _digest(doc, n_words: int, hit: np.ndarray, items: set) -> dict:
    names = sorted(x for x in items if x is not None)
    sha = hashlib.sha256(",".join(names).encode()).hexdigest()
    return {"doc_id": doc, "n_words": n_words, "n_hit": int(hit.sum()), "n_items": len(names), "items_sha256": sha, "contaminated": bool(hit.any()), "spans": _runs(hit)}


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words, end exclusive).

    The windows are broadcast if the benchmark has at most most_words words and MOST_BYTES bytes; see _joined for larger ones. A window's
    hash is only a first look; its words decide. Null texts have no words
    and no windows; items with a null id mark words but aren't listed; equal items count each; repeated document rows
    each get a row; empty tables on either side give no hits; further columns are left aside.
    """
    spark = prepare(documents.sparkSession)
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")).where("text is not null")
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"
    to = to_arrow_schema(_parse_datatype_string(schema))
    if not _small(items, most_words):
        return _joined(rows, items, window, schema, to)
    shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_digest(doc.as_py(), *held.scan(text.as_py())) for doc, text in zip(*batch.columns)], to)

    return spread(rows).mapInArrow(run, schema)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of documents without any window of the benchmark, with their columns as they were.

    Rows without a text have no window and stay, as do all if the benchmark is empty; repeated rows stay or go together;
    an empty table stays empty. With a larger benchmark, documents are cut first, as they are read twice.
    """
    spark = prepare(documents.sparkSession)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")).where("text is not null")
    if not _small(items, most_words):
        whole = cut(documents.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[documents[c] for c in documents.columns]).alias("__kept"), documents[text_col].alias("__text")))
        found = scan(whole, benchmark, window, "__row", "__text", item_col, item_text_col, most_words)
        hit = found.where("contaminated").select(F.col("doc_id").alias("__row"))
        return whole.join(hit, "__row", "left_anti").select("__kept.*")
    shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], window))

    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        held = shared.value
        return texts.map(lambda t: not held.scan(t)[1].any())

    return documents.where(free(documents[text_col]))


def _small(items: DataFrame, most_words: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether all items together have no more words and bytes than that."""
    none = F.lit(0)
    sums = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORD_CHARS))), none), F.coalesce(F.sum(F.octet_length("text")), none)).first()
    return sums[0] <= most_words and sums[1] <= most_bytes


def _keyed(text: str | None, sizes: list[int], whole: bool = False) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
    """(length, number of windows, their hashes, the words) for each window length that fits; whole: the item's own one."""
    found = words(text)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    for n in [min(sizes[0], len(found))] if whole else sizes:
        if 0 < n <= len(found):
            with np.errstate(over="ignore"):
                hashes = _rolled(ids, n) + np.uint64(n)
                yield n, len(hashes), hashes ^ hashes >> np.uint64(29), found


def _joined(rows: DataFrame, items: DataFrame, window: int, schema: str, to: pa.Schema) -> DataFrame:
    """scan() for a benchmark of any size: a filter of fixed size first, then an equi-join on the windows' words.

    Documents send only windows that the filter passes: those of items, and of others the share of its bits that are
    set. Lengths below the window are looked for only where an item is that short. A hot window is one row of the items
    for each that has it, and Spark's skew join splits the documents' side.
    """
    pair = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("bit", pa.int64()), ("item", pa.string())])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, count, hashes, found in _keyed(text, [window], True):
                    keys = dict(zip((b" ".join(found[k : k + n]) for k in range(count)), (hashes % np.uint64(FILTER_BITS) + np.uint64(1)).tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary()), pa.array([n] * len(keys), pa.int32()), pa.array(list(keys.values()), pa.int64()), pa.array([item] * len(keys), pa.string())], schema=pair)

    marks = cut(items.mapInArrow(item_windows, "key binary, n int, bit long, item string").distinct())
    lengths = sorted(r[0] for r in marks.select("n").distinct().collect())
    parts = marks.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, bits in parts.toLocalIterator():  # bits count from 1, as buckets do
        bitmap[(b - 1) * 4096 :][: len(bits)] |= np.frombuffer(bits, np.uint8)[: len(bitmap) - (b - 1) * 4096]
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, lengths))
    rows = cut(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
    sent = pa.schema([("row", pa.int64()), ("key", pa.binary()), ("at", pa.int32()), ("n", pa.int32())])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        for batch in batches:
            for row, text in zip(*batch.columns):
                for n, _, hashes, found in _keyed(text.as_py(), sizes):
                    place = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
                    hits = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist()
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(hits), pa.int64()), pa.array([b" ".join(found[k : k + n]) for k in hits], pa.binary()), pa.array(hits, pa.int32()), pa.array([n] * len(hits), pa.int32())], schema=sent)

    held = rows.select("row", "text").mapInArrow(passed, "row long, key binary, at int, n int")
    hits = held.join(marks.select("key", "n", "item"), ["key", "n"]).groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("at"), F.collect_set("item").alias("items"))
    found = rows.join(hits, "row", "left").select("doc_id", "text", "at", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, at, names in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(words(text))
                marks = np.zeros(n + 1, np.int64)
                for x in at or ():
                    marks[x["at"]] += 1
                    marks[x["at"] + x["n"]] -= 1
                out.append(_digest(doc, n, np.cumsum(marks[:-1]) > 0, set(names or ())))
            yield pa.RecordBatch.from_pylist(out, to)

    return found.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
dw AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l
      FROM (SELECT DISTINCT k, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
