"""Keyword search by an inverted index: posting lists of trigrams as files, intersected by joins, then verified.

Two tables lie in the index's folder, both in folders by a hash, so a search reads only those of its grams and of its candidates:
grams/part=p holds (gram, keys, n), sorted by gram: n keys that one block of points gives, so a gram has several rows; points/part=p the points with what is searched in them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..session import python_path, spread
from . import retrieve

GRAM = 3
#: Folders of either table. Grams of a word that are looked up: of more the rarest are taken, as verification decides anyway.
PARTS, LOOKED_UP = 256, 6
#: Characters of a block of texts whose lists are made at once.
BLOCK = 1 << 22


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text; none of a shorter one. Linear in the text: characters are split once."""
    none = F.array().cast("array<string>")
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)]))
    return X.let(F.split(text, ""), lambda c: F.when(F.size(c) >= GRAM, F.array_distinct(runs(c))).otherwise(none))


def _part(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def block_lists(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """(gram, keys) of texts, in blocks of about BLOCK characters: every gram once a block, with the keys of the block's texts that have it. A gram with a byte that is no character has no row: no word has it."""
    sizes = np.array([len(t) for t in texts], "int64")
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        chars = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), "uint32")
        alphabet, letter = np.unique(chars, return_inverse=True)
        doc = np.repeat(np.arange(to - at), sizes[at:to])
        first = np.flatnonzero(doc[: len(doc) - GRAM + 1] == doc[GRAM - 1 :]) if len(doc) >= GRAM else np.zeros(0, "int64")
        gram, letter = np.zeros(len(first), "uint64"), letter.astype("uint64")
        for i in range(GRAM):  # at most 21 bits a character
            gram = gram * np.uint64(len(alphabet)) + letter[first + i]
        if len(alphabet) ** GRAM * (to - at) < 2**64:
            pairs = np.unique(gram * np.uint64(to - at) + doc[first].astype("uint64"))
            gram, doc = np.divmod(pairs, np.uint64(to - at))
        else:
            known, gram = np.unique(gram, return_inverse=True)
            pairs = np.unique(gram * (to - at) + doc[first])
            gram, doc = known[pairs // (to - at)], pairs % (to - at)
        edges = np.flatnonzero(np.diff(gram, prepend=gram[:1] + np.uint64(1)))
        names, left = np.empty((len(edges), GRAM), "uint32"), gram[edges]
        for i in reversed(range(GRAM)):
            left, place = np.divmod(left, np.uint64(len(alphabet)))
            names[:, i] = alphabet[place.astype("int64")]
        whole = ~((names >= 0xD800) & (names < 0xE000)).any(axis=1)
        text = names.tobytes().decode("utf-32-le", "surrogatepass")
        listed = pa.ListArray.from_arrays(pa.array(np.append(edges, len(gram)), "int32"), keys.take(pa.array(doc.astype("int64") + at)))
        held = pa.RecordBatch.from_arrays([pa.array([text[GRAM * i : GRAM * i + GRAM] if good else None for i, good in enumerate(whole.tolist())], "string"), listed], ["gram", "keys"])
        yield held.filter(pa.array(whole))
        at = to


def _listed(held: DataFrame) -> DataFrame:
    """(gram, keys) of held (key, blob): lists of the blocks of a task's texts."""
    kind = held.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from block_lists(batch.column(0), [t.decode("utf-8", "surrogateescape") for t in batch.column(1).to_pylist()])

    python_path(held.sparkSession)
    return held.mapInArrow(run, f"gram string, keys array<{kind}>")


def _dealt(df: DataFrame, parts: int, salt: Column) -> DataFrame:
    """df (part) by folders, each over several tasks by salt if there are more tasks than folders: no pass over df to find ranges."""
    each = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
    return df.repartitionById(parts * each, (F.col("part") * each + F.pmod(F.xxhash64(salt, F.lit("task")), F.lit(each))).cast("int"))


def build(points: DataFrame, path: str, key: str = "id", parts: int = PARTS) -> None:
    """Writes the index of points to the folder path. Keys must differ.

    Tasks make the lists of blocks of their texts, so what is shuffled is a row a gram and block, and keys. A gram that most points have is
    spread over several files by its lists, so no task gets all of them. Null fields count as empty.
    """
    spark = points.sparkSession
    spark.createDataFrame([(parts, key, points.schema.json(), points.schema[key].dataType.simpleString())], "parts int, key string, columns string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    held = points.withColumns({"__blob": retrieve.searched_text(points), "__path": retrieve.searched_path(points)})
    _dealt(held.withColumn("part", _part(F.col(key), parts)), parts, F.col(key)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/points")
    listed = _listed(spread(held.select(F.col(key).alias("key"), F.col("__blob").cast("binary").alias("blob"))))
    listed = listed.select("gram", "keys", F.size("keys").alias("n"), _part(F.col("gram"), parts).alias("part"))
    _dealt(listed, parts, F.get("keys", 0)).sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")
    counts = _lists(spark, path).groupBy("part", "gram").agg(F.sum("n").alias("n"))
    _dealt(counts, parts, F.col("gram")).sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/about").first()["kind"]
    return spark.read.schema(f"gram string, keys array<{kind}>, n int, part int").parquet(f"{path}/grams")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(word, key): the points that have all the grams of a word that are looked up; words are in lower case and of GRAM letters or more.

    Grams that no point has rule a word out; else its LOOKED_UP rarest ones are intersected by counting.
    """
    parts = spark.read.parquet(f"{path}/about").first()["parts"]
    asked = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.explode(grams(F.col("word"))).alias("gram")).withColumn("part", _part(F.col("gram"), parts))
    pairs = [(r["word"], r["gram"], r["part"]) for r in asked.collect()]
    places = sorted({p for _, _, p in pairs})
    known = {r["gram"]: r["n"] for r in spark.read.schema("gram string, n long, part int").parquet(f"{path}/counts").where(F.col("part").isin(places) & F.col("gram").isin(sorted({g for _, g, _ in pairs}))).collect()}
    chosen = []
    for word in dict.fromkeys(words):
        own = sorted((known.get(g, 0), g, p) for w, g, p in pairs if w == word)
        if own and own[0][0]:
            chosen += [(word, g, min(len(own), LOOKED_UP)) for _, g, _ in own[:LOOKED_UP]]
    lists = _lists(spark, path).where(F.col("part").isin(sorted({p for _, g, p in pairs if g in {c[1] for c in chosen}})) & F.col("gram").isin(sorted({c[1] for c in chosen})))
    wanted = spark.createDataFrame(chosen, "word string, gram string, need int")
    met = lists.select("gram", F.explode("keys").alias("key")).join(F.broadcast(wanted), "gram").groupBy("word", "need", "key").agg(F.count("*").alias("n"))
    return met.where("n = need").select("word", "key")


def search(spark: SparkSession, path: str, symbols: list[str], fragments: list[str], limit: int) -> DataFrame:
    """What retrieve.keyword_search gives of the indexed points: the same rows, score and order.

    Only folders that hold candidates are read of the points, and each candidate is verified. A word of fewer letters than a gram has can't be looked
    up: with one, all points are looked at.
    """
    about = spark.read.parquet(f"{path}/about").first()
    words = [*dict.fromkeys([s.lower() for s in symbols] + list(fragments))]
    columns = StructType.fromJson(json.loads(about["columns"])).add("__blob", "string").add("__path", "string").add("part", "integer")
    points = spark.read.schema(columns).parquet(f"{path}/points")
    if all(len(w) >= GRAM for w in words):
        found = postings(spark, path, words).select("key").distinct()
        first = found.withColumn("part", _part(F.col("key"), about["parts"]))
        places = [r[0] for r in first.select("part").distinct().collect()]
        points = points.where(F.col("part").isin(places)).join(found.withColumnRenamed("key", about["key"]), about["key"], "left_semi")
    hit = F.lit(False)
    for s in symbols:
        hit |= F.col("__blob").contains(s.lower())
    for f in fragments:
        hit |= F.col("__path").contains(f)
    return points.where(hit).drop("part", "__blob", "__path").withColumn("score", F.lit(0.55)).orderBy(about["key"]).limit(limit)
