"""Vectors: hash embeddings, cosine, filtered and batched top-k, upserts and deletes by key."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import col
from ..session import spread


def hash_embedding(text: Column | str, dim: int = 768) -> Column:
    """Signed token counts in dim places, by SHA-256 of each token, with norm 1 (or all zero).

    The first four bytes give the place, the parity of the fifth the sign. Tokens are sorted by place and sign among one
    mark for each; counts are the distances of the marks, so the work doesn't grow with tokens times places.
    """
    hashed = F.transform(X.tokens(F.coalesce(col(text), F.lit(""))), lambda w: F.sha2(w, 256))
    place = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    less = lambda h: F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2
    among = F.array_sort(F.concat(F.transform(hashed, lambda h: place(h) * 4 + less(h) * 2), F.sequence(F.lit(1), F.lit(4 * dim - 1), F.lit(2))))
    marks = lambda e: F.filter(F.transform(e, lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())
    count = lambda m, i: 2 * F.get(m, 2 * i) - F.coalesce(F.get(m, 2 * i - 1), F.lit(-1)) - F.get(m, 2 * i + 1)
    sums = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: count(m, i).cast("double"))
    return X.let(X.let(X.let(among, marks), sums), normalized)


def sparse_embedding(df: DataFrame, key: str, text: str, dim: int = 768) -> DataFrame:
    """(key, i, v): the places of hash_embedding that aren't zero, for texts of any length: token counts combine before the shuffle, and words are hashed once."""
    words = spread(df.select(key, text)).select(key, F.explode(X.tokens(F.coalesce(text, F.lit("")))).alias("w")).select(key, F.sha2("w", 256).alias("h"))
    # Never null, or a join on i would hash all words once more to see that it isn't
    place = F.coalesce(F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"), F.lit(0))
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy(key, place.alias("i")).agg(F.sum(sign).alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.withColumn("__norm", length).where(F.col(key).isNotNull()).select(key, "i", (F.col("v") / F.col("__norm")).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    return X.let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Over the common length; 0 where a norm is 0."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def search(points: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", where: dict[str, str] | None = None) -> DataFrame:
    """The k points nearest to query, of those whose columns equal where; ties by key."""
    held = points
    for name, value in (where or {}).items():
        held = held.where(F.col(name).cast("string").eqNullSafe(F.lit(value)))
    score = cosine(vector, F.array(*[F.lit(float(x)) for x in query]))
    return held.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


#: Queries that are broadcast at once where rows meet one by one; queries and points of a block where blocks meet.
BATCH, QUERIES, POINTS = 1024, 4096, 16384
#: What a product of matrices may differ from the sum in order, far above its rounding for unit vectors.
MARGIN = 1e-9


def _proper(v: Column, dim: int) -> Column:
    """Whether a vector has dim plain numbers and a norm that rounding can't spoil."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (norm(v) > 1e-100) & (norm(v) < 1e100), F.lit(False))


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first component on, as dot() does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def block_best(points: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, key, score) of a block of points (key, vector) and one of queries (query, qv): for each query at least its k best, scores as cosine() has them.

    A product of matrices says which points are within MARGIN of a query's k-th best; only these are scored. Of equal
    vectors the k smallest keys are enough.
    """
    points = points.sort_values("key", ignore_index=True)
    p, q = _matrix(points["vector"]), _matrix(asked["qv"])
    _, same = np.unique(p, axis=0, return_inverse=True)
    few = pd.Series(same.ravel()).groupby(same.ravel()).cumcount().to_numpy() < k
    points, p = points[few], p[few]
    size, length = np.sqrt(_in_order(p, p)), np.sqrt(_in_order(q, q))
    unit, out = (p / size[:, None]).T, []
    for at in range(0, len(q), 256):
        near = (q[at : at + 256] / length[at : at + 256, None]) @ unit
        low = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        i, j = np.nonzero(near >= low[:, None] - MARGIN)
        i += at
        score = _in_order(p[j], q[i]) / (size[j] * length[i])
        out.append(pd.DataFrame({"query": asked["query"].to_numpy()[i], "key": points["key"].to_numpy()[j], "score": score}))
    return pd.concat(out)


def search_batch(points: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", batch: int = BATCH) -> DataFrame:
    """(query, key, score, rank): the k nearest points of each query (query, qv), ties by key.

    Vectors of the most frequent length meet as blocks: points are dealt into blocks of about POINTS, queries of about
    QUERIES, and each pair of blocks is a task of bounded size. What has nulls, NaN, no direction or another length meets
    the others row by row, with cosine().
    """
    points, queries = points.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")), queries.select("query", F.col("qv").cast("array<double>").alias("qv"))
    sizes = points.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else -1
    of, asked = _proper(F.col("vector"), dim), _proper(F.col("qv"), dim)
    held = points.agg(F.count_if(of).alias("good"), F.count_if(~of).alias("bad")).first()
    met = queries.agg(F.count_if(asked).alias("good"), F.count_if(~asked).alias("bad")).first()
    found = []
    if dim > 0 and held["good"] and met["good"]:
        found.append(_blocks(points.where(of), queries.where(asked), k, held["good"], met["good"]))
    if held["bad"]:
        found.append(_row_by_row(points.where(~of), queries, k, batch))
    if met["bad"]:
        found.append(_row_by_row(points.where(of), queries.where(~asked), k, batch))
    if not found:
        found = [_row_by_row(points, queries, k, batch)]
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    out = reduce(DataFrame.unionByName, found).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
    return out.select("query", F.col("key").alias(key), "score", "rank")


def _blocks(points: DataFrame, queries: DataFrame, k: int, n: int, m: int) -> DataFrame:
    """(query, key, score) of what block_best finds in each pair of blocks; n points and m queries."""
    parts, turns = -(-n // POINTS), -(-m // QUERIES)
    left = points.withColumn("p", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = queries.withColumn("t", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, key {points.schema['key'].dataType.simpleString()}, score double"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_best(a, b, k) if len(a) and len(b) else pd.DataFrame({"query": b["query"][:0], "key": a["key"][:0], "score": pd.Series([], dtype="float64")})

    return left.groupBy("p", "t").cogroup(right.groupBy("p", "t")).applyInPandas(run, schema)


def _row_by_row(points: DataFrame, queries: DataFrame, k: int, batch: int) -> DataFrame:
    """(query, key, score) of the k best, by cosine() of every pair. Queries are broadcast in batches; ranks cut rows beyond k in each task, before the shuffle."""
    n = queries.count()
    parts, out = -(-n // batch) or 1, None
    for part in range(parts):
        some = queries.select("query", "qv")
        some = some.where(F.pmod(F.xxhash64("query", F.lit("batch")), F.lit(parts)) == part) if parts > 1 else some
        met = points.crossJoin(F.broadcast(some)).select("query", "key", cosine("vector", "qv").alias("score"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
        found = met.withColumn("rank", place).where(F.col("rank") <= k).drop("rank")
        out = found if out is None else out.unionByName(found)
    return out


def counts(points: DataFrame, by: str, values: list | None = None, vector: str = "vector") -> DataFrame:
    """(by, n, dims): points and the largest number of dimensions of each value of a payload column, or of those in values."""
    held = points if values is None else points.where(F.col(by).cast("string").isin(*values))
    return held.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dims"))


def status(points: DataFrame, by: str, dim: int, vector: str = "vector") -> DataFrame:
    """(by, points, valid): points of each project, and those whose vectors have dim numbers."""
    return points.groupBy(by).agg(F.count("*").alias("points"), F.count_if(F.size(vector) == dim).alias("valid"))


def upsert(points: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return points.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(points: DataFrame, where: dict[str, str]) -> DataFrame:
    gone = F.lit(True)
    for name, value in where.items():
        gone &= F.coalesce(F.col(name).cast("string") == F.lit(value), F.lit(False))
    return points.where(~gone)


def point_id(*parts: Column | str) -> Column:
    """A version 5 UUID in the URL namespace over the parts joined by bars."""
    name = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
