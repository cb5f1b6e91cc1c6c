"""Centroid clustering: Lloyd's rounds over distinct integer vectors that count as often as they occur."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, cut, pick, prepare, read

#: Components are held within this bound (x within 131072 at a scale of 1024), so that a distance of 64 of them fits a long.
BOUND = 1 << 27
LARGEST = (1 << 63) - 1
_WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Clusters:
    """members: id, cluster, distance, a row per kept vector. centroids: of each cluster, by its number. n, inertia: its vectors, and the sum of their distances."""

    members: DataFrame
    centroids: list[list[int]]
    n: list[int]
    inertia: list[int]


def quantised(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as a double, held within BOUND."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return F.transform(vec, lambda x: F.least(F.greatest(whole(x), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))


def kept(vec: Column, dims: int) -> Column:
    """Whether vec has dims components, none of them null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, finite), F.lit(False))


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
    apart = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(q)), at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Tasks sum what they read into a row per cluster; those are added up in Spark, and a number per component of each cluster comes back."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            q, n = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            at, _ = _nearest(q, centroids)
            wide = object if n.astype(float).sum() >= 1 << 35 else np.int64
            for c in np.unique(at):
                own = at == c
                total[c] += (q[own].astype(wide) * n[own].astype(wide)[:, None]).sum(axis=0)
                count[c] += sum(map(int, n[own]))
        held = [c for c in range(k) if count[c]]
        big = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([count[c] for c in held], big), pa.array([[int(x) for x in total[c]] for c in held], pa.list_(big))], names=["c", "n", "s"])

    parts = distinct.select("q", "n").mapInArrow(sums, f"c int, n {_WIDE}, s array<{_WIDE}>")
    each = parts.select("c", "n", F.posexplode("s").alias("i", "x"))
    new = centroids.copy()
    for r in each.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        new[r["c"], r["i"]] = int(r["x"]) // int(r["n"])
    return new


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> Clusters:
    """Lloyd's algorithm in whole numbers over the vectors of vec_col with dims components, all finite.

    Equal quantised vectors are grouped first, with their number, so a round costs as much as there are distinct ones,
    and a vector that a third of the rows hold is one row. The first centroids are the k vectors whose "seed:id" has
    the smallest SHA-256, by that hash, of repeated ids by their components; a centroid that loses its vectors stays.
    The distinct vectors' clusters are joined back to the rows by a digest of the components; those of the most
    frequent vectors (at most 1 / SHARE) are broadcast, so no task gets the rows of a hot one.

    Vectors that are null, too short or long, or hold a null, NaN or infinity are left out. A null id counts as an empty
    one in the hash. Repeated rows each count and each get a row. Components beyond BOUND count as BOUND. Fewer than k
    vectors give fewer clusters, an empty table an empty result. Further columns are left aside.
    """
    prepare(df.sparkSession)
    rows = pick(df, id=id_col, vec=vec_col).where(kept(F.col("vec"), dims)).select("id", quantised(F.col("vec"), scale).alias("q"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("q").cast("array<string>"), ","), 256)))
    distinct = cut(keyed.groupBy("key", "q").agg(F.count("*").alias("n")))
    centroids = np.array([r["q"] for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        none = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return Clusters(none, [], [], [])
    for _ in range(rounds):
        new = _round(distinct, centroids)
        if (new == centroids).all():
            break  # so would all further rounds
        centroids = new

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, apart = _nearest(_matrix(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(apart, pa.int64()), batch.column(2)], names=["key", "cluster", "distance", "n"])

    found = cut(distinct.select("key", "q", "n").mapInArrow(assign, "key binary, cluster int, distance long, n long"))
    sums = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast(_WIDE) * F.col("n")).alias("d")).collect()}
    n = [int(sums[c]["n"]) if c in sums else 0 for c in range(len(centroids))]
    inertia = [int(sums[c]["d"]) if c in sums else 0 for c in range(len(centroids))]
    often = F.col("n") > sum(n) * SHARE
    hot = F.broadcast(found.where(often).select("key", F.col("cluster").alias("__c"), F.col("distance").alias("__d")))
    marked = keyed.select("id", "key").join(hot, "key", "left")
    rest = marked.where("__c IS NULL").select("id", "key").join(found.where(~often), "key")
    members = marked.where("__c IS NOT NULL").select("id", F.col("__c").alias("cluster"), F.col("__d").alias("distance")).unionByName(rest.select("id", "cluster", "distance"))
    return Clusters(members, centroids.tolist(), n, inertia)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "embeddings"))
    held = [(c, min(found.inertia[c], LARGEST), min(sum(found.inertia), LARGEST), ",".join(map(str, x))) for c, x in enumerate(found.centroids)]
    clusters = spark.createDataFrame(held, "cluster int, cluster_inertia long, inertia long, words string")
    return found.members.join(F.broadcast(clusters), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("words", 256).alias("centroid_sha256")
    )


def _sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT n, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
  SELECT v.n, c.c, {apart} AS d FROM v, c{i} c) GROUP BY n)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS m FROM (
  SELECT a.c, unnest(v.q) AS x, unnest(range(64)) AS i FROM v JOIN a{i} a USING (n)) GROUP BY c, i),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(any_value(n.q), any_value(o.q)) AS q FROM c{i} o LEFT JOIN (
  SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS q FROM s{i} GROUP BY c) n ON n.c = o.c GROUP BY o.c)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c, q FROM v QUALIFY c < {k}),
{", ".join(steps)}
SELECT v.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (n) JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
