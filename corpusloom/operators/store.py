"""A table of points in buckets, by a hash of their keys: a change rewrites the buckets it touches, and a reader sees one version.

data/<name>/bucket=<b> has a bucket as one write left it; manifest/<n>.json says which write's folder of each bucket counts in version n. A version
is there when its manifest is, which is written beside its place and renamed. Folders of older versions stay until vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def _fs(spark: SparkSession, path: str):
    """(file system, a function that makes its paths)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    top = at(f"{path}/manifest")
    names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    found = versions(spark, path)
    if not found:
        raise ValueError(f"no table in {path}")
    stream = _fs(spark, path)[0].open(_fs(spark, path)[1](f"{path}/manifest/{found[-1] if version is None else version}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Makes a version the current one. Of two writers that began at the same version one fails, and what it wrote doesn't count."""
    fs, at = _fs(spark, path)
    place, new = at(f"{path}/manifest/{manifest['version']}.json"), at(f"{path}/manifest/.{manifest['version']}.new")
    fs.mkdirs(at(f"{path}/manifest"))
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(new, place):
        raise RuntimeError(f"version {manifest['version']} of {path} was written by another; try again on it")


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, manifest: dict, touched: list[int]) -> dict:
    """Writes the touched buckets anew and gives the next manifest. Buckets are spread over files by ranges of the keys, so a large one isn't one task's."""
    spark, version, key = rows.sparkSession, manifest["version"] + 1, manifest["key"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = uuid.uuid4().hex  # each write has a folder of its own, so one that fails does no harm
    top = f"{path}/data/{name}"
    columns = StructType.fromJson(manifest["columns"]).names
    dealt = rows.select(*columns).withColumn("bucket", _bucket(key, manifest["buckets"])).repartitionByRange(tasks, "bucket", key).sortWithinPartitions("bucket", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(top)
    fs, at = _fs(spark, path)
    made = {x.getPath().getName().removeprefix("bucket=") for x in fs.listStatus(at(top)) if x.isDirectory()}
    folders = {b: v for b, v in manifest["folders"].items() if int(b) not in set(touched)} | dict.fromkeys(sorted(made), name)
    return manifest | {"version": version, "folders": folders}


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    wanted = [f"{path}/data/{name}/bucket={b}" for b, name in manifest["folders"].items() if buckets is None or int(b) in set(buckets)]
    schema = StructType.fromJson(manifest["columns"])
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def create(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Writes df as version 0 of a table. Rows with a null key are one bucket's like others."""
    start = {"version": -1, "key": key, "buckets": buckets, "columns": json.loads(df.schema.json()), "folders": {}}
    _commit(df.sparkSession, path, _write(df, path, start, []))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as the last version, or a given one, has it; later changes don't reach a frame that was made before."""
    return _rows(spark, path, _manifest(spark, path, version))


def _touched(keys: DataFrame, manifest: dict) -> list[int]:
    return sorted(r[0] for r in keys.select(_bucket(manifest["key"], manifest["buckets"])).distinct().collect())


def upsert(new: DataFrame, path: str) -> list[int]:
    """Rows of new in place of those with the same key, or beside the others; the buckets that were rewritten. The same rows as vector.upsert; an empty new changes nothing."""
    spark = new.sparkSession
    manifest = _manifest(spark, path)
    touched = _touched(new, manifest)
    if touched:
        key = manifest["key"]
        rest = _rows(spark, path, manifest, touched).join(new.select(key), key, "left_anti")
        _commit(spark, path, _write(rest.unionByName(new.select(*rest.columns)), path, manifest, touched))
    return touched


def delete_where(spark: SparkSession, path: str, where: dict[str, str]) -> list[int]:
    """Rows whose columns equal where go; the buckets that were rewritten. Only the named columns are read to find them."""
    manifest, gone = _manifest(spark, path), F.lit(True)
    for name, value in where.items():
        gone &= F.coalesce(F.col(name).cast("string") == F.lit(value), F.lit(False))
    touched = _touched(_rows(spark, path, manifest).where(gone), manifest)
    if touched:
        _commit(spark, path, _write(_rows(spark, path, manifest, touched).where(~gone), path, manifest, touched))
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what none of the last keep versions needs; how many bucket folders went. Readers of older versions and other writers must have ended."""
    fs, at = _fs(spark, path)
    found = versions(spark, path)
    needed = {f"{name}/bucket={b}" for n in found[-keep:] for b, name in _manifest(spark, path, n)["folders"].items()}
    gone = 0
    for write in fs.listStatus(at(f"{path}/data")):
        for folder in fs.listStatus(write.getPath()):
            name = f"{write.getPath().getName()}/{folder.getPath().getName()}"
            if folder.isDirectory() and name not in needed:
                gone += fs.delete(folder.getPath(), True)
    for n in found[:-keep]:
        fs.delete(at(f"{path}/manifest/{n}.json"), False)
    return gone
