"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name, tmp_path):
    """Each frame is written as files too, so its columns must have names of their own."""
    df = QUERIES[name](spark, sf)
    df.write.parquet(str(tmp_path / "q"))
    df = spark.read.parquet(str(tmp_path / "q"))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0


def test_context_blocks_are_of_all_documents(spark, sf):
    assert QUERIES["context_blocks"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_routes_of_the_questions_alone(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import retrieve
    from corpusloom.plans import retrieval

    df = spark.createDataFrame([(q,) for q in retrieval.ASKED], "q string").coalesce(1)
    assert [r[0] for r in df.select(retrieve.task(F.col("q"))).collect()] == retrieval._ROUTED
