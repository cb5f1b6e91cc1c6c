"""All queries of the engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, filters
from ..session import records
from . import build, code, corpus, extras, retrieval, search, trees  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records filtered by reason, without exact copies, counted by language and objective."""
    held = filters.corpus_reasons(records(spark, sf_dir), ["en", "de", "fr", "es"]).where("reason IS NULL").drop("reason")
    return dedup.exact(held, ["objective", "language", "input", "output", "context"]).groupBy("language", "objective").agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
