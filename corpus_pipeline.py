"""A training corpus from raw documents: rules, near-dedup, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents, further
ones with any names among them, and an empty table gives an empty one. Stages read their input as files, so a lost
executor costs the work of one stage at most.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontaminate, quality, secrets, simhash, warc


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and empty texts have no words and go; repeated rows each stay or go; an empty table stays empty."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; null ids come last, and of repeated rows one stays. Null and empty texts are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. A null text has none and stays; repeated rows stay or go together."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, where there is one, counted anew. A null text stays null, and so does its n_chars."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, their number, and digests of the ids and of the bytes that they decode to. A null text counts as empty; repeated rows each get a row."""
    common.prepare(spark)
    return bpe.encode(docs, *bpe.default_files())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the secret scans' tests and the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage gives is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    top = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(warc.remove, top)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
    return docs
