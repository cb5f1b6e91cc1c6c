"""Sessions and tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTIVES = ("auto_complete", "code_gen", "bug_detection", "bug_fix", "perf_opt", "test_gen", "refactoring")


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine expects; on a cluster, use your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def python_path(spark: SparkSession) -> None:
    """Lets Python workers find this package."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, paths)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path, below the one that all executors share; where the session names none, a temporary one, on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


#: Steps of a plan that take rows one by one, in order.
_PLAIN = {"WholeStageCodegenExec", "InputAdapter", "ColumnarToRowExec", "ProjectExec", "FilterExec", "UnionExec", "FileSourceScanExec", "LocalTableScanExec"}


def plain_scan(df: DataFrame) -> bool:
    """Whether df is what files or a checkpoint give, row by row: cheap to read again, in the same order each time."""

    def plain(step) -> bool:
        kind = step.getClass().getSimpleName()
        if kind == "RDDScanExec":
            return step.rdd().isCheckpointed()
        below = step.children()
        return kind in _PLAIN and all(plain(below.apply(i)) for i in range(below.size()))

    return plain(df._jdf.queryExecution().executedPlan())


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for steps that compute much, where its files give fewer splits than there are cores; a larger input, or what isn't a plain scan, stays as it is."""
    if not plain_scan(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as unified records; ord is their order, source plays the repository."""
    docs = table(spark, sf_dir, "documents")
    objective = F.element_at(F.array(*[F.lit(o) for o in OBJECTIVES]), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), objective.alias("objective"), F.col("lang").alias("language"),
        F.col("text").alias("input"), F.lit("").alias("output"), F.lit("").alias("context"), F.col("source").alias("repo"),
    )


_CASES = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OBJECTIVES))
#: records() as a DuckDB subquery.
RECORDS_SQL = f"""(SELECT doc_id AS ord, doc_id::VARCHAR AS id, CASE doc_id % 7 {_CASES} END AS objective, lang AS language,
  text AS input, '' AS output, '' AS context, source AS repo FROM documents)"""
