"""Conversation windows: last turns, recent files, references such as "both"."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import budget


def last_turns(df: DataFrame, session: list[str], order: str, n: int) -> DataFrame:
    """The n rows of each session with the largest order. Spark's window group limit keeps n rows of a session before the shuffle."""
    w = Window.partitionBy(*session).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def recent_files(turns: DataFrame, session: list[str], order: str = "turn_no") -> DataFrame:
    """(session, files): files of the last ten turns, newest first, each once; within a turn the references, then the active file."""
    held = last_turns(turns, session, order, 10)
    listed = F.concat(F.coalesce("files_referenced", F.array().cast("array<string>")), F.array_compact(F.array("active_file")))
    rows = held.select(*session, order, F.posexplode(listed).alias("p", "file"))
    first = rows.groupBy(*session, "file").agg(F.min(F.struct((-F.col(order)).alias("t"), "p")).alias("r"))
    return first.groupBy(*session).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "file"))), lambda x: x["file"]).alias("files"))


def resolve(instruction, files):
    """Files that phrases in the instruction stand for, given recent files, newest first."""
    low, n = F.lower(instruction), F.size(files)
    none = F.array().cast("array<string>")
    one = lambda i: F.filter(F.array(F.get(files, i)), lambda x: x.isNotNull())
    found = F.concat(
        F.when(low.contains("previous file") | low.contains("that file") | low.contains("the file"), one(0)).otherwise(none),
        F.when(low.contains("the first file") & (n >= 2), one(1)).otherwise(none),
        F.when(low.contains("the second file") & (n >= 1), one(0)).otherwise(none),
        F.when(low.contains("both") & (n >= 2), F.slice(files, 1, 2)).otherwise(none),
    )
    return F.coalesce(F.array_distinct(found), none)


def history(messages: DataFrame, session: list[str], order: str, n: int = 8, total: int = 6000, each: int = 1200) -> DataFrame:
    """(session, history): the last n messages under a budget of characters."""
    held = last_turns(messages, session, order, n)
    head = F.concat(F.when(F.trim(F.coalesce("role", F.lit(""))) == "", "message").otherwise(F.trim("role")), F.lit(": "))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), head.alias("head"), F.coalesce("text", F.lit("")).alias("body"))))
    return held.groupBy(*session).agg(budget.pack(F.transform(rows, lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"))), total, each).alias("history"))
