"""Budgets over ordered texts. They are folds: what doesn't fit uses nothing, so no running sum can say what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def skip_if_not_fit(df: DataFrame, group: list[str], order: str, size: str, budget: int) -> DataFrame:
    """(group, order): the rows that are kept, in order, where one that would go beyond the budget is skipped.

    What is left never grows, so of rows of one size the first ones are kept, at most budget / size of them: only those
    go into the fold, which bounds it whatever a group's number of rows. Rows without a size are all kept, outside of it.
    order may be of any type that sorts, a struct too. A budget below 0 keeps nothing.
    """
    kind = df.schema[order].dataType.simpleString()
    state = f"struct<left: bigint, kept: array<{kind}>>"
    rows = df.select(*group, F.col(order).alias("__o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n")).where(F.lit(budget >= 0))
    free = rows.where("__n <= 0").select(*group, F.col("__o").alias(order))
    place = F.row_number().over(Window.partitionBy(*group, "__n").orderBy("__o"))
    held = rows.where(F.col("__n").between(1, budget)).withColumn("__k", place).where((F.col("__k") <= max(budget, 0)) & (F.col("__k") * F.col("__n") <= budget))
    listed = held.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__n").alias("n")))).alias("rows"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{kind}>").alias("kept")).cast(state)
    step = lambda s, r: F.when(r["n"] <= s["left"], F.struct((s["left"] - r["n"]).alias("left"), F.concat(s["kept"], F.array(r["o"])).alias("kept"))).otherwise(s).cast(state)
    return listed.select(*group, F.explode(F.aggregate("rows", start, step)["kept"]).alias(order)).unionByName(free)


def pack(texts: Column, budget: int, each: int, joiner: str = "\n\n") -> Column:
    """Texts of an ordered array<struct<head, body>>, each body trimmed to what is left or to each, until nothing is left.

    A trimmed body ends in a mark, which counts too; empty bodies are passed over.
    """
    kind = "struct<left: bigint, out: array<string>>"
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("out")).cast(kind)

    def step(s, t):
        entry = F.concat(t["head"], X.trimmed(F.trim(t["body"]), F.least(F.lit(each).cast("long"), s["left"]).cast("int")))
        used = F.struct((s["left"] - F.length(entry)).alias("left"), F.concat(s["out"], F.array(entry)).alias("out"))
        return F.when((s["left"] <= 0) | (F.trim(t["body"]) == ""), s).otherwise(used).cast(kind)

    joined = F.array_join(F.aggregate(texts, start, step)["out"], joiner)
    return F.when(joined == "", "(none)").otherwise(joined)


def source_blocks(sources: DataFrame) -> DataFrame:
    """sources with block, the tagged text of each, and is_map; contents are trimmed at 6000 characters, a project map's at 2400."""
    is_map = F.coalesce(F.col("source") == "project_map", F.lit(False))
    score = F.format_string("%.3f", F.col("score"))
    named = [
        F.lit('<source file="'), F.coalesce("file_path", F.lit("")), F.lit('" lines="'), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")),
        F.lit('" symbol="'), F.coalesce("symbol_name", F.lit("unknown")), F.lit('" type="'), F.coalesce("chunk_type", F.lit("unknown")), F.lit('" score="'), score, F.lit('">\n'),
    ]
    head = F.when(is_map, F.concat(F.lit('<source type="project_map" score="'), score, F.lit('">\n'))).otherwise(F.concat(*named))
    text = F.coalesce("content", F.lit(""))
    body = F.when(is_map, X.trimmed(text, 2400)).otherwise(F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), X.trimmed(text, 6000), F.lit("\n```")))
    return sources.withColumns({"is_map": is_map, "block": F.concat(head, body, F.lit("\n</source>"))})


#: Characters that a block has at the least.
LEAST_BLOCK = 40


def packed_blocks(blocks: DataFrame, group: list[str], order: str, budget: int = 14_000) -> DataFrame:
    """(group, blocks, context): of each group the blocks that fit, one after the other, in budget characters; maps first, then by order.

    As a block has LEAST_BLOCK characters, the first budget / LEAST_BLOCK rows of a group are enough, and the others are
    cut in each task before the shuffle: no group is gathered. A group whose first block doesn't fit has no row.
    """
    first = Window.partitionBy(*group).orderBy(F.col("is_map").desc(), order)
    held = blocks.select(*group, order, "is_map", "block").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= budget // LEAST_BLOCK)
    held = held.withColumn("__used", F.sum(F.length("block")).over(first.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__used") <= budget)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__n", "block"))), lambda x: x["block"])
    return held.groupBy(*group).agg(F.count("*").alias("blocks"), F.array_join(listed, "\n\n").alias("context"))
