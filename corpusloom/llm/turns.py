"""Conversations in order, cut into runs of bounded size, so that one of any length is shared by many tasks."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, pick, prepare

#: Rows and bytes of text that a run has at most; a longer text is a run of its own.
RUN_ROWS, RUN_BYTES = 1024, 4 << 20
ROW = "struct<turn:long,role:string,text:string,copies:int>"


@dataclass(frozen=True)
class Runs:
    """Frames of conv_id, no, last and what a run holds: alone has the conversations of one run, long the runs of all others."""

    alone: DataFrame
    long: DataFrame


def same(a: Column, b: Column) -> Column:
    """a equals b, and null equals null."""
    return a.eqNullSafe(b)


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies (1) of df's rows; further columns are left aside."""
    return pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(1).alias("copies"))


def runs(rows: DataFrame, most_rows: int = RUN_ROWS, most_bytes: int = RUN_BYTES) -> Runs:
    """conv_id, no, last, rows: of each conversation, its rows in order, in runs numbered from 0.

    rows has conv_id, turn (long), role, text and copies. Rows go by turn, nulls first; of one turn by role, then by the
    text's first 64 characters and its hash, so equal rows stand together. The rows are dealt to tasks by ranges of this order, with
    the row's own number last: neither a conversation nor a row that comes very often has to fit in a task. A run ends with its task's range,
    with most_rows, or with most_bytes. Kept in the shared folder. A null conv_id is a conversation like any other.
    """
    spark = prepare(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "__head", "__hash", "__salt"]
    keyed = rows.withColumns({"__head": F.substring("text", 1, 64), "__hash": F.xxhash64("text"), "__salt": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs with the task's number, and whether the conversation may go on before the first or after the last one here."""
        part, out, schema = TaskContext.get().partitionId(), [], None
        now, held, size, seq, first = None, [], 0, 0, True

        def emit(ends: bool, edge: bool = False) -> None:
            out.append((now[0], part, seq, ends, edge, held))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=["conv_id", "part", "seq", "ends", "edge", "rows"])
            out.clear()
            return made

        for batch in batches:
            if schema is None:
                row = pa.struct([("turn", pa.int64()), ("role", batch.schema.field(2).type), ("text", batch.schema.field(3).type), ("copies", pa.int32())])
                schema = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(row)]
            for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is None:
                    now = (conv,)
                elif now[0] != conv:
                    emit(True, first)
                    now, held, size, seq, first = (conv,), [], 0, 0, False
                elif len(held) >= most_rows or size + len(text or "") > most_bytes:
                    emit(False)
                    held, size, seq = [], 0, seq + 1
                held.append({"turn": turn, "role": role, "text": text, "copies": copies})
                size += len(text or "")
            if out:
                yield flush()
        if now is not None:
            emit(True, True)
            yield flush()

    made = cut(dealt.mapInArrow(gather, f"conv_id {kind}, part int, seq long, ends boolean, edge boolean, rows array<{ROW}>"))
    # What has a task's first or last rows may go on in another task: number those across tasks. At most two conversations a task.
    over = Window.partitionBy("conv_id").orderBy("part")
    spans = made.where("ends AND edge").select(
        F.col("conv_id").alias("__conv"), F.col("part").alias("__part"),
        F.coalesce(F.sum(F.col("seq") + 1).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("part").over(over).isNull().alias("final"),
    )
    joined = made.join(F.broadcast(spans), same(made["conv_id"], F.col("__conv")) & (made["part"] == F.col("__part")), "left")
    last = F.col("ends") & F.coalesce(F.col("final"), F.lit(True))
    found = joined.select("conv_id", (F.col("seq") + F.coalesce("before", F.lit(0))).alias("no"), last.alias("last"), "rows")
    alone = (F.col("no") == 0) & F.col("last")
    return Runs(found.where(alone), found.where(~alone))


def in_order(found: Runs, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What step makes of the runs, of which it gets all those of a conversation one after the other, in order.

    Whole conversations stay in the task that has them. The runs of longer ones are sorted on disk and pass by one at a time.
    """
    long = found.long.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "no")
    return found.alone.mapInArrow(step, schema).unionByName(long.mapInArrow(step, schema))
