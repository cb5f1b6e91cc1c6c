"""Chat formatting: conversations through a template that is a black box, with each turn's place found by rendering.

A template is a function from turns (role, text) to a string. Turn after turn the turns so far are rendered; where an
output goes on from the one before, what it adds is the turn's span, else the template rewrites history. Two
probes, the turn with either of two strange characters as its text, show where inside the span the text stands.
"""

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import turns as T
from .common import cut, read

Turn = tuple[str, str]
#: Turns of a run: rendering all prefixes of a run costs half as many times the run's text.
RUN_ROWS = 16
PROBES = ("\ue000", "\ue001")


@dataclass(frozen=True)
class Template:
    """render: from turns to a string. parse: the turns of such a string, or of the part of one that some turns added.
    unescape: a text as it was from what stands for it. reach: how many turns before it a turn's part depends on, and
    whether it is the first; None if on any number, so that a conversation's turns have to be rendered in one task."""

    render: Callable[[Sequence[Turn]], str]
    parse: Callable[[str], list[Turn]] | None = None
    unescape: Callable[[str], str] = str
    reach: int | None = 1


# Of the strings that mark turns, one in a text or a role gets a backslash after its first character, besides any that it has.
_MARK = re.compile(r"(?<=<)(?=\\*/?s>)|(?<=\[)(?=\\*/?(?:INST|SYS|ROLE)\])")
_ESCAPED = re.compile(r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?(?:INST|SYS|ROLE)\])")


def escape(text: str) -> str:
    return _MARK.sub(r"\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def _inst(turns: Sequence[Turn]) -> str:
    out = ["<s>"] if turns else []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {text} </s>")
    return "".join(out)


def _parse_inst(formatted: str) -> list[Turn]:
    """The turns of _inst's output: no mark occurs in a text, so each turn ends at the first of its own."""
    at, found = 3 if formatted.startswith("<s>") else 0, []
    while at < len(formatted):
        role, end = "assistant", "</s>"
        if formatted.startswith("[INST]", at):
            role, end, at = "user", "[/INST]", at + 6
        elif formatted.startswith("[SYS]", at):
            role, end, at = "system", "[/SYS]", at + 5
        elif formatted.startswith("[ROLE]", at):
            stop = formatted.index("[/ROLE]", at)
            role, at = unescape(formatted[at + 6 : stop]), stop + 7
        stop = formatted.index(end, at)
        found.append((role, unescape(formatted[at + 1 : stop - 1])))
        at = stop + len(end)
    return found


INST = Template(_inst, _parse_inst, unescape)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def spans(template: Template, before: Sequence[Turn], turns: Sequence[Turn], loss_roles: Sequence[str] = ("assistant",)) -> list[dict]:
    """Of each of turns, which follow before: its role, piece, begins, ends, loss, verbatim, rewrites.

    piece is what the turn adds to the output; begins and ends are where its text stands in it, and loss is whether
    that is to be learnt. verbatim: that what stands there is the text, once unescaped. If the output of the turns before isn't a
    prefix of the new one, the template rewrites history: the piece is what follows their common prefix, without a
    place of the text. There is none either where the text isn't between what surrounds the probes.
    """
    found, held = [], list(before)
    old = template.render(held)
    for role, text in turns:
        near = held if template.reach is None else held[-max(template.reach, 1) :]
        base = template.render(near)
        one, two = (template.render([*near, (role, p)]) for p in PROBES)
        held.append((role, text))
        new = template.render(held)
        if not new.startswith(old):
            found.append({"role": role, "piece": new[_shared(old, new) :], "begins": None, "ends": None, "loss": False, "verbatim": False, "rewrites": True})
            old = new
            continue
        piece = new[len(old) :]
        begins = ends = None
        if one.startswith(base) and two.startswith(base):
            one, two = one[len(base) :], two[len(base) :]
            lead = one[: _shared(one, two)]
            tail = one[len(lead) :][::-1]
            tail = tail[: _shared(tail, two[len(lead) :][::-1])][::-1]
            if len(piece) >= len(lead) + len(tail) and piece.startswith(lead) and piece.endswith(tail):
                begins, ends = len(lead), len(piece) - len(tail)
        placed = begins is not None
        found.append({"role": role, "piece": piece, "begins": begins, "ends": ends, "loss": placed and role in loss_roles, "verbatim": placed and template.unescape(piece[begins:ends]) == text, "rewrites": False})
        old = new
    return found


def _context(long: DataFrame, reach: int) -> DataFrame:
    """The runs with before: the last reach rows that stand before each, which are in as many runs before it at most."""
    tails = long.where(~F.col("last")).select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.col("no") + i)).alias("no"), F.struct("no", F.slice("rows", F.greatest(F.size("rows") - reach, F.lit(0)) + 1, reach).alias("rows")).alias("tail"))
    found = tails.groupBy("conv_id", "no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("tail")), lambda t: t["rows"])).alias("rows"))
    found = found.select(F.col("conv_id").alias("__conv"), F.col("no").alias("__no"), F.slice("rows", F.greatest(F.size("rows") - reach, F.lit(0)) + 1, reach).alias("before"))
    return long.join(found, T.same(long["conv_id"], F.col("__conv")) & (long["no"] == F.col("__no")), "left").select(*long.columns, "before")


def rendered(df: DataFrame, template: Template = INST, loss_roles: Sequence[str] = ("assistant",), run_rows: int = RUN_ROWS, **columns: str) -> T.Runs:
    """Runs of each conversation with turns: an array of what spans() gives.

    Each run is rendered in the task that has it, after as many turns as the template reaches back; for a template of
    any reach a conversation's runs pass through one task, and rendering takes time in the square of its turns. columns: names
    of the columns, as in turns(). A null role or text counts as empty, a null turn comes first, and a null conv_id is a conversation of
    its own; turns with the same number all stay. An empty table gives an empty result; further columns are left aside.
    """
    found = T.runs(T.turns(df, **columns), run_rows)
    kind = df.schema[columns.get("conv_col", "conv_id")].dataType.simpleString()
    schema = f"conv_id {kind}, no long, last boolean, turns array<struct<role:string,piece:string,begins:long,ends:long,loss:boolean,verbatim:boolean,rewrites:boolean>>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda rows: [(r["role"] or "", r["text"] or "") for r in rows or ()]
        items = [("role", pa.string()), ("piece", pa.string()), ("begins", pa.int64()), ("ends", pa.int64()), ("loss", pa.bool_()), ("verbatim", pa.bool_()), ("rewrites", pa.bool_())]
        history: list[Turn] = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows = plain(batch.column(3)[i].as_py())
                if batch.num_columns > 4:
                    history = plain(batch.column(4)[i].as_py())
                elif batch.column(1)[i].as_py() == 0:
                    history = []
                made = spans(template, history, rows, loss_roles)
                history = history + rows if template.reach is None else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([made], pa.list_(pa.struct(items)))], names=["conv_id", "no", "last", "turns"])

    if template.reach is None:
        long = found.long.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "no")
    else:
        long = _context(found.long, max(template.reach, 1))
    return T.Runs(found.alone.mapInArrow(step, schema), long.mapInArrow(step, schema))


def turns(df: DataFrame, template: Template = INST, **options) -> DataFrame:
    """A row per turn: conv_id, nth (from 0), role, piece, start and stop (of the piece in its conversation's output), begins and ends (of its text there), loss, verbatim, rewrites.

    The pieces of a conversation in order are its output, unless one of them rewrites: start and stop are null from there on.
    Arguments and special cases as in rendered().
    """
    found = rendered(df, template, **options)
    both = cut(found.alone.unionByName(found.long))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["piece"]))
    before = Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    told = both.where(~((F.col("no") == 0) & F.col("last"))).select("conv_id", "no", F.size("turns").alias("n"), size.alias("size"), F.exists("turns", lambda t: t["rewrites"]).alias("bad"))
    told = told.select(F.col("conv_id").alias("__conv"), F.col("no").alias("__no"), *[F.coalesce(f(c).over(before), z).alias(f"__{c}") for f, c, z in ((F.sum, "n", F.lit(0)), (F.sum, "size", F.lit(0)), (F.max, "bad", F.lit(False)))])
    each = both.join(told, T.same(both["conv_id"], F.col("__conv")) & (both["no"] == F.col("__no")), "left")
    start = F.struct(F.coalesce("__size", F.lit(0)).cast("long").alias("at"), F.coalesce("__bad", F.lit(False)).alias("bad"), F.array().cast("array<struct<at:long,bad:boolean>>").alias("starts"))

    def add(s, t):
        bad = s["bad"] | t["rewrites"]
        return F.struct((s["at"] + F.length(t["piece"])).alias("at"), bad.alias("bad"), F.concat(s["starts"], F.array(F.struct(s["at"].alias("at"), bad.alias("bad")))).alias("starts"))

    placed = F.arrays_zip("turns", F.aggregate("turns", start, add)["starts"].alias("starts"))
    flat = each.select("conv_id", F.coalesce("__n", F.lit(0)).alias("__n"), F.posexplode(placed).alias("i", "e"))
    at = F.when(~F.col("e.starts.bad"), F.col("e.starts.at"))
    return flat.select(
        "conv_id", (F.col("__n") + F.col("i")).cast("long").alias("nth"), "e.turns.role", "e.turns.piece", at.alias("start"), (at + F.length("e.turns.piece")).alias("stop"),
        (at + F.col("e.turns.begins")).alias("begins"), (at + F.col("e.turns.ends")).alias("ends"), "e.turns.loss", "e.turns.verbatim", "e.turns.rewrites",
    )


def digests(found: T.Runs, template: Template, kind: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the outputs say when they are read back.

    A conversation's runs pass one after the other, and only the digests are kept of them.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        n = chars = size = 0
        read, learnt = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    n = chars = size = 0
                    read, learnt = hashlib.sha256(), hashlib.sha256()
                held = batch.column(3)[i].as_py()
                output = "".join(t["piece"] for t in held)
                size += len(output)
                for role, text in template.parse(output):
                    n += 1
                    read.update(f"{role}\n{text}\n".encode())
                for t in held:
                    if t["loss"]:
                        text = template.unescape(t["piece"][t["begins"] : t["ends"]])
                        chars += len(text)
                        learnt.update(text.encode())
                if batch.column(2)[i].as_py():
                    values = [n, read.hexdigest(), chars, learnt.hexdigest(), size]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v]) for v in values)], names=names)

    return T.in_order(found, step, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CASE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CASE), (-7, 1, "assistant", CASE)], "conv_id long, turn long, role string, text string")
    df = df.union(more.select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns]))
    return digests(rendered(df, INST), INST, df.schema["conv_id"].dataType.simpleString())


_ESCAPE = r"regexp_replace(regexp_replace({0}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(?:INST|SYS|ROLE)\])', '[\\\1', 'g')"
SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{CASE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_ESCAPE.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 13
    ELSE 19 + length({_ESCAPE.format("role")}) END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
