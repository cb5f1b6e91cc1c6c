"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Each row is kept, gets another role, or is deleted, and turns without text are inserted, until the roles' initials read
(s?(ua)+)?. Positions between rows and the four states of that pattern are the nodes of a directed graph without cycles, edits are its arcs.
Least costs forward and backward tell which arcs are on a cheapest path (the tight ones); a walk over sets of nodes then takes the least letter that a tight
arc has, step by step. All nodes of a set have the same edits behind them, so they stand at the same row.

Long conversations are cut into runs. Costs through a run are a 4 x 4 matrix, what the walk does in it a map from
sets of states to sets, and both are joined up from one small row a run.
"""

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import turns as T
from .common import cut, read

BLANK = " \t\n\x0b\x0c\r"
INFINITE = 1 << 60
LARGEST = (1 << 63) - 1
#: States: nothing yet, after a system turn, after a user's, after an assistant's. By initial, where a turn leads.
LEADS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
DONE = (0, 3)
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
INSERTS = LEADS["u"] + LEADS["a"]
#: A row's code: its initial (0 for none of s, u, a), plus these.
INITIALS = " sua"
MUST_GO, TRUNCATED = 4, 8


def _arcs(code: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """By letter, in order, the arcs (state before, state after, cost) over a row with this code."""
    found = [("D", [(q, q, DELETE) for q in range(4)])]
    if not code & MUST_GO:
        more = CUT_OFF * bool(code & TRUNCATED)
        found.append(("K", [(p, q, more) for p, q in LEADS.get(INITIALS[code & 3], ())]))
        found.append(("R", [(p, q, REROLE + more) for p, q in INSERTS]))
    return found


ARCS = [_arcs(code) for code in range(16)]
FLAT = [[arc for _, arcs in letters for arc in arcs] for letters in ARCS]


def _settle(costs: list[int], forward: bool) -> list[int]:
    """costs with inserted turns: two in a row at most are of use."""
    for _ in range(2):
        for p, q in INSERTS:
            if forward:
                costs[q] = min(costs[q], costs[p] + INSERT)
            else:
                costs[p] = min(costs[p], costs[q] + INSERT)
    return costs


#: Costs from each state at the end.
AT_END = _settle([0 if q in DONE else INFINITE for q in range(4)], False)
AT_START = [0, INFINITE, INFINITE, INFINITE]


def forward(codes: Sequence[int], start: Sequence[int]) -> list[list[int]]:
    """Least cost of each state before each row and after the last, inserts there included."""
    costs = [_settle(list(start), True)]
    for code in codes:
        now, new = costs[-1], [INFINITE] * 4
        for p, q, c in FLAT[code]:
            new[q] = min(new[q], now[p] + c)
        costs.append(_settle(new, True))
    return costs


def backward(codes: Sequence[int], end: Sequence[int]) -> list[list[int]]:
    """Least cost from each state before each row and after the last to the end, inserts there included."""
    costs = [list(end)]
    for code in reversed(codes):
        now, new = costs[-1], [INFINITE] * 4
        for p, q, c in FLAT[code]:
            new[p] = min(new[p], now[q] + c)
        costs.append(_settle(new, False))
    return costs[::-1]


def walk(codes: Sequence[int], ahead: list[list[int]], behind: list[list[int]], total: int, states: int, last: bool) -> tuple[str, int]:
    """(edits' letters, states after the run) of the walk that enters the run with a set of states, given as bits."""
    out, i = [], 0
    now = {q for q in range(4) if states >> q & 1 and ahead[0][q] + behind[0][q] == total}
    while now:
        if i == len(codes) and (not last or any(q in DONE and ahead[i][q] == total for q in now)):
            break
        steps = [(letter, arcs, 1) for letter, arcs in ARCS[codes[i]]] if i < len(codes) else []
        steps.append(("I", [(p, q, INSERT) for p, q in INSERTS], 0))
        for letter, arcs, by in sorted(steps, key=lambda s: s[0]):
            new = {q for p, q, c in arcs if p in now and ahead[i][p] + c + behind[i + by][q] == total}
            if new:
                out.append(letter)
                now, i = new, i + by
                break
    return "".join(out), sum(1 << q for q in now)


def _key(role: str, text: str) -> str:
    return hashlib.sha1(f"{len(role)}:{role}{text}".encode()).hexdigest()


STATS = ("n", "blank", "duplicate", "truncated", "illegal", "low", "high", "distinct")


def examine(rows: Sequence[dict], seen: Sequence[str] = ()) -> tuple[list[dict], bytes, dict]:
    """The rows that a run has (repeats written out), their codes, and what there is to tell of it. seen: keys of rows that earlier runs have."""
    out = [r for r in rows for _ in range(r["copies"])]
    known, codes = set(seen), bytearray()
    told = dict.fromkeys(STATS, 0) | {"n": len(out), "low": None, "high": None, "first": None, "final": None}
    before = None
    for r in out:
        role, text = r["role"], r["text"]
        visible = text.rstrip(BLANK)
        code = max(INITIALS.find(role[:1]), 0) if role else 0
        if not visible:
            code |= MUST_GO
            told["blank"] += 1
        elif (key := _key(role, text)) in known:
            code |= MUST_GO
            told["duplicate"] += 1
        else:
            known.add(key)
            if visible[-1] not in ".!?":
                code |= TRUNCATED
                told["truncated"] += 1
        codes.append(code)
        if before is not None and before[:1] + role[:1] not in ("su", "ua", "au"):
            told["illegal"] += 1
        before = role
        if r["turn"] is not None:
            told["distinct"] += r["turn"] != told["high"]
            told["low"], told["high"] = r["turn"] if told["low"] is None else told["low"], r["turn"]
    if out:
        told["first"], told["final"] = out[0]["role"][:1], out[-1]["role"][:1]
    return out, bytes(codes), told


def edited(rows: Sequence[dict], letters: str, nth: int, odd: bool) -> list[dict]:
    """The rows after the edits. nth: how many come before them; odd: whether the repaired conversation begins with a system turn."""
    out, at = [], iter(rows)
    for letter in letters:
        row = next(at) if letter != "I" else {"role": None, "text": ""}
        if letter != "D":
            role = row["role"] if letter == "K" else ("user", "assistant")[(nth - odd) % 2]
            out.append({"role": role, "text": row["text"]})
            nth += 1
    return out


def _odd(letters: str, codes: bytes) -> bool | None:
    """Whether the first row that stays in is a system turn; None if none stays."""
    i = 0
    for letter in letters:
        if letter != "D":
            return letter == "K" and INITIALS[codes[i] & 3] == "s"
        i += 1
    return None


_TOLD = "struct<n:long,blank:long,duplicate:long,truncated:long,illegal:long,low:long,high:long,distinct:long,first:string,final:string>"
_ARROW_TOLD = pa.struct([(k, pa.string() if k in ("first", "final") else pa.int64()) for k in (*STATS, "first", "final")])
_ARROW_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_EDITED = "cost long, letters string, rows array<struct<role:string,text:string>>"


def _mapped(df: DataFrame, keep: int, make, schema: str, kinds: Sequence[pa.DataType]) -> DataFrame:
    """The first keep columns as they are, and those that make gives for the values of a row's others."""
    names = [part.split(":")[0].strip().split(" ")[0] for part in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = make(*(batch.column(k)[i].as_py() for k in range(keep, batch.num_columns)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(keep)), *(pa.array([v], t) for v, t in zip(made, kinds))], names=names)

    return df.mapInArrow(step, schema)


def _on_run(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by run; conv_id and no once."""
    named = right.withColumnsRenamed({"conv_id": "__conv", "no": "__no"})
    return left.join(named, T.same(left["conv_id"], F.col("__conv")) & (left["no"] == F.col("__no")), how).drop("__conv", "__no")


def _seen(long: DataFrame) -> DataFrame:
    """conv_id, no, seen: the keys that a run shares with earlier runs of its conversation. A run tells of each of its keys once."""
    present = F.filter("rows", lambda r: (r["copies"] > 0) & r["text"].rlike(r"[^\x20\x09-\x0D]"))
    key = lambda r: F.sha1(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]).cast("binary"))
    keys = cut(long.select("conv_id", "no", F.explode(F.array_distinct(F.transform(present, key))).alias("key")))
    first = keys.groupBy("conv_id", "key").agg(F.min("no").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "first")
    later = keys.join(first, T.same(keys["conv_id"], F.col("__conv")) & (keys["key"] == F.col("__key"))).where("no > first")
    return later.groupBy("conv_id", "no").agg(F.collect_list("key").alias("seen"))


def _long(long: DataFrame, kind: str) -> DataFrame:
    """What repaired() gives of the runs of conversations that have several. Texts are read for their codes, and once more to be edited."""
    run = f"conv_id {kind}, no long, last boolean"
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def matrices(rows, seen):
        _, codes, told = examine(rows, seen or ())
        units = ([0 if p == q else INFINITE for q in range(4)] for p in range(4))
        return codes, [c for unit in units for c in forward(codes, unit)[-1]], told

    coded = cut(_mapped(_on_run(long, _seen(long), "left"), 3, matrices, f"{run}, codes binary, costs array<long>, told {_TOLD}", [pa.binary(), longs, _ARROW_TOLD]))

    def bounds(frame: pd.DataFrame) -> pd.DataFrame:
        """Of each run, a row with the costs at its start and its end."""
        frame = frame.sort_values("no")
        times = lambda a, b: [min(INFINITE, min(a[k] + b[k][q] for k in range(4))) for q in range(4)]
        tables = [[list(m[4 * p : 4 * p + 4]) for p in range(4)] for m in frame["costs"]]
        starts, ends = [AT_START], [AT_END]
        for table in tables[:-1]:
            starts.append(times(starts[-1], table))
        for table in reversed(tables):
            ends.append([min(INFINITE, min(table[p][k] + ends[-1][k] for k in range(4))) for p in range(4)])
        return pd.DataFrame({"conv_id": frame["conv_id"], "no": frame["no"], "ahead": starts, "behind": ends[-2::-1], "total": ends[-1][0]})

    held = coded.select("conv_id", "no", "costs").groupBy("conv_id").applyInPandas(bounds, f"conv_id {kind}, no long, ahead array<long>, behind array<long>, total long")
    placed = cut(_on_run(coded.select("conv_id", "no", "last", "codes"), held))

    def through(last, codes, ahead, behind, total):
        f, g = forward(codes, ahead), backward(codes, behind)
        return ([walk(codes, f, g, total, states, last)[1] for states in range(16)],)

    def enter(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        states = [1]
        for led in frame["led"]:
            states.append(int(led[states[-1]]))
        return pd.DataFrame({"conv_id": frame["conv_id"], "no": frame["no"], "states": states[:-1]})

    sets = _mapped(placed, 2, through, f"conv_id {kind}, no long, led array<int>", [ints]).groupBy("conv_id").applyInPandas(enter, f"conv_id {kind}, no long, states int")

    def spell(last, codes, ahead, behind, total, states):
        letters, _ = walk(codes, forward(codes, ahead), backward(codes, behind), total, states, last)
        return letters, len(letters) - letters.count("D"), _odd(letters, codes), total

    spelt = _mapped(_on_run(placed, sets), 2, spell, f"conv_id {kind}, no long, letters string, n_out long, odd boolean, cost long", [pa.string(), pa.int64(), pa.bool_(), pa.int64()])
    over = Window.partitionBy("conv_id").orderBy("no")
    spelt = spelt.select("conv_id", "no", "cost", "letters", F.coalesce(F.sum("n_out").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("nth"),
                         F.coalesce(F.first("odd", True).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False)).alias("odd"))
    joined = _on_run(_on_run(long, spelt), coded.select("conv_id", "no", "told"))
    joined = joined.select("conv_id", "no", "last", "told", "cost", "letters", "rows", "nth", "odd")

    def finish(letters, rows, nth, odd):
        return letters, edited([r for r in rows for _ in range(r["copies"])], letters, nth, odd)

    return _mapped(joined, 5, finish, f"{run}, told {_TOLD}, {_EDITED}", [pa.string(), _ARROW_ROWS])


def repaired(rows: DataFrame, run_rows: int = T.RUN_ROWS) -> T.Runs:
    """Runs of each conversation with told (counts), cost, letters (of the edits, in order) and rows (role, text: the repaired turns).

    rows has conv_id, turn, role, text (neither null) and copies, as turns.runs() takes them; a row with 0 copies tells of its
    conversation only. A conversation without rows costs nothing. Rows of one turn go by role and text; null turns
    come first; a null conv_id is a conversation of its own; roles may be any strings, empty ones too; an empty table gives an empty result.
    """
    found = T.runs(rows, run_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def of_whole(rows):
        out, codes, told = examine(rows)
        f, g = forward(codes, AT_START), backward(codes, AT_END)
        total = min(g[0][0], INFINITE)
        letters, _ = walk(codes, f, g, total, 1, True)
        return told, total, letters, edited(out, letters, 0, bool(_odd(letters, codes)))

    schema = f"conv_id {kind}, no long, last boolean, told {_TOLD}, {_EDITED}"
    return T.Runs(_mapped(found.alone, 3, of_whole, schema, [_ARROW_TOLD, pa.int64(), pa.string(), _ARROW_ROWS]), _long(found.long, kind))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults, by the CRC-32 of conversation and turn; nulls count as one space. Dropped rows have 0 copies, repeated ones 2."""
    rows = T.turns(df, conv_col, turn_col, role_col, text_col)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("int")
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def digests(found: T.Runs, kind: str) -> DataFrame:
    """A row per conversation: counts, cost, audit, and the digest of what was repaired. The runs pass in order; of their texts nothing is kept."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    sums, letters, sha, any_row = dict.fromkeys(STATS, 0), [], hashlib.sha256(), False
                    low = high = final = None
                told = batch.column(3)[i].as_py()
                for k in ("n", "blank", "duplicate", "truncated", "illegal", "distinct"):
                    sums[k] += told[k]
                if told["n"]:
                    sums["illegal"] += final is not None and final + told["first"] not in ("su", "ua", "au")
                    final = told["final"]
                if told["low"] is not None:
                    sums["distinct"] -= told["low"] == high
                    low, high = told["low"] if low is None else low, told["high"]
                letters.append(batch.column(5)[i].as_py())
                for r in batch.column(6)[i].as_py():
                    sha.update(("\n" * any_row + f"{r['role']}:{r['text']}").encode())
                    any_row = True
                if batch.column(2)[i].as_py():
                    gaps = 0 if low is None else min(high - low + 1 - sums["distinct"], LARGEST)
                    values = [gaps, *(sums[k] for k in ("blank", "duplicate", "truncated", "illegal")), batch.column(4)[i].as_py(), "".join(letters), sha.hexdigest()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values)], names=names)

    return T.in_order(found, step, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    return digests(repaired(damaged(df)), df.schema["conv_id"].dataType.simpleString())


_CRC = """4294967295 - list_reduce(list_transform(string_split(k, ''), lambda ch: ord(ch)), lambda c, b:
  list_reduce(range(8), lambda d, i: xor(d >> 1, (d & 1) * 3988292384), xor(c, b::BIGINT)), 4294967295::BIGINT)"""


def _sql() -> str:
    """A plainer way to the same rows: of each state the cheapest edits so far, the ASCII-least of equally cheap ones, row by row."""
    best = lambda *options: f"list_min([{', '.join(options)}])"
    add = lambda state, cost, letter: f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}'}}"
    # Inserts in front of a row, then the row.
    user = lambda f: best(f"{f}[3]", add(f"{f}[1]", 2, "I"), add(f"{f}[2]", 2, "I"), add(f"{f}[4]", 2, "I"))
    settled = lambda f: f"list_transform([{{'f': {f}, 'u': {user(f)}}}], lambda z: [z.f[1], z.f[2], z.u, {best('z.f[4]', add('z.u', 2, 'I'))}])[1]"
    none = "{'c': 1000000000::BIGINT, 'e': ''}"

    def turn(kind: str, *sources: int) -> list[str]:
        out = []
        for p in sources:
            if kind != "s":
                out.append(f"if(r.go, {none}, {add(f'g[{p}]', '2 + r.cut', 'R')})")
            out.append(f"if(r.go OR r.k <> '{kind}', {none}, {add(f'g[{p}]', 'r.cut', 'K')})")
        return out

    gone = lambda p: add(f"g[{p}]", 3, "D")
    step = f"[{gone(1)}, {best(gone(2), *turn('s', 1))}, {best(gone(3), *turn('u', 1, 2, 4))}, {best(gone(4), *turn('a', 3))}]"
    return f"""WITH named AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
faulty AS (SELECT conv_id, turn, role, text, ({_CRC}) % 20 AS f FROM named),
hurt AS (SELECT conv_id, turn, if(f = 4, 'user', role) AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM faulty),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM hurt),
judged AS (SELECT *, left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'k': k, 'go': coalesce(fault IN ('blank', 'duplicate'), false), 'cut': if(fault = 'truncated', 1, 0)}} ORDER BY i) AS rs FROM judged GROUP BY conv_id),
paths AS (SELECT conv_id, list_reduce(rs, lambda f, r: list_transform([{settled("f")}], lambda g: {step})[1],
  [{{'c': 0::BIGINT, 'e': ''}}, {none}, {none}, {none}]) AS f FROM counted),
cheapest AS (SELECT conv_id, list_transform([{settled("f")}], lambda g: {best("g[1]", "g[4]")})[1] AS p FROM paths),
letters AS (SELECT conv_id, unnest(string_split(p.e, '')) AS e, unnest(range(length(p.e))) AS n FROM cheapest WHERE p.e <> ''),
spelt AS (SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
joined AS (SELECT s.conv_id, s.n, s.e, s.o, j.role, if(s.e = 'I', '', j.text) AS text,
  max((s.o = 1 AND s.e = 'K' AND j.k = 's')::INT) OVER (PARTITION BY s.conv_id) AS odd FROM spelt s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i AND s.e <> 'I'),
joined_text AS (SELECT conv_id, string_agg(if(e = 'K', role, if((o - 1 - odd) % 2 = 0, 'user', 'assistant')) || ':' || coalesce(text, ''), chr(10) ORDER BY n) FILTER (e <> 'D') AS t FROM joined GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(p.p.c, 0)::BIGINT AS cost, coalesce(p.p.e, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN cheapest p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined_text t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""


SQL = _sql()
