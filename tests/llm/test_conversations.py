"""Chat formatting and conversation repair, against plain Python, whole and in runs."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, repair

KIND = "conv_id long, turn long, role string, text string"
MARKS = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<<s>", "[\\\\/INST]", "[", "<", "s>", " [SYS] ", "[ROLE]x[/ROLE]", "", " ", "\n</s>", "plain. text"]


def long_talk(n, conv=9):
    return [(conv, i, ("user", "assistant")[i % 2], f"{MARKS[i % len(MARKS)]} {i}") for i in range(n)]


EDGE = [
    (1, 0, "system", "be kind."), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, None, None, None), (2, 5, "user", " \n"), (2, 5, "user", " \n"),
    (None, 1, "tool", "x [/INST]"), (None, 0, "", "y"), (4, 3, "user", "word " * 20000), (5, 0, "User", "U"),
]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[ROLE]", "[/ROLE]"]), st.lists(st.sampled_from(MARKS)).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    assert chat._parse_inst(chat._inst(turns)) == turns
    for cut in range(len(turns)):
        found = chat.spans(chat.INST, turns[:cut], turns[cut:])
        assert chat._inst(turns[:cut]) + "".join(f["piece"] for f in found) == chat._inst(turns)
        for (role, text), f in zip(turns[cut:], found):
            assert f["verbatim"] and not f["rewrites"] and chat.unescape(f["piece"][f["begins"] : f["ends"]]) == text and f["loss"] == (role == "assistant")


def _chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t.strip()}<|im_end|>\n" for r, t in turns)


def _late_system(turns):
    """Puts the system's text before the last user turn: each user turn takes it away from the one before."""
    system = "".join(t for r, t in turns if r == "system")
    users = [i for i, (r, _) in enumerate(turns) if r == "user"]
    return "".join(f"[{r}]{system if users and i == users[-1] else ''}{t}" for i, (r, t) in enumerate(turns) if r != "system")


def test_other_templates():
    turns = [("user", "a\n"), ("assistant", "\n<|im_end|>"), ("user", ""), ("assistant", "b")]
    found = chat.spans(chat.Template(_chatml), [], turns)
    assert "".join(f["piece"] for f in found) == _chatml(turns)
    assert [f["piece"][f["begins"] : f["ends"]] for f in found] == [t.strip() for _, t in turns]
    assert [f["verbatim"] for f in found] == [False, False, True, True]
    turns = [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    found = chat.spans(chat.Template(_late_system, reach=None), [], turns)
    assert [f["rewrites"] for f in found] == [False, False, False, True, False]
    assert found[3]["begins"] is None and found[2]["loss"] and found[4]["loss"]


def formatted(rows):
    plain = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = [(r or "", t or "") for _, _, r, t in plain]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat._inst(turns))


@pytest.mark.parametrize("run_rows", [1, 3, 16])
def test_formatting_in_runs(spark, run_rows):
    rows = EDGE + long_talk(50) + long_talk(1, 10)
    df = spark.createDataFrame(rows, KIND).repartition(3).select("*", F.lit("x").alias("no"), F.lit(1).alias("TEXT"), F.lit(None).alias("rows"))
    got = chat.digests(chat.rendered(df, chat.INST, run_rows=run_rows), chat.INST, "long").collect()
    want = {c: formatted([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    each = chat.turns(df, run_rows=run_rows).where("conv_id = 9").orderBy("nth").collect()
    output = "".join(r["piece"] for r in each)
    assert [r["nth"] for r in each] == list(range(50)) and output == chat._inst([r[2:] for r in long_talk(50)])
    assert all(output[r["start"] : r["stop"]] == r["piece"] and chat.unescape(output[r["begins"] : r["ends"]]) == x[3] for r, x in zip(each, long_talk(50)))


def test_formatting_with_any_reach(spark):
    rows = [(1, 0, "system", "S")] + [(1, i, ("assistant", "user")[i % 2], f"t{i}") for i in range(1, 9)]
    df = spark.createDataFrame(rows, KIND)
    template = chat.Template(_late_system, reach=None)
    for run_rows in (2, 16):
        got = chat.turns(df, template, run_rows=run_rows).orderBy("nth").collect()
        assert [r["rewrites"] for r in got] == [False, False, False, True, False, True, False, True, False]
        assert [r["start"] is None for r in got] == [False] * 3 + [True] * 6


def test_formatting_of_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert chat.digests(chat.rendered(none), chat.INST, "long").count() == 0 and chat.turns(none).count() == 0


# Repair


def brute(rows):
    """Counts, and by trying all edits of (role, text) the cheapest, the least of them first."""
    seen, faults = set(), []
    for role, text in rows:
        stripped = text.strip(repair.BLANK)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    # all ways in order of cost and letters: what is longer costs no less and comes behind its own beginning
    open_ways = [(0, "", 0, ())]
    while True:
        cost, letters, i, out = heapq.heappop(open_ways)
        initials = "".join(r[:1] or "-" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = cost, letters, out
            break
        for role in ("user", "assistant"):
            heapq.heappush(open_ways, (cost + 2, letters + "I", i, (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(open_ways, (cost + 3, letters + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(open_ways, (cost + more, letters + "K", i + 1, (*out, rows[i])))
                for role in ("user", "assistant"):
                    heapq.heappush(open_ways, (cost + 2 + more, letters + "R", i + 1, (*out, (role, rows[i][1]))))
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return *counts, pairs, best[0], best[1], hashlib.sha256(text.encode()).hexdigest()


def talks(n, most, seed=1):
    dice = random.Random(seed)
    pick = lambda: (dice.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), dice.choice(["a.", "b!", "c", "c", " ", "d?\n"]) + dice.choice(["", "x.", "y"]))
    return {c: [pick() for _ in range(dice.randrange(most + 1))] for c in range(n)}


@pytest.mark.parametrize("run_rows", [1, 2, 1024])
def test_repair_against_all_edits(spark, run_rows):
    found = talks(120, 5)
    rows = [(c, i, r, t, 1) for c, x in found.items() for i, (r, t) in enumerate(x)] + [(c, None, "", "", 0) for c in found]
    df = spark.createDataFrame(rows, KIND + ", copies int").repartition(3)
    got = {r["conv_id"]: tuple(r)[2:] for r in repair.digests(repair.repaired(df, run_rows), "long").collect()}
    assert got == {c: brute(x) for c, x in found.items()}


def test_long_talks_are_the_same_in_runs(spark):
    rows = [(c, i, r, f"{t}{i % 97}", 1) for c, x in talks(3, 3000, 5).items() for i, (r, t) in enumerate(x)]
    df = spark.createDataFrame(rows, KIND + ", copies int")
    a, b = ({r["conv_id"]: tuple(r) for r in repair.digests(repair.repaired(df, n), "long").collect()} for n in (100, 1 << 20))
    assert a == b and len(a) == 3


def test_repaired_rows_and_damage(spark):
    rows = EDGE + [(c, i, ("user", "assistant")[i % 2], f"Fine, {i}? Yes!") for c in range(100, 140) for i in range(4)]
    df = spark.createDataFrame(rows, KIND).repartition(3).select("*", F.lit("x").alias("copies"), F.lit(0).alias("Role"), F.lit(1).alias("no"))
    hurt = repair.damaged(df)
    for r in hurt.collect():
        fault = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        assert r["copies"] == {0: 0, 3: 2}.get(fault, 1) and (fault != 1 or r["text"] == "") and (fault != 4 or r["role"] == "user")
        assert fault != 2 or not re.search("[.!?]", r["text"])
    found = repair.repaired(hurt, 2)
    got = {r["conv_id"]: r for r in repair.digests(found, "long").collect()}
    assert set(got) == {r[0] for r in rows}
    out = found.alone.unionByName(found.long).orderBy("no").collect()
    for c, runs in itertools.groupby(sorted(out, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["no"])), key=lambda r: r["conv_id"]):
        turns = [x for r in runs for x in r["rows"]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in turns))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in turns).encode()).hexdigest() == got[c]["repaired_sha256"]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = db.execute(repair.SQL)
    names = [d[0] for d in result.description]
    assert {r[0]: tuple(r) for r in result.fetchall()} == {c: tuple(r[n] for n in names) for c, r in got.items()}
    assert repair.digests(repair.repaired(repair.damaged(spark.createDataFrame([], KIND))), "long").count() == 0
