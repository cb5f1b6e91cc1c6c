"""Repeats of at least a threshold of bytes, by interval expansion on a Burrows-Wheeler transform.

A corpus has no one suffix array here: its positions are dealt out by minimizers first. The minimizer of a string of
LENGTH bytes is the smallest hash of its GRAM-byte substrings, so equal strings have equal minimizers, and consecutive
positions of a text mostly share theirs. Such a run of positions is a piece of text (all its strings, overlapped), and
equal strings always lie in pieces with the same minimizer.

1. Texts are dealt into groups of about GROUP_BYTES, by row. Groups learn by two hops (see exchange) which of their
   minimizers another text has too. Most have none, and their text stays where it is.
2. Groups send the pieces of the others, each distinct piece once, with its smallest document id. A bucket joins the
   equal ones; the distinct pieces that share a minimizer become one text, whose suffixes are grouped by their first
   LENGTH bytes: see equal_strings(). Each piece is answered by the smallest id of each of its strings.
3. Groups mark the strings that a smaller document has, and remove what they cover.

All of it moves fewer bytes than the texts have, and no step gathers more than a group, or what shares a minimizer. A
minimizer of which groups would send more than HOT_BYTES of distinct pieces (say, of a line in every third document,
with as many contexts) is not gathered: its pieces are cut into single strings, which are dealt out by their own hashes,
in two hops as well: equal strings of a supergroup are one before they go to a bucket, so a string that all groups have
makes no hot bucket either.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import prepare, read, settled
from .exchange import pack, table, unpack

LENGTH, GRAM = 50, 24
#: Bytes of a group's texts; bytes of one minimizer's pieces that a task reads at most.
GROUP_BYTES, HOT_BYTES = 4 << 20, 4 << 20
#: Bytes of text that are hashed at once, and symbols of one transform.
_STRETCH, _TEXT = 1 << 17, 1 << 18
#: Rows up to which an interval is expanded row by row.
_NARROW = 16
NO_ID = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)


# Interval expansion


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations of symbols (small ints) in the order of their first depth symbols, or more, and the transform: the symbols before them."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    done = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(done):
        key = key << bits | np.roll(symbols, -k)
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if done >= depth or rank[order[-1]] == n - 1:
            return order, symbols[order - 1]
        key = rank * n + np.roll(rank, -done)
        done *= 2


def prefixes(last: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """True at each row of the transform last (symbols below sigma) that shares fewer than depth symbols with the row before.

    Breadth first: from the interval of all rows, the interval of a string w gives those of cw for each symbol c. Where
    an interval of length l ends at a row that has no value yet, the rows there share l - 1 symbols; so values come in
    ascending order, and an interval whose end has its value is not expanded. At depth the expansion stops.
    """
    n = len(last)
    blocks = n // 64 + 1
    place = np.arange(n)
    cell, bit = (place >> 6) * sigma + last, place & 63
    halves = [np.bincount(cell, np.where(bit >> 5 == k, 2.0 ** (bit & 31), 0.0), blocks * sigma).astype(np.uint64) for k in (0, 1)]
    bits = (halves[0] | halves[1] << np.uint64(32)).reshape(blocks, sigma)
    before = np.zeros((blocks, sigma), np.int64)
    np.cumsum(np.bitwise_count(bits[:-1]), axis=0, dtype=np.int64, out=before[1:])
    sizes = np.bincount(last, minlength=sigma)
    before += np.cumsum(sizes) - sizes
    back = np.empty(n, np.int64)  # of a row: the row that begins with its symbol before
    back[np.argsort(last, kind="stable")] = place

    def step(rows: np.ndarray) -> np.ndarray:
        """For each row and symbol: where the rows before it that follow the symbol end, in order."""
        b = rows >> 6
        return before[b] + np.bitwise_count(bits[b] & ((np.uint64(1) << (rows & 63).astype(np.uint64)) - np.uint64(1))[:, None])

    def wide(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = step(low), step(high)
        there = b > a
        return a[there], b[there]

    def narrow(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by rows: those of an interval with one symbol before them have neighbouring rows."""
        rows = _ranges(low, high - low)
        owner, to = np.repeat(np.arange(len(low)), high - low), back[rows]
        order = np.argsort(owner * n + to)
        owner, to, symbol = owner[order], to[order], last[rows[order]]
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        return to[edge], to[np.concatenate([edge[1:], [len(to)]]) - 1] + 1

    def single(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return back[low], back[low] + 1

    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        width, found = high - low, []
        for kind, at in ((single, width == 1), (narrow, (width > 1) & (width <= _NARROW)), (wide, width > _NARROW)):
            some = np.flatnonzero(at)
            for k in range(0, len(some), 4096 if kind is wide else max(1, len(some))):
                a, b = kind(low[some[k : k + 4096]], high[some[k : k + 4096]]) if kind is wide else kind(low[some], high[some])
                new = ~known[b]
                found.append((a[new], b[new]))
        low, high = (np.concatenate(x) for x in zip(*found))
        if not len(low):
            break
        known[high] = True
    return known[:n]


def equal_strings(pieces: list[bytes], length: int) -> np.ndarray:
    """A class for each string of length bytes in each piece, in order: equal strings have equal classes, all numbered from 0."""
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    raw += 1
    raw[ends] = 0
    present = np.flatnonzero(np.bincount(raw, minlength=257))
    code = np.zeros(257, np.int64)
    code[present] = np.arange(len(present))
    symbols = code[raw]
    order, last = transform(symbols, length)
    classes = np.empty(len(symbols), np.int64)
    classes[order] = np.cumsum(prefixes(last, len(present), length)) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return classes[_ranges(starts, sizes - length + 1)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


# Minimizers


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of size bytes: polynomials, built by doubling, then mixed."""
    n = len(data) - size + 1
    power, part, have, out, used = _MUL, data.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & have:
                out = part[used : used + n].copy() if out is None else out * power + part[used : used + n]
                used += have
            if used == size:
                break
            part = part[:-have] * power + part[have:]
            power, have = power * power, have * 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    n = len(values) - width + 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n]) if have < width else values


class Runs:
    """The runs of positions with one minimizer, in the texts of a group: value, row, start in data, count."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.data = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        whole = np.frombuffer(self.data, np.uint8)
        found: list[tuple] = []
        stop = len(whole) - length + 1
        limit = np.repeat(self.begins + self.sizes - length, self.sizes)  # the last start of each byte's text
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        for k in range(0, stop, _STRETCH):
            top = min(k + _STRETCH, stop)
            value = _smallest(_grams(whole[k : top + length - 1], gram), length - gram + 1)
            place = np.flatnonzero(np.arange(k, top) <= limit[k:top])
            if not len(place):
                continue
            value, row = value[place], owner[k:top][place]
            new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]))
            found.append((value[new], row[new], place[new] + k, np.diff(np.concatenate([new, [len(place)]]))))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.int64)]
        # A run that goes on over a stretch's end is one run: its pieces must not depend on the order of the texts
        value, row, start, count = columns
        ends = start + count
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (start[1:] != ends[:-1])])) if len(value) else np.zeros(0, np.int64)
        self.value, self.row, self.start = value[new], row[new], start[new]
        self.count = np.add.reduceat(count, new) if len(new) else count
        order = np.argsort(self.value, kind="stable")
        ranked = self.value[order]
        edge = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        self.distinct = ranked[edge]
        self.number = np.empty(len(order), np.int64)  # of the run's minimizer among the distinct ones
        self.number[order] = np.cumsum(edge) - 1
        at = np.flatnonzero(edge)
        rows = self.row[order]
        ends = np.concatenate([at[1:], [len(rows)]]).astype(np.int64) - 1
        self.shared = rows[at] != rows[ends] if len(at) else np.zeros(0, bool)  # by two rows of the group
        self.times = ends - at + 1  # runs of each distinct minimizer

    def pieces(self, length: int) -> np.ndarray:
        """How many distinct pieces each distinct minimizer has here, by hashes of their first and last strings."""
        some = np.flatnonzero(self.times[self.number] > 1)
        if not len(some):
            return self.times
        power = np.ones(length, np.uint64)
        strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.data, np.uint8), length)
        marks = np.empty(len(some), np.uint64)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(length - 1, _MUL), out=power[1:])
            for k in range(0, len(some), 1 << 15):
                at = some[k : k + (1 << 15)]
                first, last = ((strings[x].astype(np.uint64) * power).sum(1, dtype=np.uint64) for x in (self.start[at], self.start[at] + self.count[at] - 1))
                marks[k : k + len(at)] = first * _MUL + last + self.count[at].astype(np.uint64)
        return np.maximum(exchange.distinct_counts(self.number[some], marks, len(self.times)), 1)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of it in order) for each bucket there is."""
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else []
    for a, b in zip(edges, [*edges[1:], len(ranked)]):
        yield int(ranked[a]), order[a:b]


class Pieces:
    """What a group sends, in an order that depends on the texts' bytes alone, and where it occurs: pieces, and single strings of hot minimizers.

    flags: by minimizer of runs.distinct, whether another text has it, and whether it is hot.
    """

    def __init__(self, runs: Runs, flags: np.ndarray, ids: np.ndarray, length: int, plan: exchange.Plan):
        kind = flags[runs.number]
        plain, hot = np.flatnonzero(kind == exchange.SHARED), np.flatnonzero(kind >= exchange.HOT)
        data, extra = runs.data, length - 1
        self.start, self.count, self.row = runs.start[plain], runs.count[plain], runs.row[plain]
        self.texts, self.number, self.least = self._distinct([data[a : a + n + extra] for a, n in zip(self.start.tolist(), self.count.tolist())], ids[self.row])
        self.keys = np.zeros(len(self.texts), np.uint64)
        self.keys[self.number] = runs.value[plain]
        self.bucket = plan.bucket(plan.cut(self.keys))
        self.at = _ranges(runs.start[hot], runs.count[hot])
        self.owner = np.repeat(runs.row[hot], runs.count[hot])
        self.strings, self.which, self.lowest = self._distinct([data[a : a + length] for a in self.at.tolist()], ids[self.owner])
        own = _grams(np.frombuffer(b"".join(self.strings), np.uint8), length)[::length] if self.strings else np.zeros(0, np.uint64)
        self.home = plan.bucket(plan.cut(own)) // plan.fan  # the range of a string's bucket

    @staticmethod
    def _distinct(texts: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct texts in order, the number of each text among them, the smallest id of each)."""
        found = sorted(set(texts))
        number = dict(zip(found, range(len(found))))
        numbers = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
        least = np.full(len(found), NO_ID)
        np.minimum.at(least, numbers, ids)
        return found, numbers, least


def _strings(data: bytes, length: int) -> list[bytes]:
    return [data[k : k + length] for k in range(0, len(data), length)]


def _lowest(rows: list[tuple[bytes, bytes]], length: int) -> tuple[dict[bytes, int], list[list[bytes]]]:
    """(the smallest id of each string, the strings of each row) of rows of packed ids and strings."""
    least: dict[bytes, int] = {}
    lists = []
    for ids, data in rows:
        lists.append(_strings(unpack(data), length))
        for text, i in zip(lists[-1], np.frombuffer(unpack(ids), np.int64).tolist()):
            if least.get(text, NO_ID + 1) > i:
                least[text] = i
    return least, lists


def first_holders(items: list[tuple[np.ndarray, np.ndarray, list[bytes]]], length: int) -> list[bytes]:
    """For each sender's (keys, least ids, pieces): its pieces' runs of equal smallest ids of strings, packed."""
    number: dict[tuple[int, bytes], int] = {}
    places = [np.array([number.setdefault(x, len(number)) for x in zip(keys.tolist(), texts)], np.int64) for keys, _, texts in items]
    texts = [t for _, t in number]
    keys = np.array([k for k, _ in number], np.uint64)
    counts = np.array([len(t) for t in texts], np.int64) - length + 1
    least = np.full(len(texts), NO_ID)
    for at, (_, ids, _) in zip(places, items):
        np.minimum.at(least, at, ids)
    begins = np.cumsum(counts) - counts
    answer = np.repeat(least, counts)  # by string
    # Distinct pieces with one minimizer: their strings are compared
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    alone = np.ones(len(ranked) + 1, bool)
    alone[1:-1] = ranked[1:] != ranked[:-1]
    mixed = order[~(alone[:-1] & alone[1:])]
    chunk, size = [], 0
    for i, at in enumerate(mixed.tolist()):
        chunk.append(at)
        size += len(texts[at])
        if i + 1 == len(mixed) or size >= _TEXT and keys[mixed[i + 1]] != keys[at]:
            some = np.array(chunk)
            where = _ranges(begins[some], counts[some])
            classes = equal_strings([texts[t] for t in chunk], length)
            best = np.full(int(classes.max()) + 1, NO_ID)
            np.minimum.at(best, classes, answer[where])
            answer[where] = best[classes]
            chunk, size = [], 0
    out = []
    for at in places:
        n = counts[at]
        values = answer[_ranges(begins[at], n)]
        edge = np.zeros(len(values), bool)
        edge[np.cumsum(n) - n] = True
        edge[1:] |= values[1:] != values[:-1]
        runs = np.flatnonzero(edge)
        out.append(pack(np.concatenate([values[runs], np.diff(np.concatenate([runs, [len(values)]]))])))
    return out


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, group_bytes: int = GROUP_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain, if texts).

    A byte is removed if a string of length bytes that covers it also starts in a row with a smaller id. Ids are
    integers; a null id is larger than all others; rows that share an id don't remove from each other; null texts
    count as empty; texts shorter than length are kept; an empty table gives an empty result; further columns are left
    aside. df is read several times, so one that files or checkpoints don't give is cut first.
    """
    prepare(df.sparkSession)
    df = settled(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    gram = max(1, min(GRAM, length // 2))
    text = F.coalesce("text", F.lit("")).cast("binary")
    total = df.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups, plan = int(total // group_bytes + 1), exchange.Plan.of(2 * total // (length - gram))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    rows = df.select(deal.alias("g"), F.col("id").cast("long").alias("id"), text.alias("text"))
    full = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("r", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
    hop = pa.schema([("s", pa.int64()), ("r", pa.int64()), ("p", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])
    back = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("data", pa.binary())])

    def runs_of(group: pa.Table) -> Runs:
        return Runs(group.column("text").to_pylist(), length, gram)

    def minimizers(group: pa.Table) -> pa.Table:
        runs = runs_of(group)
        return exchange.sets_table(plan, group.column("g")[0].as_py(), runs.distinct, runs.pieces(length), runs.shared)

    def ids_of(group: pa.Table) -> np.ndarray:
        return group.column("id").fill_null(int(NO_ID)).to_numpy()

    def listed(answers: pa.Table) -> dict[int, bytes]:
        return dict(zip(answers.column("r").to_pylist(), answers.column("data").to_pylist()))

    def pieces(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], full)
        runs, made, g = runs_of(group), [], group.column("g")[0].as_py()
        sent = Pieces(runs, exchange.GroupKeys(plan, runs.distinct).flags(listed(answers)), ids_of(group), length, plan)
        for p, at in _by_bucket(sent.bucket):
            some = [sent.texts[i] for i in at.tolist()]
            sizes = np.array([len(t) for t in some], np.uint32)
            made.append((g, -1, p, sent.keys[at].tobytes(), pack(sent.least[at]), pack(sizes), pack(b"".join(some))))
        for r, at in _by_bucket(sent.home):
            made.append((g, g // plan.fan, r, None, pack(sent.lowest[at]), None, pack(b"".join([sent.strings[i] for i in at.tolist()]))))
        return table(made, full)

    def holders(bucket: pa.Table) -> pa.Table:
        if bucket.column("s")[0].as_py() >= 0:  # single strings: see merged
            return table([], back)
        items = []
        for x in bucket.select(["keys", "ids", "sizes", "data"]).to_pylist():
            data, ends = unpack(x["data"]), np.cumsum(np.frombuffer(unpack(x["sizes"]), np.uint32), dtype=np.int64).tolist()
            items.append((np.frombuffer(x["keys"], np.uint64), np.frombuffer(unpack(x["ids"]), np.int64), [data[a:b] for a, b in zip([0, *ends], ends)]))
        return table(list(zip(bucket.column("g").to_pylist(), bucket.column("r").to_pylist(), first_holders(items, length))), back)

    def of(bucket: pa.Table) -> tuple[dict[bytes, int], list[list[bytes]]]:
        return _lowest(list(zip(bucket.column("ids").to_pylist(), bucket.column("data").to_pylist())), length)

    def homes(strings: list[bytes]) -> np.ndarray:
        return plan.bucket(plan.cut(_grams(np.frombuffer(b"".join(strings), np.uint8), length)[::length]))

    def merged(bucket: pa.Table) -> pa.Table:
        s, r = bucket.column("s")[0].as_py(), bucket.column("r")[0].as_py()
        if s < 0:  # pieces: see holders
            return table([], hop)
        least, _ = of(bucket)
        strings, made = sorted(least), []
        for p, at in _by_bucket(homes(strings)):
            some = [strings[i] for i in at.tolist()]
            made.append((s, r, p, pack(np.array([least[x] for x in some], np.int64)), pack(b"".join(some))))
        return table(made, hop)

    def answered(bucket: pa.Table) -> pa.Table:
        least, lists = of(bucket)
        s, r, p = (bucket.column(c).to_pylist() for c in ("s", "r", "p"))
        return table([(a, b, c, pack(np.array([least[x] for x in some], np.int64)), None) for a, b, c, some in zip(s, r, p, lists)], hop)

    def scattered(bucket: pa.Table, told: pa.Table) -> pa.Table:
        if not bucket.num_rows or bucket.column("s")[0].as_py() < 0:
            return table([], back)
        least, lists = of(bucket)
        strings = sorted(least)
        answers = dict(zip(told.column("p").to_pylist(), told.column("ids").to_pylist()))
        for p, at in _by_bucket(homes(strings)):
            least |= zip([strings[i] for i in at.tolist()], np.frombuffer(unpack(answers[p]), np.int64).tolist())
        g, r = bucket.column("g").to_pylist(), bucket.column("r").to_pylist()
        return table([(a, b, pack(np.array([least[x] for x in some], np.int64))) for a, b, some in zip(g, r, lists)], back)

    out_fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * texts]

    def removed(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], pa.schema(out_fields))
        runs, ids = runs_of(group), ids_of(group)
        first, second, third = (listed(answers.filter(pa.compute.equal(answers.column("step"), k))) for k in (1, 2, 3))
        sent = Pieces(runs, exchange.GroupKeys(plan, runs.distinct).flags(first), ids, length, plan)
        counts = np.array([len(t) for t in sent.texts], np.int64) - length + 1
        begins, parts, at_end = np.zeros(len(counts), np.int64), [], 0
        for p, at in _by_bucket(sent.bucket):
            values = np.frombuffer(unpack(second[p]), np.int64).reshape(2, -1)
            parts.append(np.repeat(values[0], values[1]))
            begins[at] = at_end + np.cumsum(counts[at]) - counts[at]
            at_end += len(parts[-1])
        least = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        seen = least[_ranges(begins[sent.number], sent.count)] < np.repeat(ids[sent.row], sent.count)
        lowest = np.zeros(len(sent.strings), np.int64)
        for r, at in _by_bucket(sent.home):
            lowest[at] = np.frombuffer(unpack(third[r]), np.int64)
        hits = np.concatenate([_ranges(sent.start, sent.count)[seen], sent.at[lowest[sent.which] < ids[sent.owner]]])
        marks = np.zeros(len(runs.data) + length + 1, np.int32)
        marks[hits] += 1  # a position is in one run only
        marks[hits + length] -= 1
        gone = np.cumsum(marks)[: len(runs.data)] > 0
        data, made = np.frombuffer(runs.data, np.uint8), []
        for doc, a, n in zip(group.column("id").to_pylist(), runs.begins.tolist(), runs.sizes.tolist()):
            cut = gone[a : a + n]
            left = data[a : a + n][~cut].tobytes()
            n_spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (n > 0 and bool(cut[0])))
            made.append((doc, n, n - len(left), n_spans, hashlib.sha256(left).hexdigest(), *[left] * texts))
        return table(made, pa.schema(out_fields))

    sets = rows.groupBy("g").applyInArrow(minimizers, exchange.SENT)
    flags = exchange.shared_keys(sets, plan, length + (length - gram) // 2, hot_bytes)
    parts = rows.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(pieces, "g long, s long, r long, keys binary, ids binary, sizes binary, data binary")
    dealt = parts.groupBy("s", "r")  # all that follows shares one exchange
    plain = dealt.applyInArrow(holders, "g long, r long, data binary")
    told = dealt.applyInArrow(merged, "s long, r long, p long, ids binary, data binary").groupBy("p").applyInArrow(answered, "s long, r long, p long, ids binary, data binary")
    single = dealt.cogroup(told.groupBy("s", "r")).applyInArrow(scattered, "g long, r long, data binary")
    answers = flags.withColumn("step", F.lit(1)).unionByName(plain.withColumn("step", F.lit(2))).unionByName(single.withColumn("step", F.lit(3)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(removed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT k, doc_id, j, substr(h, 2 * j + 1, 100) AS g FROM (SELECT *, unnest(range(0, n - 49)) AS j FROM d WHERE n >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
x AS (SELECT k, j FROM s JOIN m USING (g) WHERE least < coalesce(doc_id, 9223372036854775807)),
i AS (
  SELECT k, j, sum((j > coalesce(p + 50, -1))::INT) OVER (PARTITION BY k ORDER BY j) AS run
  FROM (SELECT k, j, lag(j) OVER (PARTITION BY k ORDER BY j) AS p FROM x)),
r AS (SELECT k, min(j) AS a, max(j) + 50 AS b FROM i GROUP BY k, run),
l AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS z FROM r),
t AS (
  SELECT k, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS e,
         string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM l JOIN d USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (k)
"""
