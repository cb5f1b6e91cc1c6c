"""Near-duplicate passages by compact windows.

A text's tokens are its five-word shingles. For a hash function, the Cartesian tree over the token hashes has at each
node a token c and the widest range l..r of which it is the minimum: every subsequence that begins in l..c and ends in
c..r has c's hash as its min-hash. That compact window stands for all of them; only nodes with WIDTH tokens or more
matter, which are about 2 / WIDTH of the tokens, and those above such a node are such nodes too. Two passages with a
Jaccard similarity of s agree in each function's min-hash with probability s (always, if equal), so windows of some
function meet by their hash, and the intervals around their tokens are compared.

1. Rows are dealt into groups; groups learn, in two hops (see exchange), which of their windows' hashes another row has.
2. Windows of those hashes with equal contexts are one within the group. Distinct contexts go to a bucket by hash, and
   are compared there.
3. Links make the classes, spans the passages.

Windows of a hash of which groups would send more than HOT_BYTES (a phrase in every third text) meet by the hash and each
string of SHARED tokens, the classes in which others are compared, so both find the same pairs; and where that is much
more (a copy in every third text), equal contexts are made one in parts first.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import components, cut, prepare, read, settled
from .exchange import pack, table, unpack
from .suffix import _by_bucket, _smallest

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
FUNCTIONS = 4
#: Bytes of a group's texts; bytes of one hash's windows that a task reads at most.
GROUP_BYTES, HOT_BYTES = 4 << 20, 16 << 20
#: Hashes per bucket, on average, and parts in which the groups' contexts of a hot hash are made one first.
BUCKET, PARTS = 1 << 18, 64
#: Tokens by which a passage may be shifted against another within a window.
SHIFT = 2
WIDTH = WORDS - SHINGLE + 1
#: Tokens around a window's own that near windows share on the left, on the right or about the middle: edits that leave
#: a similarity of SIMILARITY leave a run of 20 tokens, and of a run that long, whatever the token's place in it, one of the three.
SHARED = 12
SPAN = 2 * WIDTH - 1
#: Equal tokens of WIDTH that a similarity of SIMILARITY takes: s = e / (2 * WIDTH - e).
EQUAL = int(np.ceil(2 * WIDTH * SIMILARITY / (1 + SIMILARITY) - 1e-9))
#: Distinct contexts of a class that are compared pair by pair.
PAIRS = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def tokens(text: bytes | None) -> tuple[int, np.ndarray]:
    """The number of words, and the hashes of the five-word shingles."""
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return len(words), np.zeros(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * _MUL + single[k : k + len(out)]
    return len(words), _mixed(out)


class Windows:
    """The compact windows of the rows of a group: key, row, c (place among all tokens of the group), low, high."""

    def __init__(self, texts: list[bytes]):
        self.words, found = [], []
        for t in texts:
            n, hashes = tokens(t)
            self.words.append(n)
            found.append(hashes)
        self.tokens = np.concatenate([*found, np.zeros(0, np.uint64)])
        sizes = np.array([len(f) for f in found], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        parts = [self._windows(f) for f in range(FUNCTIONS)] if len(self.tokens) >= WIDTH else []
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
        self.key, self.c, self.low, self.high = columns
        self.row = self.owner[self.c] if len(self.c) else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        ranked, rows = self.key[order], self.row[order]
        edge = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        at = np.flatnonzero(edge)
        self.distinct = ranked[edge]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(edge) - 1
        if len(at):
            self.shared = np.minimum.reduceat(rows, at) != np.maximum.reduceat(rows, at)
        else:
            self.shared = np.zeros(0, bool)

    def times(self) -> np.ndarray:
        """How many distinct windows each distinct hash has here, by a token on either side."""
        if not len(self.c):
            return np.zeros(0, np.int64)
        left, right = (self.tokens[np.clip(self.c + k, self.low, self.high)] for k in (-WIDTH // 3, WIDTH // 3))
        with np.errstate(over="ignore"):
            return exchange.distinct_counts(self.number, left * _MUL + right, len(self.distinct))

    def _windows(self, function: int) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            h = _mixed(self.tokens + np.uint64(function + 1) * _MUL) | np.uint64(1)
        least = _smallest(h, WIDTH)
        inside = self.owner[: len(least)] == self.owner[WIDTH - 1 :]
        least = np.where(inside, least, np.uint64(0))
        around = np.concatenate([np.zeros(WIDTH - 1, np.uint64), least, np.zeros(WIDTH - 1, np.uint64)])
        most = ~_smallest(~around, WIDTH)
        nodes = np.flatnonzero(most == h)  # minima of a range of WIDTH: the upper part of each text's Cartesian tree
        low, high = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
        places, values, owners = nodes.tolist(), h[nodes].tolist(), self.owner[nodes].tolist()
        begins, ends = self.begins.tolist(), self.ends.tolist()
        lows, highs, stack, text = [0] * len(places), [0] * len(places), [], -1
        for i, (place, value, owner) in enumerate(zip(places, values, owners)):
            if owner != text:
                for j in stack:
                    highs[j] = ends[text] - 1
                stack, text = [], owner
            while stack and values[stack[-1]] > value:
                highs[stack.pop()] = place - 1
            lows[i] = places[stack[-1]] + 1 if stack else begins[owner]
            stack.append(i)
        for j in stack:
            highs[j] = ends[text] - 1
        low[:], high[:] = lows, highs
        return (h[nodes] & ~np.uint64(7)) | np.uint64(function), nodes, low, high

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """For each window of at: 16 bits of the tokens from WIDTH - 1 before its own to WIDTH - 1 after it, as far as the window goes; 0 beyond."""
        out = np.zeros((len(at), SPAN), np.uint16)
        short = np.maximum((self.tokens >> np.uint64(48)).astype(np.uint16), np.uint16(1))
        for k in range(0, len(at), 8192):
            some = at[k : k + 8192]
            place = self.c[some][:, None] + np.arange(1 - WIDTH, WIDTH)[None, :]
            held = (place >= self.low[some][:, None]) & (place <= self.high[some][:, None])
            out[k : k + 8192][held] = short[place[held]]
        return out


_SHARED_AT = (WIDTH - SHARED, WIDTH - 1, WIDTH - 1 - SHARED // 2 + 1)


def _folded(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of each row and its key; of rows that hold a 0, a hash of its own."""
    out = keys.copy()
    with np.errstate(over="ignore"):
        for k in range(part.shape[1]):
            out = out * _MUL + part[:, k]
        out = _mixed(out)
    out[(part == 0).any(1)] = 0
    return out


def _same(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pair of contexts: the tokens of other that are in one, at most SHIFT places off."""
    there = other != 0
    same = (one == other) & there
    for s in range(1, SHIFT + 1):
        same[:, s:] |= (other[:, s:] == one[:, :-s]) & there[:, s:]
        same[:, :-s] |= (other[:, :-s] == one[:, s:]) & there[:, :-s]
    return same


def _matched(same: np.ndarray) -> np.ndarray:
    """For each row and each of WIDTH starts: how many of WIDTH tokens are marked."""
    sums = np.zeros((len(same), SPAN + 1), np.int8)
    np.cumsum(same, axis=1, dtype=np.int8, out=sums[:, 1:])
    return sums[:, WIDTH:] - sums[:, :-WIDTH]


def near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pair of contexts: the places (of WIDTH starts) where WIDTH tokens of other have EQUAL or more equal ones in one."""
    return _matched(_same(one, other)) >= EQUAL


def _united(spans: np.ndarray) -> np.ndarray:
    """Distinct (row, first, last), with those of a row that touch made one."""
    if not len(spans):
        return spans
    spans = np.unique(spans, axis=0)
    out = [spans[0].tolist()]
    for r, a, b in spans[1:].tolist():
        if r == out[-1][0] and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([r, a, b])
    return np.array(out, np.int64)


def _linked(a: np.ndarray, b: np.ndarray, rows: np.ndarray, places: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pairs of windows a, b are near, both ways, the links of their rows, the spans): a row isn't linked with itself."""
    hits = np.stack([near(contexts[b], contexts[a]), near(contexts[a], contexts[b])])
    met = hits.any(2).all(0)
    apart = met & (rows[a] != rows[b])
    a, b, hits = a[apart], b[apart], hits[:, apart]
    spans = []
    for x, own in ((a, hits[0]), (b, hits[1])):
        low, high = own.argmax(1) + 1 - WIDTH, WIDTH - 1 - own[:, ::-1].argmax(1)
        spans.append(np.stack([rows[x], np.maximum(places[x] + low, 0), places[x] + high], 1))
    return met, np.stack([rows[a], rows[b]], 1), np.concatenate(spans)


def fold(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, spans, kept): windows with one key and equal contexts are linked with the first of them, which is kept for all."""
    order = np.lexsort((places, rows, keys))
    whole = keys[order].copy()
    with np.errstate(over="ignore"):
        for k in range(SPAN):
            whole = whole * _MUL + contexts[order, k]
    least, of = np.unique(_mixed(whole), return_index=True, return_inverse=True)[1:]
    a, b = order[least[of]], order
    apart = rows[a] != rows[b]
    a, b = a[apart], b[apart]
    links, spans = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    for k in range(0, len(a), 16384):
        _, some, held = _linked(a[k : k + 16384], b[k : k + 16384], rows, places, contexts)
        links.append(some)
        spans.append(held)
    return np.unique(np.sort(np.concatenate(links), axis=1), axis=0), _united(np.concatenate(spans)), order[np.sort(least)]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make label, the least member of each one's component, that of a graph with edges a, b too."""
    while len(a) and (label[a] != label[b]).any():
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label[:] = label[label]


def _classes(cls: np.ndarray, who: np.ndarray, label: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members by class, sizes, seen) of the classes that are not in one component yet and whose set of members is new."""
    turn = np.lexsort((who, cls))
    cls, who = cls[turn], who[turn]
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (who[1:] != who[:-1])])[: len(who)]
    cls, who = cls[new], who[new]
    at = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])[: len(cls)])
    if not len(at):
        return who, at, seen
    sizes = np.diff(np.append(at, len(who)))
    with np.errstate(over="ignore"):
        sets = np.add.reduceat(_mixed((who.astype(np.uint64) + np.uint64(1)) * _MUL), at)
    take = np.zeros(len(at), bool)
    take[np.unique(sets, return_index=True)[1]] = True
    take &= np.minimum.reduceat(label[who], at) != np.maximum.reduceat(label[who], at)
    take &= ~np.isin(sets, seen)
    return who[np.repeat(take, sizes)], sizes[take], np.concatenate([seen, sets[take]])


def _centres(contexts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each class (number, ascending) its centre: the most frequent token at each place, 0 where all have none."""
    out = np.zeros((int(number[-1]) + 1, SPAN), np.uint16)
    for p in range(SPAN):
        token = contexts[:, p]
        held = np.flatnonzero(token)
        if not len(held):
            continue
        both, times = np.unique(number[held].astype(np.uint64) << np.uint64(16) | token[held], return_counts=True)
        of = (both >> np.uint64(16)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best = np.maximum.reduceat(times.astype(np.uint64) << np.uint64(16) | both & np.uint64(0xFFFF), at)
        out[of[at], p] = (best & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _split(number: np.ndarray, contexts: np.ndarray, centres: np.ndarray, same: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, place of the member) for the tokens in which members differ from their class's centre, of those that several have."""
    slices = np.uint64(len(number) // 8192 + 1)
    parts = []
    close = WIDTH - matched.max(1) < 20
    for k in range(0, len(number), 8192):
        other, base = contexts[k : k + 8192], (number[k : k + 8192].astype(np.uint64) + np.uint64(1))[:, None] * _MUL
        there = other != 0
        loose, tight = (centres[number[k : k + 8192]] != other) & there, there & ~same[k : k + 8192]
        wide = other.astype(np.uint64)
        with np.errstate(over="ignore"):
            double = _mixed(base + (wide[:, :-1] << np.uint64(16) | wide[:, 1:] | np.uint64(1 << 32)))
            single = _mixed(base + wide)
        for made, use, own in ((double, loose[:, :-1] & there[:, 1:], tight[:, :-1] & tight[:, 1:]), (single, loose & close[k : k + 8192, None], tight)):
            at = np.nonzero(use)
            parts.append((made[use] & ~np.uint64(1) | own[use], (at[0] + k).astype(np.int32)))
    keyed, members = (np.concatenate(c) for c in zip(*parts))
    del parts
    for s in range(int(slices)):
        some = np.flatnonzero((keyed >> np.uint64(1)) % slices == np.uint64(s))
        cls, who = keyed[some], members[some]
        turn = np.argsort(cls)
        cls, who = cls[turn], who[turn]
        at = np.flatnonzero(np.concatenate([[True], cls[1:] >> np.uint64(1) != cls[:-1] >> np.uint64(1)])[: len(cls)])
        sizes = np.diff(np.append(at, len(cls)))
        last = cls[at + sizes - 1] & np.uint64(1) == 1 if len(at) else np.zeros(0, bool)  # a member has it where the centre has nothing like it
        held = np.repeat(last & (sizes > 1), sizes)
        yield cls[held] >> np.uint64(1), who[held]


def meet(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, spans) of windows that meet by key: pairs of rows that join all near ones, and (row, first token, last token).

    Equal contexts are one first. Distinct ones with a key and a string of SHARED tokens are a class; classes of up to
    PAIRS are compared pair by pair, leaving out pairs that links join already. A larger class has a centre: the most
    frequent token at each place, so what most members have. Let x and y be near, in a range of WIDTH tokens of y.

    - If both are near the centre there: all members near the centre in that range are compared with the one that has
      most of it. Where that doesn't join them all, each of them is taken in its place in turn.
    - If one isn't, say y: it has WIDTH - EQUAL + 1 tokens or more there that the centre doesn't have, and x lacks WIDTH - EQUAL of y's
      at most, so x and y share such a token, and meet in the smaller class of the members that have it where the centre
      has another. As one token says little, pairs of neighbouring tokens are taken: if y has 12 such tokens or more,
      x and y share a pair, as each token that x lacks breaks one; if fewer, both are close to the centre, and single ones are taken.
    """
    links, spans, kept = fold(keys, rows, places, contexts)
    links, spans = [links], [spans]
    label, seen = np.arange(len(kept)), np.zeros(0, np.uint64)

    def compare(a: np.ndarray, b: np.ndarray, whole: bool = False) -> None:
        for k in range(0, len(a), 16384):
            x, y = a[k : k + 16384], b[k : k + 16384]
            new = (x != y) & (whole | (label[x] != label[y]))
            x, y = x[new], y[new]
            met, some, held = _linked(kept[x], kept[y], rows, places, contexts)
            links.append(some)
            spans.append(held)
            _joined(label, x[met], y[met])

    def exhaust(who: np.ndarray) -> None:
        for k, x in enumerate(who.tolist()):
            rest = who[k + 1 :]
            rest = rest[label[rest] != label[x]]
            compare(np.full(len(rest), x), rest)
            if (label[who] == label[who[0]]).all():
                return

    def large(who: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compares members of classes about their centres; gives the smaller classes."""
        number, at = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        own = contexts[kept[who]]
        centres = _centres(own, number)
        same = np.empty(own.shape, bool)
        for k in range(0, len(who), 8192):
            same[k : k + 8192] = _same(centres[number[k : k + 8192]], own[k : k + 8192])
        matched = _matched(same)
        close = matched >= EQUAL
        exact = close.copy()
        for k in range(1, SHIFT + 1):  # a near one's range may begin that many places beside
            close[:, k:] |= exact[:, :-k]
            close[:, :-k] |= exact[:, k:]
        place = np.arange(len(who), dtype=np.int64)[:, None]
        best = np.maximum.reduceat(matched.astype(np.int64) << 32 | (len(who) - 1 - place), at)
        best = len(who) - 1 - (best & 0xFFFFFFFF)  # by class and start: the member with most of the centre
        some = close.nonzero()
        pairs = np.unique(best[number[some[0]], some[1]] * len(who) + some[0])
        compare(who[pairs // len(who)], who[pairs % len(who)], True)
        found = label[who][:, None]
        low, high = np.minimum.reduceat(np.where(close, found, len(label)), at), np.maximum.reduceat(np.where(close, found, -1), at)
        parted = low < high
        for c in np.flatnonzero(parted.any(1)).tolist():
            span = slice(at[c], at[c] + sizes[c])
            exhaust(who[span][close[span][:, parted[c]].any(1)])
        for cls, members in _split(number, own, centres, same, matched):
            whole = np.unique(np.stack([cls, members.astype(np.uint64)]), axis=1) if len(cls) else np.zeros((2, 0), np.uint64)
            first, count = np.unique(whole[0], return_index=True, return_counts=True)[1:]
            of = number[whole[1][first].astype(np.int64)]
            for c in np.unique(of[count == sizes[of]]).tolist():  # a smaller class that isn't
                exhaust(who[at[c] : at[c] + sizes[c]])
            yield cls, who[members]

    cls = np.concatenate([_folded(contexts[kept, a : a + SHARED], keys[kept]) for a in _SHARED_AT])
    who = np.tile(np.arange(len(kept)), len(_SHARED_AT))
    who, sizes, seen = _classes(cls[cls != 0], who[cls != 0], label, seen)
    while len(who):
        number, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
        small = np.flatnonzero(size <= PAIRS)
        for step in range(1, PAIRS):
            ahead = small[small + step < len(who)]
            ahead = ahead[number[ahead] == number[ahead + step]]
            if not len(ahead):
                break
            compare(who[ahead], who[ahead + step])
        next_who, next_sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        wide = np.flatnonzero(sizes > PAIRS)
        batch = np.cumsum(sizes[wide]) // 8192
        for b in np.unique(batch):
            some = wide[batch == b]
            for cls, members in large(who[np.isin(number, some)], sizes[some]):
                part, count, seen = _classes(cls, members, label, seen)
                next_who.append(part)
                next_sizes.append(count)
        who, sizes = np.concatenate(next_who), np.concatenate(next_sizes)
    links = np.concatenate(links)
    return np.unique(np.sort(links, axis=1), axis=0), _united(np.concatenate(spans))


_FIELDS = [("kind", pa.string()), ("p", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("data", pa.binary())]
SCHEMA, SENT = pa.schema(_FIELDS), "kind string, p long, a long, b long, c long, data binary"


def _results(links: np.ndarray, spans: np.ndarray, p: int) -> list[tuple]:
    return [("link", p, a, b, None, None) for a, b in links.tolist()] + [("span", p, r, a, b, None) for r, a, b in spans.tolist()]


def _members(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, contexts: np.ndarray, p: int, kind: str) -> tuple:
    data = b"".join([np.int64(len(keys)).tobytes(), keys.astype("<u8").tobytes(), rows.astype("<i8").tobytes(), places.astype("<i8").tobytes(), contexts.astype("<u2").tobytes()])
    return (kind, p, None, None, None, pack(data))


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = unpack(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    whole = [np.frombuffer(raw, t, n, 8 + 8 * n * k) for k, t in enumerate(("<u8", "<i8", "<i8"))]
    return (*whole, np.frombuffer(raw, "<u2", n * SPAN, 8 + 24 * n).reshape(n, SPAN))


def _grouped(keys: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])).tolist() if len(keys) else []
    for a, b in zip(edges, [*edges[1:], len(keys)]):
        yield order[a:b]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: row, doc_id, n_words; links: a, b, pairs of rows that span the classes; spans: row, first, last word).

    df is read twice, so one that files or checkpoints don't give is cut first.
    """
    prepare(df.sparkSession)
    df = settled(df.select(df[id_col].alias("id"), df[text_col].alias("text")))
    text = F.coalesce("text", F.lit("")).cast("binary")
    total = df.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups, plan = int(total // group_bytes + 1), exchange.Plan.of(total * 2 * FUNCTIONS // (6 * WIDTH), BUCKET)
    row = F.monotonically_increasing_id()
    dealt = df.select(F.pmod(F.xxhash64(row), F.lit(groups)).alias("g"), row.alias("row"), F.col("id").cast("long").alias("id"), text.alias("text"))

    def sets(group: pa.Table) -> pa.Table:
        found = Windows(group.column("text").to_pylist())
        return exchange.sets_table(plan, group.column("g")[0].as_py(), found.distinct, found.times(), found.shared)

    def bucket(keys: np.ndarray) -> np.ndarray:
        return plan.bucket(plan.cut(keys))

    def windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], SCHEMA)
        g, ids = group.column("g")[0].as_py(), group.column("row").to_numpy()
        found = Windows(group.column("text").to_pylist())
        made = [("row", g, r, i, n, None) for r, i, n in zip(ids.tolist(), group.column("id").to_pylist(), found.words)]
        flags = exchange.GroupKeys(plan, found.distinct).flags(dict(zip(answers.column("r").to_pylist(), answers.column("data").to_pylist())))
        kind = flags[found.number]
        at = np.flatnonzero(kind)
        contexts, keys = found.contexts(at), found.key[at]
        hot = np.flatnonzero(kind[at] >= exchange.HOT)
        sides = []
        for a in _SHARED_AT:
            strings = _folded(contexts[hot, a : a + SHARED], keys[hot])
            sides.append((hot[strings != 0], strings[strings != 0]))
        plain = np.flatnonzero(kind[at] == exchange.SHARED)
        pick = np.concatenate([plain, *(s[0] for s in sides)])
        keys = np.concatenate([keys[plain], *(s[1] for s in sides)])
        wide = kind[at[pick]] == exchange.VAST
        rows, places, contexts = ids[found.row[at[pick]]], found.c[at[pick]] - found.begins[found.row[at[pick]]], contexts[pick]
        *results, lead = fold(keys, rows, places, contexts)
        made += _results(*results, g)
        for kind, some in (("once", lead[~wide[lead]]), ("part", lead[wide[lead]])):
            deal = bucket(keys[some])
            if kind == "part":
                deal = deal * PARTS + g % PARTS
            for p, at in _by_bucket(deal):
                s = some[at]
                made.append(_members(keys[s], rows[s], places[s], contexts[s], p, kind))
        return table(made, SCHEMA)

    def meeting(last: bool):
        def run(held: pa.Table) -> pa.Table:
            kinds = held.column("kind").to_pylist()
            data = held.column("data").to_pylist()
            p = held.column("p")[0].as_py()
            take = [i for i, k in enumerate(kinds) if k in ("once", "part")]
            passed = held.take(pa.array([i for i, k in enumerate(kinds) if k not in ("once", "part")], pa.int64())).cast(SCHEMA)
            made = []
            for kind in ("once", "part"):
                some = [_opened(data[i]) for i in take if kinds[i] == kind]
                if not some:
                    continue
                keys, rows, places, contexts = (np.concatenate(c) for c in zip(*some))
                del some
                if kind == "once" or last:
                    made += _results(*meet(keys, rows, places, contexts), p)
                else:
                    *results, lead = fold(keys, rows, places, contexts)
                    made += _results(*results, p)
                    made += [_members(keys[lead[at]], rows[lead[at]], places[lead[at]], contexts[lead[at]], q, "part") for q, at in _by_bucket(bucket(keys[lead]))]
            return pa.concat_tables([passed, table(made, SCHEMA)])

        return run

    flags = exchange.shared_keys(dealt.groupBy("g").applyInArrow(sets, exchange.SENT), plan, 2 * SPAN + 24, hot_bytes)
    out = dealt.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(windows, SENT)
    out = out.groupBy("p").applyInArrow(meeting(False), SENT).groupBy("p").applyInArrow(meeting(True), SENT)
    out = cut(out.drop("data"))
    rows = out.where("kind = 'row'").select(F.col("a").alias("row"), F.col("b").alias("doc_id"), F.col("c").alias("n_words"))
    links = out.where("kind = 'link'").select("a", "b").distinct()
    spans = out.where("kind = 'span'").select(F.col("a").alias("row"), F.col("b").alias("first"), (F.col("c") + SHINGLE - 1).alias("last"))
    return rows, links, spans


def near_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_passages, n_passage_words, spans (first:last word, in order), class_id.

    A passage is near another if 50 words around a shared min-hash have a Jaccard similarity of 0.8 or more in
    five-word shingles. class_id is the smallest doc_id that links of such passages reach, itself included; rows
    without any have none of the counts. Null and short texts have no passages; a null id counts as largest;
    repeated rows are near each other and get a row each; an empty table gives an empty result; further columns are left aside.
    """
    rows, links, spans = find(df, id_col, text_col, group_bytes, hot_bytes)
    found = components(links)
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    ids = members.join(rows.select(F.col("row").alias("node"), "doc_id"), "node")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classes = members.join(least, "component").select(F.col("node").alias("row"), "class_id")
    order = spans.distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("s"))
    # Spans of several tasks may overlap: a fold over the sorted ones unites them.
    joined = F.aggregate(
        "s",
        F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["last"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
    )
    order = order.select("row", joined.alias("s"))
    out = rows.join(classes, "row", "left").join(order, "row", "left")
    words = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return out.select(
        "doc_id", "n_words",
        F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(words, F.lit(0)).alias("n_passage_words"),
        F.coalesce(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["first"], x["last"])), ","), F.lit("")).alias("spans"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(read(spark, sf_dir, "documents"))
