"""MinHash slots by MD5 for a batch of texts: numpy takes the steps of RFC 1321 on arrays of messages at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# As arrays of one number: numpy takes these faster than scalars
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, "uint32").reshape(64, 1)
_BACK = np.uint32(32) - _TURNS
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], "uint32").reshape(64, 1)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that go through the steps at once, runs that are looked at together, bytes of texts that are; the most bytes of a run in arrays.
MESSAGES, RUNS, BYTES, WIDTHS = 32768, 131072, 1 << 23, (53, 117, 245)


def _first_words(blocks: list[list[np.ndarray | None]], n: int) -> np.ndarray:
    """The first four bytes, as big-endian numbers, of the MD5 of n messages: padded, in blocks of 16 words; None is a word that is zero in all."""
    add, xor, both, either = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or
    held = [np.full(n, x, "uint32") for x in _START]
    for k, words in enumerate(blocks):
        a, b, c, d = (x.copy() for x in held)
        f, t = np.empty(n, "uint32"), np.empty(n, "uint32")
        last = k == len(blocks) - 1
        for i in range(61 if last else 64):  # what step 60 gives is the first word in the end
            if i < 16:
                g = i
                xor(c, d, f), both(f, b, f), xor(f, d, f)
            elif i < 32:
                g = (5 * i + 1) % 16
                xor(b, c, f), both(f, d, f), xor(f, c, f)
            elif i < 48:
                g = (3 * i + 5) % 16
                xor(b, c, f), xor(f, d, f)
            else:
                g = 7 * i % 16
                np.invert(d, f), either(f, b, f), xor(f, c, f)
            add(f, a, f), add(f, _SINES[i], f)
            if words[g] is not None:
                add(f, words[g], f)
            np.left_shift(f, _TURNS[i], t), np.right_shift(f, _BACK[i], f)
            either(f, t, f), add(f, b, f)
            a, d, c, b, f = d, c, b, f, a
        if last:
            return (held[0] + b).byteswap()
        held = [x + y for x, y in zip(held, (a, b, c, d))]


def _salted(rows: np.ndarray, sizes: np.ndarray, salts: list[bytes]) -> np.ndarray:
    """_first_words of each salt before each row (zero beyond its size): an array a salt."""
    out = np.empty((len(salts), len(rows)), "uint32")
    for digits in sorted({len(s) for s in salts}):
        count = (sizes + digits + 8) // 64 + 1
        for blocks in np.unique(count):
            some = np.flatnonzero(count == blocks)
            for at in range(0, len(some), MESSAGES):
                part = some[at : at + MESSAGES]
                size, n = sizes[part] + digits, len(part)
                message = np.zeros((n, 64 * blocks), "uint8")
                width = min(rows.shape[1], 64 * blocks - 9)
                message[:, digits : digits + width] = rows[part, :width][:, : 64 * blocks - digits]
                message[np.arange(n), size] = 0x80
                words = np.ascontiguousarray(message.view("<u4").T)
                words[-2] = size * 8
                lists = [w if w.any() else None for w in words]
                for k, salt in enumerate(salts):
                    if len(salt) == digits:
                        lists[0] = words[0] | np.uint32(int.from_bytes(salt, "little"))
                        out[k, part] = _first_words([lists[16 * i : 16 * i + 16] for i in range(blocks)], n)
    return out


def _distinct(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct rows, each row's place among them)."""
    odd = np.random.default_rng(1).integers(0, 2**63, rows.shape[1] // 8, dtype="uint64") * np.uint64(2) + np.uint64(1)
    mixed = (rows.view("<u8") * odd).sum(axis=1, dtype="uint64") + sizes.astype("uint64")
    _, first, place = np.unique(mixed, return_index=True, return_inverse=True)
    mine = first[place]
    if (sizes[mine] == sizes).all() and (rows[mine] == rows).all():
        return first, place
    return np.arange(len(rows)), np.arange(len(rows))  # two rows with one mixed number


def _least(text: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, salts: list[bytes], best: list) -> None:
    """Puts the least digests of the runs (start, size, doc; sorted by doc) of one class of sizes into best, len(salts) a doc."""
    width = -(-int(sizes.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    rows *= np.arange(width) < sizes[:, None]
    first, place = _distinct(rows, sizes)
    values = _salted(rows[first], sizes[first], salts)
    edges = np.flatnonzero(np.diff(docs, prepend=-1))
    for k, salt in enumerate(salts):
        value = values[k][place]
        low = np.repeat(np.minimum.reduceat(value, edges), np.diff(edges, append=len(docs)))
        at = np.flatnonzero(value == low)
        if len(at) > len(edges):
            at = at[np.unique(docs[at] * len(first) + place[at], return_index=True)[1]]
        for doc, run in zip(docs[at].tolist(), first[place[at]].tolist()):
            _lower(best, doc * len(salts) + k, hashlib.md5(salt + text[starts[run] : starts[run] + sizes[run]]).hexdigest())


def _lower(best: list, i: int, value: str) -> None:
    if best[i] is None or value < best[i]:
        best[i] = value


def _slots(text: bytes, bounds: np.ndarray, salts: list[bytes], size: int, best: list, doc: int) -> None:
    """best of the texts between bounds; doc is the first one's number."""
    data = np.frombuffer(text + bytes(256), "uint8")
    blanks = np.flatnonzero(data[: len(text)] == 32)
    held = np.flatnonzero(np.diff(bounds))
    starts, ends = np.sort(np.concatenate([bounds[held], blanks + 1])), np.sort(np.concatenate([blanks, bounds[held + 1]]))
    owner = np.searchsorted(bounds, starts, "right") - 1
    run = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
    for at in range(0, len(run), RUNS):
        part = run[at : at + RUNS]
        begin, docs = starts[part], owner[part] + doc
        sizes, low = ends[part + size - 1] - begin, -1
        for most in WIDTHS:
            some = (sizes > low) & (sizes <= most)
            if some.any():
                _least(text, data, begin[some], sizes[some], docs[some], salts, best)
            low = most
        for i in np.flatnonzero(sizes > low).tolist():
            value = text[begin[i] : begin[i] + sizes[i]]
            for k, salt in enumerate(salts):
                _lower(best, docs[i] * len(salts) + k, hashlib.md5(salt + value).hexdigest())


def least_digests(texts: pa.Array, n: int, size: int) -> pa.Array:
    """For each text of words between single blanks, size of them at least, and each salt 0 .. n - 1 the smallest hex MD5 of the salt and a run of size words; of a null n nulls."""
    held = texts.cast(pa.large_binary()).fill_null(b"")
    salts, best = [str(k).encode() for k in range(n)], [None] * (n * len(held))
    bounds = np.frombuffer(held.buffers()[1], "int64")[held.offset : held.offset + len(held) + 1]
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BYTES, "right")) - 1)
        text = held.buffers()[2][int(bounds[at]) : int(bounds[to])].to_pybytes() if bounds[to] > bounds[at] else b""
        if text:
            _slots(text, bounds[at : to + 1] - bounds[at], salts, size, best, at)
        at = to
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(best) + 1, n), "int32"), pa.array(best, "string"))


def slots(words: Column, n: int, size: int) -> Column:
    """least_digests of a column of joined words."""

    @F.arrow_udf("array<string>")
    def least(texts: pa.Array) -> pa.Array:
        return least_digests(texts, n, size)

    return least(words.cast("binary"))
