"""Which keys of a group of texts other groups have too: sets of hashed keys, exchanged in two hops.

A group sends its keys, sorted, in ranges of buckets to its supergroup's task for the range, not to each bucket; that
task makes equal keys of the supergroup's groups one and sends a row to each bucket of its range. With G groups, B
buckets and sqrt(B) groups a supergroup and buckets a range, that are G * sqrt(B) rows for either hop in place of G * B,
and a row holds about as many keys at any size of the corpus. Answers go back the same way. A key counts the bytes that
its group would send for it, so what would be more than a task should read is known before anything is sent.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Keys of a bucket, on average.
BUCKET = 1 << 20
#: What a key's flag says: no other text has it; another one has; others have, and more of it than one task should read; more than VAST_HOT times that.
ALONE, SHARED, HOT, VAST = 0, 1, 2, 3
VAST_HOT = 16
SENT = "g long, s long, r long, data binary"
_TO = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("r", pa.int64()), ("data", pa.binary())])
_HOP = "s long, r long, p long, data binary"
_HOP_TO = pa.schema([("s", pa.int64()), ("r", pa.int64()), ("p", pa.int64()), ("data", pa.binary())])

pack = lambda x: zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())
unpack = lambda x: zstandard.ZstdDecompressor().decompress(x)


def table(made: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(schema), schema)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit key whose high bits are even, whatever the keys' are."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Plan:
    """buckets; fan: buckets of a range, and groups of a supergroup; width: bytes of a key on its way, 30 bits or more beyond its bucket."""

    buckets: int
    fan: int
    width: int

    @classmethod
    def of(cls, keys: int, bucket: int = BUCKET) -> Plan:
        buckets = max(1, int(keys // bucket + 1))
        return cls(buckets, isqrt(buckets) + 1, min(8, max(5, -(-(buckets.bit_length() + 30) // 8))))

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys) >> np.uint64(64 - 8 * self.width)

    def bucket(self, cut: np.ndarray) -> np.ndarray:
        """The bucket of each cut key: ascending with the keys."""
        top = cut >> np.uint64(8 * self.width - 32)
        return (top * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


def slices(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, start, end) of each run of an ascending array."""
    edges = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist() if len(numbers) else []
    return [(int(numbers[a]), a, b) for a, b in zip(edges, [*edges[1:], len(numbers)])]


def _coded(size: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A byte a key: the fourth root's power of two that holds its size, and whether two texts have it."""
    power = np.ceil(4 * np.log2(np.maximum(size, 1.0)) - 1e-9)
    return np.minimum(power, 127).astype(np.uint8) | (shared.astype(np.uint8) << 7)


def _sizes(code: np.ndarray) -> np.ndarray:
    return np.exp2((code & 127) / 4.0)


def encoded(cut: np.ndarray, code: np.ndarray, width: int) -> bytes:
    """Keys byte by byte, the highest bytes first: as keys ascend, those are runs, which compress."""
    planes = cut.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return np.ascontiguousarray(planes.T).tobytes() + code.tobytes()


def decoded(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(width + 1, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, 8 - width :] = raw[:width].T
    return wide.view(">u8").ravel().astype(np.uint64), raw[width]


class GroupKeys:
    """The distinct 64-bit keys of a group as they are sent: cut, sorted, in ranges."""

    def __init__(self, plan: Plan, keys: np.ndarray):
        self.plan = plan
        self.cut, self.place, self.times = np.unique(plan.cut(keys), return_inverse=True, return_counts=True)
        self.ranges = slices(plan.bucket(self.cut) // plan.fan)

    def rows(self, g: int, counts: np.ndarray, shared: np.ndarray) -> list[tuple]:
        """What is sent of keys that come counts times, and of which two texts of the group have those that are shared."""
        size = np.bincount(self.place, counts, len(self.cut))
        code = _coded(size, (np.bincount(self.place, shared, len(self.cut)) > 0) | (self.times > 1))
        return [(g, g // self.plan.fan, r, encoded(self.cut[a:b], code[a:b], self.plan.width)) for r, a, b in self.ranges]

    def flags(self, answers: dict[int, bytes]) -> np.ndarray:
        """The flag of each key, in the order that they were given in, by the answers of the ranges."""
        parts = [np.frombuffer(unpack(answers[r]), np.uint8) for r, _, _ in self.ranges]
        return np.concatenate([*parts, np.zeros(0, np.uint8)])[self.place]


def _joined(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(cut keys, their places in each row, sizes, shared) of rows of keys made one."""
    parts = [decoded(x, width) for x in rows]
    cut, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    code = np.concatenate([p[1] for p in parts])
    size = np.bincount(place, _sizes(code), len(cut))
    shared = (np.bincount(place, code >> 7, len(cut)) > 0) | (np.bincount(place, minlength=len(cut)) > 1)
    ends = np.cumsum([len(p[0]) for p in parts])
    return cut, np.split(place, ends[:-1]), size, shared


def shared_keys(sets: DataFrame, plan: Plan, unit: int, hot_bytes: int) -> DataFrame:
    """(g, r, data): for each row of sets (SENT, GroupKeys.rows) the flags of its keys. unit: the bytes that a count stands for."""
    width = plan.width

    def merged(rows: pa.Table) -> pa.Table:
        s, r = rows.column("s")[0].as_py(), rows.column("r")[0].as_py()
        cut, _, size, shared = _joined(rows.column("data").to_pylist(), width)
        code = _coded(size, shared)
        return table([(s, r, p, encoded(cut[a:b], code[a:b], width)) for p, a, b in slices(plan.bucket(cut))], _HOP_TO)

    def answered(rows: pa.Table) -> pa.Table:
        _, places, size, shared = _joined(rows.column("data").to_pylist(), width)
        flags = np.where(shared, SHARED + (size * unit >= hot_bytes) + (size * unit >= hot_bytes * VAST_HOT), ALONE).astype(np.uint8)
        s, r, p = (rows.column(c).to_pylist() for c in ("s", "r", "p"))
        return table([(a, b, c, pack(flags[at])) for a, b, c, at in zip(s, r, p, places)], _HOP_TO)

    def scattered(rows: pa.Table, answers: pa.Table) -> pa.Table:
        back = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("data", pa.binary())])
        if not rows.num_rows:
            return table([], back)
        _, places, _, _ = _joined(rows.column("data").to_pylist(), width)
        parts = sorted(zip(answers.column("p").to_pylist(), answers.column("data").to_pylist()))
        flags = np.concatenate([np.frombuffer(unpack(x), np.uint8) for _, x in parts])
        return table([(g, r, pack(flags[at])) for g, r, at in zip(rows.column("g").to_pylist(), rows.column("r").to_pylist(), places)], back)

    told = sets.groupBy("s", "r").applyInArrow(merged, _HOP).groupBy("p").applyInArrow(answered, _HOP)
    return sets.groupBy("s", "r").cogroup(told.groupBy("s", "r")).applyInArrow(scattered, "g long, r long, data binary")


def sets_table(plan: Plan, g: int, keys: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> pa.Table:
    return table(GroupKeys(plan, keys).rows(g, counts, shared), _TO)


def distinct_counts(number: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """How many distinct marks each of n numbers has."""
    with np.errstate(over="ignore"):
        both = mixed(marks + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(number[np.unique(both, return_index=True)[1]], minlength=n)
