"""Secret scans: three fixed patterns, and a battery of randomness tests for what they don't name."""

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read, spread

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
NAMED = re.compile(r"pass|secret|token|api_?key", re.IGNORECASE | re.ASCII)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by alphabet, the smallest first, and the chance that two symbols of ordinary text in it are equal.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", 0.20),
    ("HEX", DIGITS + "ABCDEF", 0.20),
    ("base32", UPPER + "234567", 0.065),
    ("base36", DIGITS + LOWER, 0.065),
    ("BASE36", DIGITS + UPPER, 0.065),
    ("base62", DIGITS + UPPER + LOWER, 0.06),
    ("base64", UPPER + LOWER + DIGITS + "+/", 0.06),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.06),
)
_CODES = [(name, {c: i for i, c in enumerate(letters)}, same) for name, letters, same in ENCODINGS]

#: Share of false finds that is allowed among a document's random strings, and the level at which a string isn't random.
FALSE_SHARE, LEVEL = 0.01, 0.001


def _normal(z: float) -> float:
    """P(N < z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _below(x: float, df: float, far: float) -> float:
    """P(X < x) for a chi-squared X with df degrees of freedom and noncentrality far, by the cube-root approximation of a scaled one.

    An x that rounding took below 0 counts as 0.
    """
    x = max(x, 0.0)
    scale = (df + 2 * far) / (df + far)
    even = (df + far) / scale
    return _normal(((x / scale / even) ** (1 / 3) - (1 - 2 / (9 * even))) / math.sqrt(2 / (9 * even)))


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, chance as a random string, chance as ordinary text) of a token; None if no encoding fits.

    As a random string: the smallest of the chances of its chi-squared over the alphabet, of the runs above and below
    the median symbol, and of the correlation of neighbours, times three. As ordinary text: the chance that text of
    this length, whose symbols meet at the encoding's rate, is spread as evenly; it falls with the length.
    """
    if token.isdigit():
        return None
    for name, codes, same in _CODES:
        try:
            seen = [codes[c] for c in token]
        except KeyError:
            continue
        break
    else:
        return None
    n, k = len(seen), len(codes)
    counts: dict[int, int] = {}
    for s in seen:
        counts[s] = counts.get(s, 0) + 1
    spread = k / n * sum(c * c for c in counts.values()) - n
    uniform = 1 - _below(spread, k - 1, 0)
    # Runs
    middle = sorted(seen)[n // 2]
    high = [s >= middle for s in seen]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    run_chance = 2 * _normal(-abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    # Neighbours
    m = sum(seen) / n
    total = sum((s - m) ** 2 for s in seen)
    near = sum((x - m) * (y - m) for x, y in zip(seen, seen[1:]))
    serial = 2 * _normal(-abs((near / total * n + 1) / math.sqrt(n))) if total else 0.0
    return name, min(1.0, 3 * min(uniform, run_chance, serial)), _below(spread, k - 1, n * (k * same - 1))


def random_spans(text: str, false_share: float = FALSE_SHARE, level: float = LEVEL) -> list[tuple[int, int]]:
    """The candidates that pass as random and whose chances as text, taken together, keep false finds under false_share."""
    family = []
    for m in CANDIDATE.finditer(text):
        if found := battery(m[0]):
            family.append((found[2], found[1], m.span()))
    family.sort()
    passed = max((i + 1 for i, x in enumerate(family) if x[0] <= false_share * (i + 1) / len(family)), default=0)
    return [span for _, chance, span in family[:passed] if chance >= level]


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order, of every secret; code points, end exclusive."""
    text = text or ""
    found = []
    if NAMED.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for a, b in random_spans(text):
        before = bisect_right(starts, a)  # base spans that begin at a or before it
        if not before or reach[before - 1] < b:
            found.append((a, 3, b))
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A null text counts as empty: no spans, and the digest of nothing. A null id stays null; repeated rows each get a
    row; an empty table gives an empty result; further columns are left aside. A random string inside a span of the
    fixed patterns is not listed again; fixed patterns may overlap each other.
    """
    prepare(df.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [[], [], [], []], [], []
            for text in batch.column(1):
                found = spans(text.as_py())
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                shas.append(hashlib.sha256(_joined([x for x in found if x[1] < 3]).encode()).hexdigest())
                texts.append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with each run of overlapping spans replaced by mark."""
    if not (found := spans(text)):
        return text
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the secrets of text_col masked; null texts stay null, other columns and the order of columns as they were."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redacted(t, mark))

    return df.withColumn(text_col, masked(df[text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
