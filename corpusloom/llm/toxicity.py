"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= k) = s(t_k - w.x) with ascending thresholds t_k and one weight vector w for all of them; x marks the words
of a text. The expected severity is the sum over k of P(grade > k).
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, read, spread

#: Labelled rows that are fitted, at most, of each grade; the ones whose hashed ids come first.
ROWS_PER_GRADE = 4000
#: Bytes of features (four each) that are fitted, at most, of each grade; rows that come later than this is full aren't.
BYTES_PER_GRADE = 16 << 20
#: A word must be in so many fitted texts.
LEAST_TEXTS = 3
#: Bytes of a longer word's start that count as a feature of their own.
STEM = 4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> set[int]:
    """CRC-32 of each distinct word of a text, A-Z in lower case, and of its start of STEM bytes, marked by a star."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    return set(map(zlib.crc32, words | {w[:STEM] + b"*" for w in words if len(w) > STEM}))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def score(self, text: str | None) -> float:
        return sum(self.weights[w] for w in features(text) & self.weights.keys())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return _sigmoid(scores[:, None] - np.asarray(self.thresholds)[None, :])

    def predict(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the most probable grade."""
        above = self.above(scores)
        chances = -np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1), axis=1)
        return above.sum(1), chances.argmax(1)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values at each of n places; zeros if there are none."""
    return np.bincount(at, values, n).astype(float)


def _loss_gradient(z: np.ndarray, steps: np.ndarray, grades: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood by score, and by (first threshold, log gaps)."""
    t = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
    ends = np.concatenate([[-np.inf], t, [np.inf]])
    high, low = _sigmoid(ends[grades + 1] - z), _sigmoid(ends[grades] - z)
    chance = np.maximum(high - low, 1e-12)
    d_high, d_low = counts * high * (1 - high) / chance, counts * low * (1 - low) / chance
    n = max(counts.sum(), 1e-12)
    by_end = _sums(grades + 1, -d_high, len(ends)) + _sums(grades, d_low, len(ends))
    by_t = by_end[1:-1] / n
    tail = np.cumsum(by_t[::-1])[::-1]
    return (d_high - d_low) / n, np.concatenate([tail[:1], tail[1:] * np.exp(steps[1:])])


def fit(texts: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 1e-3, rounds: int = 300, counts: np.ndarray | None = None) -> Model:
    """Select features with an L1 penalty, then fit the selected ones anew with a slight L2 penalty, so weights aren't shrunk.

    texts: the distinct features of each text. counts: how many labelled texts each one stands for; one, if left out.
    Where no feature is in LEAST_TEXTS texts, or none is selected, the model has thresholds only: the shares of the grades.
    """
    counts = np.ones(len(texts)) if counts is None else counts * (len(texts) / counts.sum())
    every = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    vocabulary, seen = np.unique(every, return_counts=True)
    vocabulary = vocabulary[seen >= LEAST_TEXTS]
    steps = np.zeros(n_grades - 1)
    share = np.clip(np.cumsum(np.bincount(grades, counts, minlength=n_grades)[:-1] + 1.0) / (len(grades) + n_grades), 1e-6, 1 - 1e-6)
    cuts = np.log(share / (1 - share))
    steps[0], steps[1:] = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    weights = np.zeros(0)
    for penalty, ridge in ((l1, 0.0), (0.0, 1e-4)):
        held = np.isin(every, vocabulary)
        rows, cols = owner[held], np.searchsorted(vocabulary, every[held])
        n, m = len(texts), len(vocabulary)
        weights, probe = np.zeros(m), np.ones(m)
        for _ in range(10):  # the largest eigenvalue, for the step
            probe = _sums(cols, (counts * _sums(rows, probe[cols], n))[rows], m)
            size = np.linalg.norm(probe) or 1.0
            probe /= size
        step = 1 / (0.25 * size / n * 1.1 + ridge + 1e-9) if m else 1.0
        ahead, pace = weights, 1.0
        for _ in range(rounds):
            by_z, by_steps = _loss_gradient(_sums(rows, ahead[cols], n), steps, grades, counts)
            new = ahead - step * (_sums(cols, by_z[rows], m) + ridge * ahead)
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
            steps = steps - 0.5 * by_steps
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead = new + (pace - 1) / faster * (new - weights)
            weights, pace = new, faster
        vocabulary = vocabulary[weights != 0] if penalty else vocabulary
    thresholds = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
    return Model(dict(zip(vocabulary.tolist(), weights.tolist())), thresholds.tolist())


def train(documents: DataFrame, labels: DataFrame, n_grades: int = 2, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", rows_per_grade: int = ROWS_PER_GRADE, bytes_per_grade: int = BYTES_PER_GRADE) -> Model:
    """A model of the labelled texts: of each grade, the rows_per_grade label rows whose hashed ids come first.

    Each takes one text, whatever the number of rows with its id: the one whose hash is smallest. The driver gets at most
    n_grades * rows_per_grade rows and n_grades * bytes_per_grade bytes of features. Rows that are fitted count for all label rows of their
    grade, so shares of grades don't depend on the number of labels. Rows with a null id, text or grade, or a grade outside
    0 .. n_grades - 1, aren't fitted; repeated label rows count as often as they stand there. Without rows the model is empty.
    """
    prepare(documents.sparkSession)
    rows = labels.select(labels[id_col].alias("__id"), labels[grade_col].cast("int").alias("__grade")).where("__id is not null")
    numbers = dict(rows.where(F.col("__grade").between(0, n_grades - 1)).groupBy("__grade").count().collect())
    picked = None
    for g in range(n_grades):
        some = rows.where(F.col("__grade") == g).orderBy(F.xxhash64("__id"), "__id").limit(rows_per_grade)
        picked = some if picked is None else picked.unionByName(some)
    picked = cut(picked)
    texts = documents.select(documents[id_col].alias("__id"), documents[text_col].alias("__text")).where("__text is not null")

    @F.pandas_udf("binary")
    def packed(column):
        return column.map(lambda t: np.array(sorted(features(t)), np.uint32).tobytes())

    held = texts.join(F.broadcast(picked.select("__id").distinct()), "__id")
    held = held.groupBy("__id").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))
    held = held.select("__id", packed("__text").alias("__features"))
    order = Window.partitionBy("__grade").orderBy(F.xxhash64("__id"), "__id")
    sized = held.join(F.broadcast(picked), "__id").withColumn("__bytes", F.sum(F.octet_length("__features")).over(order))
    sample = sized.where(F.col("__bytes") <= bytes_per_grade).select("__grade", "__features").collect()
    if not sample:
        return Model({}, [0.0] * (n_grades - 1))
    grades = np.array([r[0] for r in sample])
    fitted = np.bincount(grades, minlength=n_grades)
    stands = np.array([numbers.get(g, 0) / max(fitted[g], 1) for g in range(n_grades)])
    return fit([np.frombuffer(r[1], np.uint32) for r in sample], grades, n_grades, counts=stands[grades])


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade), grade (most probable), toxic (grade > 0).

    A null or empty text has no features and gets the model's base rates; repeated rows each get a row; an empty
    table gives an empty result; further columns are left aside.
    """
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, grade = model.predict(np.array([model.score(t.as_py()) for t in batch.column(1)], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "toxic"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return predict(documents, train(documents, read(spark, sf_dir, "labels")))
