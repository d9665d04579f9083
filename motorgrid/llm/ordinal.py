"""Ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature, shared by all grades, and ordered thresholds t1 < t2 < ...:
P(grade > k) = sigmoid(w.x - t_k). From these come the expected grade and the tail probability
P(grade >= wanted), by which documents are selected. The model is fitted on the driver from a bounded
sample of rated documents; scoring runs over all documents with the weight table in the task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rated documents that the model is fitted on at most, chosen by a hash of the doc_id.
FIT_ROWS = 12_000
HASHES = 1 << 30
BITS = 18
# Features of fewer documents of the sample carry no weight.
LEAST_DOCS = 6
STYLES = 64
EPOCHS = 150
RIDGE = 2e-4
GRADES = 3
WANTED = 2
TAIL = 0.5
_EDGES = b".,;:!?\"'()[]"
_SYMBOL = re.compile(rb"[#*$%&|<>@{}\\^~_=+]")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _step(value: float, cuts: tuple[float, ...]) -> int:
    return sum(value >= c for c in cuts)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted buckets of the distinct words, and of style steps (the first ``STYLES`` buckets)."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words = data.split()
    distinct = {w.strip(_EDGES) for w in words}
    n = max(1, len(words))
    lines = data.split(b"\n")
    doubled = sum(a == b for a, b in zip(words, words[1:])) / n
    styles = (
        _step(len(words), (1, 10, 20, 40, 80, 200, 600)),
        8 + _step(len(distinct) / n, (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9)),
        16 + _step(len(_SYMBOL.findall(data)) / n, (0.005, 0.02, 0.05, 0.1, 0.3, 1.0, 2.0)),
        24 + _step(doubled, (0.002, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7)),
        32 + _step(1 - len(set(lines)) / len(lines), (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)),
        40 + _step(len(data) / n, (3, 4, 5, 6, 7, 8, 12)),
    )
    room = (1 << bits) - STYLES
    crc = zlib.crc32
    hashed = {STYLES + crc(w) % room for w in distinct if w}
    return np.array(sorted(hashed.union(styles)), np.int64)


def fit(rows: list[np.ndarray], grades: np.ndarray, count: int = GRADES, bits: int = BITS,
        epochs: int = EPOCHS, ridge: float = RIDGE, least_docs: int = LEAST_DOCS) -> Model:
    """Maximum likelihood by Adam over all rows at once; thresholds are a first value and positive
    steps, so they stay ordered. Without rows every weight is zero."""
    size = 1 << bits
    weights = np.zeros(size)
    steps = np.linspace(-1.0, 1.0, count - 1) if count > 1 else np.zeros(0)
    theta = np.concatenate((steps[:1], np.log(np.diff(steps)))) if count > 1 else steps
    if not rows:
        return Model(weights.astype(np.float32), steps)
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    common = np.bincount(flat, minlength=size) >= least_docs
    common[:STYLES] = True
    kept = common[flat]
    flat, owner = flat[kept], owner[kept]
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    moments = [np.zeros(len(used) + len(theta)) for _ in range(2)]
    for epoch in range(1, epochs + 1):
        cuts = np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))))
        score = np.bincount(owner, w[flat], minlength=len(rows))
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
        full = np.hstack((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))))
        at = np.arange(len(rows))
        upper, lower = full[at, grades], full[at, grades + 1]
        # d log(upper - lower) / d score, and by each cut.
        slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
        p = np.maximum(upper - lower, 1e-12)
        by_score = (slope_u - slope_l) / p
        by_cut = np.zeros((len(rows), count + 1))
        by_cut[at, grades] -= slope_u / p
        by_cut[at, grades + 1] += slope_l / p
        by_cuts = by_cut[:, 1:count].sum(axis=0)
        by_theta = np.concatenate((
            [by_cuts.sum()], [by_cuts[k:].sum() * np.exp(theta[k]) for k in range(1, count - 1)]))
        gradient = np.concatenate((
            np.bincount(flat, by_score[owner], minlength=len(used)) / len(rows) - ridge * w,
            by_theta / len(rows)))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.08 * (moments[0] / (1 - 0.9**epoch)) / (
            np.sqrt(moments[1] / (1 - 0.99**epoch)) + 1e-6)
        w += move[:len(used)]
        theta = theta + move[len(used):]
    weights[used] = w
    return Model(weights.astype(np.float32),
                 np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:])))))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where the labels are missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def fit_on(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS, count: int = GRADES) -> Model:
    """Fit on at most ``rows`` of ``ratings`` (doc_id, grade), chosen by a hash of the doc_id.

    A document rated more than once counts with its lowest grade; rows without doc_id or grade, and
    ratings of absent documents, are passed over.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(
        F.min("grade").cast("int").alias("grade"))
    # Thinned by a hash first, so that no task sends more than its share of the sample.
    share = min(1.0, 1.2 * rows / max(1, rated.count()))
    thin = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < int(HASHES * share))
    chosen = thin.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).astype(np.int32) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"),
                 pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])

    # At most ``rows`` short rows are broadcast and come back to the driver.
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", F.col("text").alias("_text")).join(
        F.broadcast(chosen), "doc_id").select("doc_id", "grade", "_text").mapInArrow(
        extract, f"doc_id {kind}, grade int, features array<int>").toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    lists = sample.column("features").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    grades = sample.column("grade").to_numpy()[order].astype(np.int64)
    return fit([values[offsets[i]:offsets[i + 1]].astype(np.int64) for i in order], grades, count)


def _scorer(model: Model, wanted: int, tail: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, expected, likely = [], [], []
            for text in batch.column("_text"):
                score = model.score(features(text.as_py()))
                tails = model.tails(score)
                scores.append(score)
                expected.append(float(tails.sum()))
                likely.append(float(tails[wanted - 1]) if wanted else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()),
                 pa.array(expected, pa.float64()), pa.array(likely, pa.float64()),
                 pa.array([p >= tail for p in likely], pa.bool_())],
                names=["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    return run


def rate(docs: DataFrame, model: Model, wanted: int = WANTED, tail: float = TAIL) -> DataFrame:
    """score, expected_grade, tail_probability P(grade >= wanted) and kept per row of ``docs``.

    Null and empty texts have style features only. Rows are rated on their own: repeated rows get
    equal results, an empty table none; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(
        _scorer(model, wanted, tail), f"doc_id {kind}, score double, expected_grade double, "
        "tail_probability double, kept boolean")
