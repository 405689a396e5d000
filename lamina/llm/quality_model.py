"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = logistic(score - threshold_k) with one score for all grades, the weighted sum of a
text's hashed words, and ordered thresholds. The expected grade is the sum of the tail probabilities.
Grades come from labels: 0 for toxic, 1 for plain low quality, 2 for good. The model is fitted on a
bounded sample of labelled documents, about `per_grade` of each grade, drawn by a hash of id and text.

Features of a whole text: square roots of hashed word counts, of unit length, and shares of letters in
upper case, symbols, digits and repeated words. Words are runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import WordHashes, cut, slices, small

DIMENSIONS = 1 << 18
EXTRA = 6
PER_GRADE = 3000
Vector = tuple[np.ndarray, np.ndarray]


class Features:
    """Vectors of whole texts: columns and values; the last EXTRA columns are shares."""

    def __init__(self) -> None:
        self.hashes = WordHashes(letters=True)

    def __call__(self, texts: list[str | None]) -> list[Vector]:
        hashes, owner, _, _ = self.hashes(texts)
        key = owner.astype(np.uint64) << np.uint64(20) | (hashes >> np.uint64(44)) & np.uint64(DIMENSIONS - 1)
        key, count = np.unique(key, return_counts=True)
        whose, column = (key >> np.uint64(20)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int32)
        norm = np.sqrt(np.bincount(whose, count, len(texts)))
        value = (np.sqrt(count) / norm[whose]).astype(np.float32) if len(key) else np.empty(0, np.float32)
        marks = np.searchsorted(whose, np.arange(len(texts) + 1))
        total = np.bincount(owner, minlength=len(texts))
        out = []
        for i, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            size, n = max(1, len(raw)), max(1, int(total[i]))
            kinds = np.bincount(_KIND[raw], minlength=4)
            new = (marks[i + 1] - marks[i]) / n
            shares = np.array([2 * kinds[1] / size, kinds[2] / n, kinds[3] / size, 1 - new if total[i] else 0, 10 / n, len(raw) / n / 20], np.float32)
            a, b = marks[i], marks[i + 1]
            out.append((np.concatenate((column[a:b], _LAST)), np.concatenate((value[a:b], np.minimum(shares, 1)))))
        return out


_KIND = np.zeros(256, np.uint8)  # upper-case letters, symbols, digits
_KIND[65:91] = 1
_KIND[list(b"#*$%&|<>!")] = 2
_KIND[48:58] = 3
_LAST = np.arange(DIMENSIONS, DIMENSIONS + EXTRA, dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        score = float(self.weights[columns] @ values)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, decay: float = 1e-5, rounds: int = 250) -> Model:
    """Adam on the mean log-likelihood; the thresholds are a first one and positive gaps, so they keep their order."""
    at = np.concatenate([np.full(len(c), i) for i, (c, _) in enumerate(rows)])
    columns = np.concatenate([c for c, _ in rows])
    values = np.concatenate([v for _, v in rows]).astype(np.float64)
    n, k = len(rows), levels - 1
    weights, first, gaps = np.zeros(DIMENSIONS + EXTRA), np.zeros(1), np.zeros(max(0, k - 1))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, first, gaps)]
    share = 1 / (levels * np.maximum(1, np.bincount(grades, minlength=levels)))[grades]
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate((first, np.log1p(np.exp(gaps)))))
        score = np.bincount(at, values * weights[columns], n)
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
        upper = np.hstack((np.ones((n, 1)), tail))
        lower = np.hstack((tail, np.zeros((n, 1))))
        i = np.arange(n)
        p = np.maximum(upper[i, grades] - lower[i, grades], 1e-9)
        slope = np.hstack((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))))
        d_score = -share * (slope[i, grades] - slope[i, grades + 1]) / p
        d_theta = np.zeros(k)
        for j in range(k):  # threshold j bounds grade j from above and grade j+1 from below
            s = tail[:, j] * (1 - tail[:, j])
            d_theta[j] = (share / p * s * ((grades == j + 1).astype(float) - (grades == j))).sum()
        grads = (np.bincount(columns, values * d_score[at], DIMENSIONS + EXTRA) + decay * weights, np.array([d_theta.sum()]), np.array([d_theta[j + 1 :].sum() for j in range(k - 1)]) / (1 + np.exp(-gaps)))
        for param, grad, (m, v) in zip((weights, first, gaps), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, np.cumsum(np.concatenate((first, np.log1p(np.exp(gaps))))))


LEVELS = 3


def grade(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 not toxic and of low quality, 2 good. Repeated labels of a document: the lowest. Nulls: no grade."""
    value = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", value.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> Model | None:
    """A model of a bounded sample of labelled documents; None without labelled documents."""
    graded = cut(grade(labels), "grades")
    # documents are known by id and text: a repeated one counts once, and what reaches the driver is bounded by rows, not ids
    key = F.xxhash64(F.lit(13), "doc_id", "text")
    there = docs.select(F.col("doc_id").alias("_id"), key.alias("_key")).join(small(graded), F.col("_id") == F.col("doc_id")).select("_key", "grade").distinct()
    there = cut(there, "labelled")
    share = F.least(F.lit(1.0), F.lit(float(per_grade)) / F.col("count"))
    draw = F.shiftrightunsigned("_key", 11).cast("double") * 2.0**-53
    picked = there.join(F.broadcast(there.groupBy("grade").count()), "grade").where(draw < share).select(F.col("_key").alias("_picked"), "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in slices(whole, "text"):
                got = features(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("grade"), pa.array([c.tobytes() for c, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                    names=["doc_id", "grade", "c", "v"],
                )

    rows = docs.select("text", key.alias("doc_id")).join(small(picked), F.col("doc_id") == F.col("_picked")).select("doc_id", "text", "grade")
    rows = rows.mapInArrow(run, "doc_id long, grade int, c binary, v binary").dropDuplicates(["doc_id"]).toArrow()  # about per_grade rows a grade
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("c", "ascending")])
    vectors = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(rows.column("c").to_pylist(), rows.column("v").to_pylist(), strict=True)]
    return fit(vectors, np.array(rows.column("grade").to_pylist()), LEVELS)


def rate(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, per_grade: int = PER_GRADE) -> DataFrame:
    """A row per row of docs: doc_id, expected_grade (0 to 2), p_not_toxic (grade >= 1), p_good (grade >= 2), kept.

    kept: p_not_toxic and p_good both reach least_tail. Null texts count as empty. Without labelled
    documents the probabilities are null and everything is kept. Labels of unknown documents and null ids are passed
    over; of several labels of a document the lowest grade counts. Ids may be of any type that labels share. Repeated
    rows have a row each; an empty table has none. Extra columns are not read.
    """
    model = train(docs, labels, per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in slices(whole, "text"):
                tails = [model.tails(*x) if model else (None, None) for x in features(batch.column("text").to_pylist())]
                one, two = ([None if t[k] is None else float(t[k]) for t in tails] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([None if a is None else a + b for a, b in zip(one, two, strict=True)], pa.float64()), pa.array(one, pa.float64()), pa.array(two, pa.float64()), pa.array([a is None or (a >= least_tail and b >= least_tail) for a, b in zip(one, two, strict=True)], pa.bool_())],
                    names=["doc_id", "expected_grade", "p_not_toxic", "p_good", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, p_not_toxic double, p_good double, kept boolean")
