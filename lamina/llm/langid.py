"""Language identification in two levels.

Languages are gathered into families by how alike their letter sequences are (average linkage on the
cosine of the languages' mean vectors). A linear one-against-rest support vector machine over families
predicts the family first; within it, one-versus-one linear support vector machines tell closely
related languages apart, by votes and then by margins.

Features are counts of hashed runs of one to three letters of the whole text, square roots taken, of
unit length. The machines are fitted on a bounded sample: about `per_language` labelled documents of
each language and ROWS_IN_ALL together, drawn by hash from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, slices, small

DIMENSIONS = 2048
PER_LANGUAGE = 600
ROWS_IN_ALL = 24_000  # 4 kB each on the driver
FAMILY_COSINE = 0.55
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that a model must not learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """The unit vector of a whole text (zero if it holds no letter)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes[codes < 128]
    ascii_only = len(low) == len(codes)
    letter = (codes >= 97) & (codes <= 122)
    if not ascii_only:
        other = codes[codes >= 128]
        known = np.unique(other)
        letters = known[[chr(c).isalpha() for c in known.tolist()]]
        letter |= np.isin(codes, letters)
    c = np.where(letter, codes, 32).astype(np.uint32)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    c = c[np.concatenate(([True], ~((c[1:] == 32) & (c[:-1] == 32))))]
    if len(c) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    with np.errstate(over="ignore"):
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    count = sum(np.bincount(x >> shift, minlength=DIMENSIONS) for x in (one, two, three)).astype(np.float32)
    count = np.sqrt(count)
    return count / np.linalg.norm(count)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; y is 1 or -1. Nesterov's method, full batch."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    y, share = y.astype(x.dtype), share.astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    rate = x.dtype.type(1.0 / (1.0 + 2 * cost * 2.0))
    cost = x.dtype.type(cost)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (v - 2 * cost * (x.T @ (share * y * slack)))
        v = step + x.dtype.type(k / (k + 3)) * (step - w)
        w = step
    return w


@dataclass
class Model:
    families: list[list[str]]
    of_family: np.ndarray  # a row a family
    pairs: dict[tuple[str, str], np.ndarray]  # positive margins speak for the first

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row; the score is the share of the winning family and language among their rivals."""
        x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
        margins = x @ self.of_family.T
        odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        best = margins.argmax(axis=1)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(x)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(languages)))
            sure = np.zeros_like(votes)
            for (a, b), w in self.pairs.items():
                if a in languages and b in languages:
                    m = 1 / (1 + np.exp(-4 * (x[rows] @ w)))
                    i, j = languages.index(a), languages.index(b)
                    votes[:, i] += m > 0.5
                    votes[:, j] += m <= 0.5
                    sure[:, i] += m
                    sure[:, j] += 1 - m
            rivals = max(1, len(languages) - 1)
            won = (votes + sure / (rivals + 1)).argmax(axis=1) if len(languages) > 1 else np.zeros(len(rows), int)
            for r, k in zip(rows, won, strict=True):
                inner = sure[np.searchsorted(rows, r), k] / rivals if len(languages) > 1 else 1.0
                out[r] = (languages[k], float(min(1.0, max(0.0, odds[r, f] * inner))))
        return out


def group_families(means: dict[str, np.ndarray], least: float = FAMILY_COSINE) -> list[list[str]]:
    """Languages whose mean vectors (less the mean of all) are alike, merged by average linkage while the cosine is positive enough."""
    names = sorted(means)
    groups = [[n] for n in names]
    unit = {n: m / max(1e-12, np.linalg.norm(m)) for n, m in means.items()}
    alike = lambda a, b: float(np.mean([unit[i] @ unit[j] for i in a for j in b]))
    while len(groups) > 2:
        score, i, j = max((alike(a, b), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2))
        if score < least:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def fit(x: np.ndarray, y: list[str], families: list[list[str]] | None = None) -> Model:
    y = np.array(y)
    means = {n: x[y == n].mean(axis=0) for n in sorted(set(y.tolist()))}
    families = families or group_families(means)
    rows = [np.isin(y, f) for f in families]
    if len(families) == 1:
        of_family = np.zeros((1, x.shape[1] + 1))
    else:
        of_family = np.array([fit_svm(x, np.where(r, 1.0, -1.0)) for r in rows])
    pairs = {}
    for family in families:
        for a, b in combinations(family, 2):
            own = (y == a) | (y == b)
            pairs[a, b] = fit_svm(x[own], np.where(y[own] == a, 1.0, -1.0))
    return Model(families, of_family, pairs)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """text and lang of about per_language labelled rows of each language that may be learned from (fewer where ROWS_IN_ALL languages share them).

    A row is drawn by a hash of its id and text; rows that repeat both are drawn, or not, together and count once.
    """
    key = F.xxhash64(F.lit(11), "doc_id", "text")
    free = docs.select("text", "lang", held_out(F.col("doc_id")).alias("_held"), key.alias("_key")).where(~F.col("_held") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = cut(free.groupBy("lang").count(), "languages")
    most = min(float(per_language), ROWS_IN_ALL / max(1, counts.count()))
    draw = F.shiftrightunsigned("_key", 11).cast("double") * 2.0**-53
    told = small(counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(most) / F.col("count")).alias("_share")))
    return free.join(told, F.col("lang") == F.col("_lang")).where(draw < F.col("_share")).select("text", "lang", "_key").dropDuplicates(["_key", "lang"]).drop("_key")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the documents that are not held out; None where none has a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = [(features(t) * 65535).astype(np.uint16).tobytes() if has_letter(t) else None for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("lang")], names=["x", "lang"])

    rows = sample(docs, per_language).mapInArrow(run, "x binary, lang string").where("x is not null").toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort((rows.column("x").to_pylist(), rows.column("lang").to_pylist()))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint16).reshape(-1, DIMENSIONS).astype(np.float32) / 65535
    return fit(x[order], [rows.column("lang")[int(i)].as_py() for i in order])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred and score (0 to 1).

    Learned from text and lang of rows that are not held out; a null doc_id counts as held out. A text
    that is null or has no letter gets `und` and 0, as does every text when there is nothing to learn from. Ties of
    votes and margins go to the first language in order. Repeated rows have a row each; an empty table has none.
    Extra columns are not read.
    """
    model = train(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                rows = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
                out = [(UNKNOWN, 0.0)] * len(texts)
                if rows:
                    for i, got in zip(rows, model.predict(np.array([features(texts[i]) for i in rows])), strict=True):
                        out[i] = got
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
