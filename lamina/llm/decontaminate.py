"""Benchmark decontamination by latent semantic retrieval.

1. Passages are blocks of BLOCK words; their TF-IDF vectors have a dimension a hash bucket of words,
   with document frequencies counted over all passages of the corpus.
2. A randomised singular value decomposition of all passages: each task sums A'(A omega) over its
   passages, partial sums are added in two rounds of shuffles, and the Nystrom formula turns the sum
   (buckets by RANK numbers) into singular vectors.
3. Windows of two blocks are compared in the latent space with windows of the benchmark's items by
   cosine. Candidates are windows of a high cosine that share some words with the item, windows
   that share OVERLAP of the item's weight whatever their cosine (found by the item's rarest words, one of
   which they must hold), and all windows around an item's answer.
4. A candidate is a leak if the longest common subsequence of the item's words and the words around the
   window covers SURE of the item, or covers LIKELY of it and ANSWER_PART of the item's answer, its last
   words, in order: a paraphrase. By chance, less than half of an item is covered.
5. Items of fewer than LEAST_WORDS words leak where all their words stand in one piece.

All items are looked for in one pass over the documents. Words are runs of letters and digits, in lower
case for ASCII, and single characters of scripts written without blanks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import WordHashes, mix, slices

BLOCK = 16
BUCKETS = 8192
WEIGHT = 5
RANK = 32
COSINE = 0.5
OVERLAP = 0.4  # of the item's weight: a candidate
COMMON = 0.4  # of the item's words in a window of high cosine: a candidate
SURE = 0.6
LIKELY = 0.5
ANSWER = 5
ANSWER_PART = 4  # words of the answer
ITEMS = 1024  # items whose weights a task holds as a table at a time
LEAST_WORDS = 6
_PARTS = 16
_CHUNK = 1 << 16


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _blocks(owner: np.ndarray) -> np.ndarray:
    """First words of the blocks: every BLOCK words of a text from its start."""
    if not len(owner):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return np.flatnonzero(place % BLOCK == 0)


def _sum_parts(df: DataFrame, width: int) -> DataFrame:
    """Add vectors (part, salt, value: float64 bytes) part by part, in two rounds so that no task reads them all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("value"), strict=True):
                x = np.frombuffer(value.as_buffer(), np.float64)
                sums[part] = sums[part] + x if part in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "salt", "value"])

    kinds = "part int, salt int, value binary"
    return df.repartition("part", "salt").mapInArrow(add, kinds).repartition(_PARTS, "part").mapInArrow(add, kinds)


def _emit(total: np.ndarray, salt: int) -> pa.RecordBatch:
    pieces = np.array_split(total, _PARTS)
    return pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([salt] * _PARTS, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "salt", "value"])


def _gather(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum as one array: of a fixed size, BUCKETS by RANK at most."""
    rows = sorted((r.part, np.frombuffer(r.value, np.float64)) for r in _sum_parts(df, 0).select("part", "value").collect())
    return np.concatenate([v for _, v in rows]).reshape(shape) if rows else np.zeros(shape)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log(1 + passages / passages with the bucket), over all passages, to the power WEIGHT: so common words do not rule the space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, n = WordHashes(letters=True), np.zeros(BUCKETS + _PARTS), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, owner, _, _ = words(batch.column("text").to_pylist())
                starts = _blocks(owner)
                n += len(starts)
                kinds = np.sort(_padded(_buckets(hashes), starts).astype(np.int16).T, axis=1) if len(starts) else np.empty((0, BLOCK), np.int16)
                new = np.concatenate((np.ones((len(kinds), 1), bool), kinds[:, 1:] != kinds[:, :-1]), axis=1) & (kinds < BUCKETS)
                total[:BUCKETS] += np.bincount(kinds[new], minlength=BUCKETS)
        total[BUCKETS] = n
        if n:
            yield _emit(total, int(total.sum()) % 64)

    total = _gather(docs.select("text").mapInArrow(run, "part int, salt int, value binary"), (BUCKETS + _PARTS,))
    return np.log1p(max(1.0, total[BUCKETS]) / np.maximum(1, total[:BUCKETS])).astype(np.float32) ** WEIGHT


def _padded(buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BLOCK buckets a block; BUCKETS stands for no word."""
    size = np.diff(np.append(starts, len(buckets)))
    out = np.full((BLOCK, len(starts)), BUCKETS, np.int32)
    block = np.repeat(np.arange(len(starts)), size)
    out[np.arange(len(buckets)) - starts[block], block] = buckets
    return out


def _embed(padded: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Sums of the weighted rows of each block's words; the last row of weighted is zero."""
    out = weighted[padded[0]]
    for row in padded[1:]:
        out += weighted[row]
    return out


def _with_zero(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.zeros((1, *x.shape[1:]), x.dtype)))


def sketch(buckets: np.ndarray, starts: np.ndarray, idf: np.ndarray, weighted: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A omega) of these blocks, scaled to unit length, to total (RANK by BUCKETS)."""
    padded = _padded(buckets, starts)
    y = _embed(padded, weighted)
    y /= np.maximum(1e-12, _embed(padded, _with_zero(idf * idf)))[:, None]
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(buckets))))
    weight = idf[buckets]
    for column, row in zip(total, np.ascontiguousarray(y.T), strict=True):
        column += np.bincount(buckets, row[block] * weight, BUCKETS)


def latent_space(docs: DataFrame, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """BUCKETS by RANK right singular vectors of the passages' TF-IDF vectors (of unit length)."""
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, RANK)))[0].astype(np.float32)
    weighted = _with_zero(omega * idf[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, some = WordHashes(letters=True), np.zeros((RANK, BUCKETS)), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, owner, _, _ = words(batch.column("text").to_pylist())
                all_starts = _blocks(owner)
                marks = np.append(all_starts, len(owner))
                for i in range(0, len(all_starts), _CHUNK // BLOCK):
                    at = all_starts[i : i + _CHUNK // BLOCK]
                    end = marks[min(i + _CHUNK // BLOCK, len(all_starts))]
                    sketch(_buckets(hashes[at[0] : end]), at - at[0], idf, weighted, total)
                    some += end - at[0]
        if some:
            yield _emit(total.ravel(), some % 64)

    y = _gather(docs.select("text").mapInArrow(run, "part int, salt int, value binary"), (RANK, BUCKETS)).T
    return singular_vectors(y, omega) if y.any() else omega


def singular_vectors(y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Of A, from y = A'A omega, by the Nystrom formula with a small shift."""
    y = y / np.linalg.norm(y)
    shift = 1e-7
    y += shift * omega
    core = omega.T.astype(np.float64) @ y
    core = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.eye(RANK))
    return np.linalg.svd(np.linalg.solve(core, y.T).T, full_matrices=False)[0].astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, 64 and more places of b at a time in one integer."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & ones
    return len(b) - v.bit_count()


def _runs(hashes: np.ndarray, words: int = ANSWER) -> np.ndarray:
    """A hash of so many words from each word on."""
    n = len(hashes) - words + 1
    out = np.zeros(n, np.uint64)
    for j in range(words):
        out = mix(out + hashes[j : j + n])
    return out


class Searcher:
    """A block of benchmark items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, space: np.ndarray) -> None:
        self.idf, self.space, self.words = idf, space, WordHashes(letters=True)
        hashes, owner, _, _ = self.words([t for _, t in items])
        self.items, vectors, self.of = [], [], []
        self.short: dict[int, dict[int, list[tuple[int, list[int]]]]] = {}  # by number of words, then by their hash
        for i, (item, _) in enumerate(items):
            own = hashes[owner == i]
            if len(own) < LEAST_WORDS:
                if len(own):
                    self.short.setdefault(len(own), {}).setdefault(int(_runs(own, len(own))[0]), []).append((item, own.tolist()))
                continue
            for a in range(0, max(1, len(own) - BLOCK), BLOCK):
                part = own[a : a + 2 * BLOCK]
                vectors.append((space[_buckets(part)] * idf[_buckets(part)][:, None]).sum(axis=0))
                self.of.append(len(self.items))
            self.items.append((item, own.tolist()))
        self.vectors = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        self.vectors /= np.maximum(1e-9, np.linalg.norm(self.vectors, axis=1, keepdims=True))
        self.weighted = _with_zero(space * idf[:, None])
        self.of = np.array(self.of, np.int64)
        self.least = np.zeros(len(self.items), np.float32)
        self.fewest = np.zeros(len(self.items), np.float32)
        heads = []
        for i, (_, own) in enumerate(self.items):
            b = _buckets(np.array(own, np.uint64))
            self.least[i] = OVERLAP * idf[b].sum() * min(1, 2 * BLOCK / len(own))
            self.fewest[i] = COMMON * min(len(own), 2 * BLOCK)
            # without any of these the others, as often as in the item, do not reach the least
            kinds, times = np.unique(b, return_counts=True)
            order = np.argsort(-idf[kinds], kind="stable")
            rest = idf[b].sum() - np.cumsum((times * idf[kinds])[order])
            heads += [(bucket, i) for bucket in kinds[order[: 1 + np.count_nonzero(rest >= 0.999 * self.least[i])]].tolist()]
        heads = np.array(sorted(heads), np.int64).reshape(-1, 2)
        self.heads, self.head_ends = heads[:, 1], np.searchsorted(heads[:, 0], np.arange(BUCKETS + 2))
        self.first_vector = np.searchsorted(self.of, np.arange(len(self.items) + 1))
        self.answers: dict[int, list[int]] = {}
        for i, (_, own) in enumerate(self.items):
            self.answers.setdefault(int(_runs(np.array(own[-ANSWER:], np.uint64))[0]), []).append(i)
        self.answer_keys = np.array(sorted(self.answers), np.uint64)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each bucket in each item, and whether the item has it: made for a batch, as they are large."""
        mass = np.zeros((len(self.items), BUCKETS + 1), np.float32)
        has = np.zeros(mass.shape, np.uint8)
        for i, (_, own) in enumerate(self.items):
            b = _buckets(np.array(own, np.uint64))
            mass[i, b], has[i, b] = self.idf[b], 1
        return mass, has

    def _by_heads(self, padded: np.ndarray, joined: np.ndarray, n: int) -> np.ndarray:
        """Windows and items, as window * items + item, where one of the two blocks has one of the item's heads."""
        size = np.diff(self.head_ends)
        rows, block = np.nonzero(size[padded])
        bucket = padded[rows, block]
        block = np.repeat(block, size[bucket])
        at = np.repeat(self.head_ends[bucket], size[bucket]) + np.arange(len(block)) - np.repeat(np.cumsum(size[bucket]) - size[bucket], size[bucket])
        item = self.heads[at]
        before = (block > 0) & joined[np.maximum(block, 1) - 1] if len(joined) else np.zeros(len(block), bool)
        keys = np.concatenate((block * len(self.items) + item, (block[before] - 1) * len(self.items) + item[before]))
        keys = np.sort(keys[keys < n * len(self.items)])
        return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys

    def find(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, bool, int, int]]]:
        """For each text: item -> (cosine, covered share, answer found, first and end word of the place)."""
        out: list[dict[int, tuple[float, float, bool, int, int]]] = [{} for _ in texts]
        hashes, owner, _, _ = self.words(texts)
        self._find_short(out, hashes, owner)
        starts = _blocks(owner)
        if not len(starts) or not self.items:
            return out
        mass, has = self._tables()
        marks = np.append(starts, len(owner))
        whose = owner[starts]
        ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        firsts = np.searchsorted(owner, np.arange(len(texts)), side="left")
        step = _CHUNK // BLOCK
        for i in range(0, len(starts), step):
            last = min(len(starts), i + step + 1)  # one block more, for the last window
            at = starts[i:last]
            padded = _padded(_buckets(hashes[at[0] : marks[last]]), at - at[0])
            e = _embed(padded, self.weighted)
            joined = whose[i : last - 1] == whose[i + 1 : last]
            z = e.copy()
            z[:-1][joined] += e[1:][joined]
            z = z[: min(step, len(starts) - i)]
            z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
            near = z @ self.vectors.T
            wide = np.concatenate((padded, np.full((BLOCK, 1), BUCKETS, np.int32)), axis=1)  # a block of no words
            after = np.where(np.append(joined, False), np.arange(1, len(at) + 1), len(at))

            def over(w: np.ndarray, k: np.ndarray, of: np.ndarray, wide: np.ndarray = wide, after: np.ndarray = after) -> np.ndarray:
                flat, base, total = of.ravel(), k * (BUCKETS + 1), np.zeros(len(w), of.dtype)
                for block in (w, after[w]):
                    for row in wide:
                        total += flat.take(base + row.take(block))
                return total

            w, k = np.divmod(self._by_heads(padded, joined, len(z)), len(self.items))
            likely = over(w, k, mass) >= self.least[k]
            lw, lq = np.divmod(np.flatnonzero(near.ravel() >= COSINE), near.shape[1])
            lk = self.of[lq]
            like = over(lw, lk, has) >= self.fewest[lk]
            w, k = np.divmod(np.union1d((w * len(self.items) + k)[likely], (lw * len(self.items) + lk)[like]), len(self.items))
            for w, k in zip(w.tolist(), k.tolist(), strict=True):
                doc = int(whose[i + w])
                cosine = float(near[w, self.first_vector[k] : self.first_vector[k + 1]].max())
                self._judge(out[doc], k, hashes, int(starts[i + w]), int(firsts[doc]), int(ends[doc]), cosine)
        for at in np.flatnonzero(np.isin(_runs(hashes), self.answer_keys)).tolist() if len(hashes) >= ANSWER else ():
            doc = int(owner[at])
            if owner[at + ANSWER - 1] != doc:
                continue
            for k in self.answers[int(_runs(hashes[at : at + ANSWER])[0])]:
                length = len(self.items[k][1])
                for w in range(np.searchsorted(starts, max(int(firsts[doc]), at + ANSWER - 2 * BLOCK - length)), np.searchsorted(starts, min(int(ends[doc]), at + length + 1))):
                    window = _buckets(hashes[starts[w] : min(int(ends[doc]), int(starts[w]) + 2 * BLOCK)])
                    z = self.weighted[window].sum(axis=0)
                    vectors = self.vectors[self.of == k]
                    self._judge(out[doc], k, hashes, int(starts[w]), int(firsts[doc]), int(ends[doc]), float((vectors @ z).max() / max(1e-9, np.linalg.norm(z))))
        return out

    def _find_short(self, out: list[dict[int, tuple[float, float, bool, int, int]]], hashes: np.ndarray, owner: np.ndarray) -> None:
        for n, of_hash in self.short.items():
            if len(hashes) < n:
                continue
            keys = np.array(sorted(of_hash), np.uint64)
            for at in np.flatnonzero(np.isin(_runs(hashes, n), keys)).tolist():
                doc = int(owner[at])
                if owner[at + n - 1] == doc:
                    first = at - int(np.searchsorted(owner, doc, side="left"))
                    for item, own in of_hash[int(_runs(hashes[at : at + n], n)[0])]:
                        if hashes[at : at + n].tolist() == own:
                            out[doc].setdefault(item, (1.0, 1.0, True, first, first + n))

    def _judge(self, found: dict[int, tuple[float, float, bool, int, int]], k: int, hashes: np.ndarray, at: int, first: int, end: int, cosine: float) -> None:
        """Enter the item in found if the words around the window at `at`, of a text from first to end, leak it."""
        item, own = self.items[k]
        best = found.get(item)
        if best is not None and best[1] >= 1:
            return
        low, high = max(first, at - len(own)), min(end, at + 2 * BLOCK + len(own))
        place = hashes[low:high].tolist()
        there = set(place)
        if sum(x in there for x in own) < LIKELY * len(own):
            return
        share = common_subsequence(place, own) / len(own)
        whole = share >= LIKELY and common_subsequence(place, own[-ANSWER:]) >= ANSWER_PART
        if (share >= SURE or whole) and (best is None or share > best[1]):
            found[item] = (cosine, share, whole, low - first, high - first)


_READY: dict[str, list[Searcher]] = {}  # of the worker's last broadcast


def _searchers(told) -> list[Searcher]:  # noqa: ANN001
    name, blocks, idf, space = told.value
    if name not in _READY:
        _READY.clear()
        _READY[name] = [Searcher(b, idf, space) for b in blocks]
    return _READY[name]


def _find_all(searchers: list[Searcher], texts: list[str | None]) -> list[dict[int, tuple[float, float, bool, int, int]]]:
    out: list[dict[int, tuple[float, float, bool, int, int]]] = [{} for _ in texts]
    for s in searchers:
        for one, more in zip(out, s.find(texts), strict=True):
            for item, found in more.items():
                if item not in one or found[1] > one[item][1]:
                    one[item] = found
    return out


def _prepare(docs: DataFrame, benchmark: DataFrame):  # noqa: ANN202
    """A broadcast of the items, in blocks, the frequencies and the singular vectors; None where there are no items. The driver holds the benchmark's texts."""
    rows = [(r[0], r[1]) for r in benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct().toLocalIterator()]
    if not rows:
        return None
    idf = inverse_frequencies(docs)
    space = latent_space(docs, idf)
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(map(list, batched(sorted(rows), ITEMS))), idf, space))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, covered, answer, first_word, end_word: a row for each item that a row of docs leaks.

    Null and empty texts leak nothing; an item without words, or with a null id, leaks nowhere. Repeated rows are searched
    each, repeated items once; items that share an id are one, and the one covered best tells the place (of ties the first
    found). Ids may be of any type. Empty tables give no row. Extra columns are not read.
    """
    docs = docs.select("doc_id", "text")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, cosine double, covered double, answer boolean, first_word long, end_word long"
    told = _prepare(docs, benchmark)
    if told is None:
        return docs.sparkSession.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "cosine", "covered", "answer", "first_word", "end_word"]
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(doc, item, *found) for doc, got in zip(batch.column("doc_id").to_pylist(), _find_all(_searchers(told), batch.column("text").to_pylist()), strict=True) for item, found in got.items()]
                if rows:
                    ids = [pa.array([r[0] for r in rows], batch.column("doc_id").type), pa.array([r[1] for r in rows])]
                    yield pa.RecordBatch.from_arrays(ids + [pa.array([r[i] for r in rows]) for i in range(2, 7)], names=names)

    return docs.mapInArrow(run, kinds)


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text leaks no item of the benchmark. Extra columns stay, whatever their names; null texts stay."""
    at = docs.columns.index("text")
    told = _prepare(docs.select("text"), benchmark)
    if told is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array([not got for got in _find_all(_searchers(told), batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
