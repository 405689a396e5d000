"""Token counts by dynamic programming over prefixes.

The tokenizer parts a text at white space before it merges anything, so the count of a prefix is the
count after the last whole word plus that of the part of a word behind it. `PrefixCounter.table` holds
the exact count at every prefix of a text, code point by code point: a word's running count comes from
the previous word's, and the counts of a word's own prefixes come from a memo, in which each word is
worked out once a worker. Truncation and budget questions are look-ups in these counts. Words and their
prefixes are encoded by the tokenizer itself, so special strings, normalisation, word-end marks and odd
white space within a word are as the library has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import slices

MEMO_WORDS = 1_000_000
KEPT = 64  # code points of the longest word that the memos keep
ALL_PREFIXES = 512  # code points of the longest word of which truncate() counts every prefix
AROUND = 96  # in longer words, it counts the prefixes that end within so many code points of where the budget runs out
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\r\x0b\x0c"
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


class PrefixCounter:
    """Exact token counts of prefixes. encode_lengths: token counts of a list of strings."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            raise ValueError("a sentencepiece model does not part texts at white space; use a .json tokenizer that does")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        probe = ["a", "b. ", "é\t"]
        if sum(self._lengths(probe)) != self._lengths(["".join(probe[1:2]) + probe[0] + " " + probe[2]])[0]:
            raise ValueError(f"{path} keeps white space as tokens; counts of words do not add up")
        self.memo: dict[str, int] = {}
        self.prefixes: dict[str, np.ndarray] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode, once each, the words that the memo lacks, but for very long ones."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in set().union(*texts).difference(self.memo) if len(w) <= KEPT]
        self.memo.update(zip(new, self._lengths(new), strict=True))

    def words(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        memo = self.memo
        try:
            return [memo[w] for w in words]
        except KeyError:
            self.learn([words])
            new = list({w for w in words if w not in memo})
            more = dict(zip(new, self._lengths(new), strict=True))
            return [memo[w] if w in memo else more[w] for w in words]

    def ends_within(self, word: str, low: int, high: int) -> np.ndarray:
        """Tokens of the word's prefixes of low to high - 1 code points."""
        out, held = [], []
        for end in range(low, high):
            held.append(word[:end])
            if len(held) * end > 1 << 20:
                out += self._lengths(held)
                held = []
        return np.array(out + self._lengths(held), np.int64)

    def inside(self, word: str) -> np.ndarray:
        """Tokens of every prefix of a word, from one code point to all of it. Time grows with the square of its length."""
        got = self.prefixes.get(word)
        if got is None:
            got = self.ends_within(word, 1, len(word) + 1)
            if len(word) <= KEPT:
                if len(self.prefixes) > MEMO_WORDS // 10:
                    self.prefixes.clear()
                self.prefixes[word] = got
        return got

    @staticmethod
    def split(text: str) -> list[str]:
        words = _BLANK.split(text)
        if not words[0]:
            words = words[1:]
        if words and not words[-1]:
            words.pop()
        return words

    def counts(self, words: list[str]) -> np.ndarray:
        """Running counts after each word: the last is the count of all."""
        return np.cumsum(self.words(words), dtype=np.int64) if words else np.empty(0, np.int64)

    def total(self, text: str) -> tuple[int, np.ndarray]:
        """Tokens of the text, and the running counts after each of its words."""
        counts = self.counts(self.split(text))
        return (int(counts[-1]) if len(counts) else 0), counts

    def table(self, text: str) -> np.ndarray:
        """The tokens of text[:i] for i from 0 to all code points."""
        out, done, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for m, total in zip(_WORD.finditer(text), self.total(text)[1].tolist(), strict=True):
            out[at : m.start() + 1] = done
            out[m.start() + 1 : m.end() + 1] = done + self.inside(m.group())
            done, at = total, m.end() + 1
        out[at:] = done
        return out

    def prefix(self, text: str, end: int, table: np.ndarray | None = None) -> int:
        """Tokens of text[:end]: a look-up."""
        return int((self.table(text) if table is None else table)[end])

    def truncate(self, text: str, budget: int, counts: np.ndarray | None = None) -> int:
        """Code points of the longest prefix of at most `budget` tokens, without blanks at its end. counts: after each word, where known.

        In a word of more than ALL_PREFIXES code points only prefixes are tried that end within AROUND of where the budget runs out.
        """
        counts = self.total(text)[1] if counts is None else counts
        k = int(np.searchsorted(counts, budget, side="right"))
        at = 0
        for i, m in enumerate(_WORD.finditer(text)):
            if i == k:
                left, word = budget - (int(counts[k - 1]) if k else 0), m.group()
                low, high = 1, len(word)
                if len(word) > ALL_PREFIXES:
                    spans = self.tokenizer.encode(word, add_special_tokens=False).offsets
                    near = spans[min(left, len(spans)) - 1][1] if left else 0
                    low, high = max(1, near - AROUND), min(len(word), near + AROUND)
                fits = np.flatnonzero((self.inside(word)[: high - 1] if low == 1 and len(word) <= ALL_PREFIXES else self.ends_within(word, low, high)) <= left)
                return m.start() + low + int(fits[-1]) if len(fits) else at
            at = m.end()
        return at


def token_counts(docs: DataFrame, path: str, limit: int = 2048, tables: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens, over_limit, words_in_limit and chars_in_limit (whole words, and code points, of the longest prefix within the limit).

    tables: also prefix_tokens, the tokens of every prefix, code point by code point. A null text counts as empty: 0
    bytes, 0 tokens. Texts are never cut. Repeated rows and null ids have a row each. Extra columns are not read; an
    empty table gives no row.
    """
    extra = ", prefix_tokens array<long>" if tables else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                n_bytes, n_tokens, fit, chars, sums = [], [], [], [], []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                split = [counter.split(t) for t in texts]
                counter.learn(split)
                for text, words in zip(texts, split, strict=True):
                    counts = counter.counts(words)
                    n = int(counts[-1]) if len(counts) else 0
                    n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                    n_tokens.append(n)
                    fit.append(int(np.searchsorted(counts, limit, side="right")))
                    chars.append(counter.truncate(text, limit, counts) if n > limit else len(text.rstrip(BLANKS)))
                    if tables:
                        sums.append(counter.table(text).tolist())
                out = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64()), pa.array(chars, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "words_in_limit", "chars_in_limit"]
                if tables:
                    out.append(pa.array(sums, pa.list_(pa.int64())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, words_in_limit long, chars_in_limit long" + extra)
