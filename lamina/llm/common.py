"""What the operators of this package share: intermediate tables, batches, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000
_BASE = 0x9E3779B97F4A7C15  # any odd number has an inverse modulo 2^64
_M64 = (1 << 64) - 1
# fixed values: Thai, Lao, Burmese, Khmer, kana and Han
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a new local folder if the master is this machine alone; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors on several machines need a folder they share")
        base = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is known to have few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The whole row in one column `_row`, beside the columns named: names given to new columns cannot clash with the caller's."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row"), *names)


def unpacked(like: DataFrame, **new: Column) -> list[Column]:
    """The caller's columns out of `_row`, some of them replaced."""
    return [(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in like.columns]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes in one text column; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2^64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of all words of many texts at once, ASCII letters in lower case.

    A word's hash is its polynomial in an odd base modulo 2^64, taken from a running sum over
    the bytes, then mixed; words are runs of bytes other than ASCII white space.
    """

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)

    def __init__(self, letters: bool = False) -> None:
        """letters: words are runs of ASCII letters and digits and of all bytes beyond ASCII, and single characters of scripts written without blanks."""
        self.letters = letters
        self.up = self.down = np.ones(1, np.uint64)
        self.between = np.zeros(256, bool)
        self.between[[9, 10, 11, 12, 13, 32]] = True
        if letters:
            self.between[:128] = [not chr(b).isalnum() for b in range(128)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hash, index of the text, first byte and end byte (within the joined texts) of every word."""
        raw = [(t or "").encode() for t in texts]
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if self.letters and len(buf) and buf.max() >= 0xE0:  # perhaps scripts without blanks: their characters are words
            raw = [r if r.isascii() else _UNSPACED.sub(r" \1 ", t).encode() for r, t in zip(raw, texts, strict=True)]
            buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self._powers(len(buf) + 1)
        white = self.between[buf]
        edge = np.diff(np.concatenate(([True], white, [True])).view(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        low = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], dtype=np.uint64)))
            hashes = mix((sums[last] - sums[first]) * self.down[first])
        begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))[:-1]
        owner = np.searchsorted(begins, first, side="right") - 1
        return hashes, owner, first - begins[owner] if len(first) else first, last - begins[owner] if len(first) else last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
