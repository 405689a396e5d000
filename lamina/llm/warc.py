"""WARC archives in which every record is a Zstandard frame of its own, primed by a dictionary.

An archive's dictionary is built from all the records it holds and stored at its head, itself
compressed, in a skippable frame (magic 0x184D2A5D). Every record can be read alone, given the head.

Payloads are told apart by their SHA-1. Of records with equal payloads the one with the smallest
page_id is the response (null ids come last), and the others are revisit records that name it; so
payloads are stored once.

Each task writes archives of a bounded size under a name of its own and returns their paths; the
paths reach a manifest by Spark's commit protocol, so of an attempt that was lost or ran twice only
one is in the manifest, and readers read what the manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, scratch, slices, small

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16_000_000  # of records before compression; what a task holds
READ_BYTES = 1_000_000_000  # of records before compression that a task reads back, one archive after the other
DICTIONARY_BYTES = 65_536
SEGMENT_BYTES = 1024  # of the records' pieces a dictionary is made of; None searches for the best length, takes five times the time and saves 0.1 %
MIN_PAYLOAD = 0  # smaller payloads are never revisits


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # 20 bytes: no padding


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, segment: int | None = SEGMENT_BYTES) -> bytes:
    """A dictionary of at most `size` bytes from all records; where there are too few to train on, their own first bytes.

    segment: bytes of a piece that a dictionary is made of; None: the trainer searches for the best length.
    """
    total = sum(map(len, records))
    if not total:
        return b""
    try:
        size = min(size, max(1024, total // 10))
        pieces = {"k": min(segment, size // 4), "d": 8} if segment else {"steps": 4, "threads": 1}
        return zstandard.train_dictionary(size, records, level=9, **pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(1, size // len(records))] for r in records)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None


def write_archive(out, records: list[bytes], level: int = 9, segment: int | None = SEGMENT_BYTES) -> None:  # noqa: ANN001
    raw = build_dictionary(records, segment=segment)
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_checksum=True)
    for record in records:
        out.write(compressor.compress(record))


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the head of the archive")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 24)
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    rest = memoryview(data)[8 + size :]
    while rest:
        one = decompressor.decompressobj()
        record = one.decompress(rest)
        used = len(rest) - len(one.unused_data)
        yield record
        rest = rest[used:]


def _line(value: object) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(kind: str, page_id: int | str | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | str | None, date: str, alone: bool = False) -> bytes:
    """One record: a response with its payload, or a revisit, whose HTTP head tells the payload's length.

    The response of a payload is named by its digest, so revisits can name it; other records have random names
    (and so has a response that is `alone`, which none revisits). No two records share a name.
    """
    first = uuid.uuid5(uuid.NAMESPACE_URL, f"sha1:{digest}").urn
    revisit = kind == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{uuid.uuid4().urn if revisit or alone else first}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_line(url)}"]),
        *([] if page_id is None else [f"X-Page-ID: {_line(page_id)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([] if refers_to is None else [f"X-Refers-To-Page-ID: {_line(refers_to)}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC head, HTTP head and payload of a record; raises if lengths do not agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file:" + path.removeprefix("file:"))


def plan_revisits(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, html (null for revisits), _length, _digest, _kind (response or revisit), _refers (the response's page_id) and _alone of every row of pages.

    What is shuffled for it are digests and ids. Payloads are shuffled once only where those that repeat are too many to broadcast.
    The response of equal payloads is the row of the smallest (page_id, url), nulls last; rows that are equal in all
    of these are one response and revisits of it.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("_length"), F.sha1(html.cast("binary")).alias("_digest"))
    slim = pages.where(F.col("_length") >= least).groupBy("_digest", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("null_last"), "page_id", "n")
    again = slim.groupBy("_digest").agg(F.sum("n").alias("all"), F.min(order).alias("m")).where("all > 1")
    again = cut(again.select(F.col("_digest").alias("_d"), F.col("m.page_id").alias("_first"), F.col("m.n").alias("_same")), "repeated")
    told = pages.join(small(again), (F.col("_digest") == F.col("_d")) & (F.col("_length") >= least), "left")
    own = F.col("_d").isNotNull() & F.col("page_id").eqNullSafe(F.col("_first"))
    first = F.col("_d").isNull() | (own & (F.col("_same") == 1))
    kind = lambda is_first: F.when(is_first, "response").otherwise("revisit")
    out = lambda df, is_first: df.select("page_id", "url", F.when(is_first, F.col("html")).alias("html"), "_length", "_digest", kind(is_first).alias("_kind"), F.when(~is_first, F.col("_first")).alias("_refers"), F.col("_d").isNull().alias("_alone"))
    if again.where("_same > 1").isEmpty():
        return out(told, first)
    # several rows have the smallest page_id: equal ones are counted first, so that no task holds them all
    ties = pages.join(small(again.where("_same > 1")), (F.col("_digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_first")))
    ties = ties.groupBy("_digest", "_d", "page_id", "_first", "url").agg(F.min("html").alias("html"), F.min("_length").alias("_length"), F.count("*").alias("_n"))
    ties = ties.withColumn("_rank", F.row_number().over(Window.partitionBy("_digest").orderBy(F.col("url").isNull(), "url")))
    ties = ties.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    return out(told.where(~own | F.col("_d").isNull() | (F.col("_same") == 1)), first).unionByName(out(ties, (F.col("_rank") == 1) & (F.col("_i") == 1)))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, segment: int | None = SEGMENT_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives under path; the manifest: path, records, bytes.

    Null html is an empty payload. Repeated rows have a record each. An empty table writes no archive. Extra columns are not stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _folder(path)
        fs.create_dir(folder, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name, compression=None) as out:
                write_archive(out, held, segment=segment)
            return pa.RecordBatch.from_pylist([{"path": name, "records": len(held), "bytes": size}])

        for whole in batches:
            for batch in slices(whole, "html"):
                for row in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(row["_digest"])).decode()
                    held.append(record(row["_kind"], row["page_id"], row["url"], (row["html"] or "").encode(), row["_length"], digest, row["_refers"], date, row["_alone"]))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return cut(plan_revisits(pages).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, path: str, page_id: str = "long") -> DataFrame:
    """A row a record of the manifest's archives; payload is null for revisits, payload_bytes is not. page_id: the type of ids.

    Digests and lengths of payloads are computed again and must agree with the record's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _folder(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with fs.open_input_stream(name, compression=None) as source:
                    data = source.read()
                rows, size = [], 0
                for raw in read_archive(data):
                    fields, http, payload = parse(raw)
                    response = fields["WARC-Type"] == "response"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = len(payload) if response else int(http["Content-Length"])
                    if response and (payload_digest(payload) != digest or length != int(http["Content-Length"])):
                        raise ValueError(f"{name}: a payload's digest or length is wrong")
                    rows.append({"page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": fields.get("X-Refers-To-Page-ID"), "payload": payload if response else None})
                    size += len(raw)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
    kinds = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    # a number of partitions of our own: the manifest is so small that adaptive execution would have one task read everything
    count, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, min(count, manifest.sparkSession.sparkContext.defaultParallelism), math.ceil(total / READ_BYTES))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, kinds).withColumns({c: F.col(c).cast(page_id) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives and read them back."""
    path = path or scratch(pages.sparkSession, "warc")
    return read(write(pages, path), path, pages.schema["page_id"].dataType.simpleString())
