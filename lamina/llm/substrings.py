"""Repeated passages, found by content-defined chunking with a gear rolling hash.

A byte ends a chunk where the gear hash of the 16 bytes up to it has its top bits zero, so cuts depend
on nearby content alone: an insertion moves cuts near it and no others. Chunks start about every 32 bytes (at cuts with one more zero bit);
as so short a chunk may repeat by chance, a chunk's digest covers the chunk and those that follow until
`least` bytes are covered. Digests (96 bits) that more than one document holds mark their bytes as
repeated; a document's marks are merged to spans, and spans of `passage` bytes or more are reported: shorter
ones are single lines. The document with the smallest doc_id that holds a digest owns it; the others may lose it.

Cuts fall between code points. A stretch without a cut is cut every `longest` bytes after the last one.

Texts are chunked once and chunks shuffled once, by digest. The most frequent digests of a sample of the documents are hot:
a document's chunks of them travel as one row, and their owners are minima over those rows. What is sampled decides how a
chunk travels, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, mix, packed, powers, slices, unpacked

WINDOW = 16
CUT_BITS = 5  # chunks start every 2**5 bytes on average; there are twice as many ends
LEAST = 64
LONGEST = 64
PASSAGE = 100  # bytes of the shortest passage that is reported
SAMPLED = 64
HOT = 65_536  # hot digests, at most
HOT_COUNT = 32  # chunks of such a digest in the sample, at least
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte over the WINDOW bytes up to it, by doubling: h2w[i] = hw[i] + (hw[i-w] << w)."""
    h = _GEAR[data]
    width = 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            older = h[:-width] << np.uint64(width)
            h = np.concatenate((h[:width], h[width:] + older))
            width *= 2
    return h


class Digests:
    """Grown chunks of many texts at once. Texts are set apart by a window of zero bytes, so each has the same start."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
        self.down: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    def _powers(self, n: int) -> None:
        if len(self.up[0]) < n:
            n = 1 << max(16, (n - 1).bit_length())
            for k, base in enumerate(_BASES):
                self.up[k], self.down[k] = powers(base, n), powers(pow(base, -1, 1 << 64), n)

    def __call__(self, raws: list[bytes], least: int = LEAST, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the text, first byte, end byte and two hashes of every chunk grown to `least` bytes; a shorter rest of a text has none."""
        apart = bytes(WINDOW)
        data = np.frombuffer(apart + apart.join(raws) + apart, np.uint8)
        sizes = np.array([len(r) for r in raws], np.int64)
        first = np.cumsum(sizes + WINDOW) - sizes
        last = first + sizes
        # the bits tested are those that the whole window reaches
        mask = np.uint64(((1 << (CUT_BITS - 1)) - 1) << (WINDOW - CUT_BITS + 1))
        weak = np.uint64(1 << (WINDOW - CUT_BITS))
        h = gear(data)
        ends = np.flatnonzero((h & mask) == 0) + 1
        owner = np.searchsorted(first, ends, side="right") - 1
        ends = ends[(owner >= 0) & (ends > first[owner]) & (ends < last[owner])]
        ends = np.unique(np.concatenate((first, ends, last)))
        gaps = np.diff(ends)
        if len(gaps) and gaps.max() > longest:
            long_ = np.flatnonzero(gaps > longest)
            extra = [np.arange(ends[i] + longest, ends[i + 1], longest) for i in long_]
            owner = np.searchsorted(first, ends[long_], side="right") - 1
            ends = np.unique(np.concatenate([ends, *(x for x, o, i in zip(extra, owner, long_, strict=True) if ends[i] < last[o])]))
        ends = ends[data[np.minimum(ends, len(data) - 1)] & 0xC0 != 0x80]  # not within a code point
        owner = np.searchsorted(first, ends, side="right") - 1
        reach = np.searchsorted(ends, ends + least)
        own_end = last[owner]
        fine = ((h[ends - 1] & mask) == 0) & ((h[ends - 1] & weak) != 0)  # such a cut ends chunks and starts none
        fine &= ends != first[owner]
        whole = ~fine & (reach < len(ends)) & (ends[np.minimum(reach, len(ends) - 1)] <= own_end)
        starts, stops, owner = ends[whole], ends[np.minimum(reach, len(ends) - 1)][whole], owner[whole]
        self._powers(len(data) + 1)
        out = []
        with np.errstate(over="ignore"):
            for k in range(2):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[k][: len(data)], dtype=np.uint64)))
                out.append(mix((sums[stops] - sums[starts]) * self.down[k][starts]))
        return owner, starts - first[owner], stops - first[owner], out[0], out[1]


def chunks(docs: DataFrame, least: int = LEAST, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, span (start and stop in bytes, packed), d1, d2: every grown chunk of every text. Null texts and null ids have none.

    hot: d1 and d2 of some digests, by d1. A text's chunks of these are one row, whose column hot has their spans and the digests'
    places in `hot`; its d1 is a hash of doc_id and its d2 is -1, which no digest has. In all other rows hot is null.
    """
    h1, h2 = hot or (np.empty(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                owner, starts, stops, d1, d2 = digests([t.encode() for t in batch.column("text").to_pylist()], least)
                spans, d1, d2 = starts << 32 | stops, d1.view(np.int64), (d2 >> np.uint64(32)).astype(np.int64)
                at = np.minimum(np.searchsorted(h1, d1), len(h1) - 1)
                dear = (h1[at] == d1) & (h2[at] == d2) if len(h1) else np.zeros(len(d1), bool)
                texts, n = np.unique(owner[dear], return_counts=True)
                alone = np.arange(len(d1) - n.sum() + len(n)) < len(d1) - n.sum()  # rows of one chunk, then those of many
                rest = np.full(len(n), -1)
                inside = pa.StructArray.from_arrays([pa.array(spans[dear]), pa.array(at[dear].astype(np.int32))], names=["span", "at"])
                ends = np.concatenate((np.zeros(alone.sum(), np.int64), [0], np.cumsum(n))).astype(np.int32)
                columns = [
                    batch.column("doc_id").take(pa.array(np.append(owner[~dear], texts))),
                    pa.array(np.append(spans[~dear], rest), mask=~alone),
                    pa.array(np.append(d1[~dear], rest)),
                    pa.array(np.append(d2[~dear], rest)),
                    pa.ListArray.from_arrays(pa.array(ends), inside, mask=pa.array(alone)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "span", "d1", "d2", "hot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, span long, d1 long, d2 long, hot array<struct<span:long,at:int>>")
    return made.withColumn("d1", F.when(F.col("hot").isNull(), F.col("d1")).otherwise(F.xxhash64("doc_id")))


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """d1 and d2, by d1, of the digests that hold 1/HOT or more of the frequent digests' chunks in every SAMPLED-th document, by hash.

    There are thus at most HOT of them, whatever the size. Any other digest has less than that part of these chunks, or
    fewer than HOT_COUNT chunks in the sample; how often it stands in all documents is an estimate from there.
    """
    some = chunks(docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLED)) == 0), least)
    counts = cut(some.groupBy("d1", "d2").count().where(F.col("count") >= HOT_COUNT), "frequent-digests")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = counts.where(F.col("count") * HOT >= total).select("d1", "d2").toArrow()
    d1, d2 = (hot.column(k).to_numpy() for k in ("d1", "d2"))
    order = np.argsort(d1)
    return d1[order], d2[order]


def first_holders(found: DataFrame, n: int) -> pa.Array:
    """For each of n hot digests the smallest doc_id that holds it, null where no other document does. found: doc_id and hot, as in `chunks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("hot")
            held = pa.table({"at": hot.flatten().field("at"), "id": batch.column("doc_id").take(pc.list_parent_indices(hot))})
            held = held.group_by("at").aggregate([("id", "min"), ("id", "max")]).combine_chunks()
            yield from held.select(["at", "id_min", "id_max"]).rename_columns(["at", "least", "most"]).to_batches()

    if not n:
        return pa.nulls(0)
    kind = found.schema["doc_id"].dataType.simpleString()
    ends = found.where("hot is not null").select("doc_id", "hot").mapInArrow(run, f"at int, least {kind}, most {kind}")
    known = ends.groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("at", "least").toArrow()
    place = np.full(n, -1)
    place[known.column("at").to_numpy()] = np.arange(len(known))
    return known.column("least").combine_chunks().take(pa.array(place, mask=place < 0))


def marks(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, pa.Array]:
    """doc_id, span, owner, hot: the chunks whose digest another document holds too, and the smallest doc_id that holds it.

    Where hot is not null, it has the chunks of hot digests instead, as in `chunks`; the array has the owners of these digests.
    """
    hot = frequent(docs, least)
    same = Window.partitionBy("d1", "d2")
    found = chunks(docs, least, hot).select("*", F.min("doc_id").over(same).alias("owner"), F.max("doc_id").over(same).alias("last"))
    found = cut(found.where("owner <> last or hot is not null").select("doc_id", "span", "owner", "hot"), "marks")
    return found, first_holders(found, len(hot[0]))


def merged(spans: np.ndarray, passage: int) -> np.ndarray:
    """Packed spans as rows of start and stop, merged where they meet; of them those of `passage` bytes or more."""
    spans = np.unique(spans)
    start, stop = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.flatnonzero(np.append(True, start[1:] > stop[:-1])) if len(spans) else np.empty(0, np.int64)
    out = np.stack((start[new], stop[np.append(new[1:], len(spans)) - 1]), axis=1) if len(new) else np.empty((0, 2), np.int64)
    return out[out[:, 1] - out[:, 0] >= passage]


def repeated(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """A row for each document that shares a passage: doc_id, spans (bytes, merged), n_bytes in them, removable spans and owners.

    removable: the spans that documents with smaller doc_ids hold too; owners: those documents' ids, sorted.
    A passage repeated within one document only is not reported, and rows that repeat a doc_id count as one document.
    Null ids, null and empty texts have no row, nor has an empty table. doc_id may be of any ordered type. Extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType
    found, holders = marks(docs, least)
    cold = F.when(F.col("hot").isNull(), F.struct("span", "owner"))
    rows = found.groupBy("doc_id").agg(F.collect_set(cold).alias("marks"), F.flatten(F.collect_set("hot")).alias("hot"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_, hot = (batch.column(k) for k in ("doc_id", "marks", "hot"))
            cold, more = all_.flatten(), hot.flatten()
            place, whose = pc.list_parent_indices(all_), pc.list_parent_indices(hot)
            held = holders.cast(ids.type).take(more.field("at"))
            known = held.is_valid().to_numpy(zero_copy_only=False)
            place = np.concatenate((place.to_numpy(), whose.to_numpy()[known]))
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(len(ids) + 1))
            spans = np.concatenate((cold.field("span").to_numpy(), more.field("span").to_numpy()[known]))[order]
            owners = pa.concat_arrays([cold.field("owner"), held.drop_null()]).take(pa.array(order))
            lost = pc.not_equal(owners, ids.take(pa.array(place[order]))).to_numpy(zero_copy_only=False)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, key in enumerate(ids):
                own, gone = spans[ends[i] : ends[i + 1]], np.flatnonzero(lost[ends[i] : ends[i + 1]])
                whole, free = merged(own, passage), merged(own[gone], passage)
                if not len(whole):
                    continue
                at = np.searchsorted(free[:, 0], own[gone] >> 32, side="right") - 1
                inside = gone[(at >= 0) & ((own[gone] >> 32) < free[at, 1])] if len(free) else gone[:0]
                rows = lambda x: [{"start": a, "stop": b} for a, b in x.tolist()]
                for column, value in zip(out, (key, rows(whole), int((whole[:, 1] - whole[:, 0]).sum()), rows(free), owners.take(pa.array(ends[i] + inside)).unique().sort()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in out[0]], ids.type), pa.array(out[1], span), pa.array(out[2], pa.int64()), pa.array(out[3], span), pa.array([o.to_pylist() for o in out[4]], pa.list_(ids.type))], names=["doc_id", "spans", "n_bytes", "removable", "owners"])

    spans = "array<struct<start:int,stop:int>>"
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, spans {spans}, n_bytes long, removable {spans}, owners array<{kind.simpleString()}>")


def remove_repeats(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """docs with the removable spans of repeated passages taken out of text.

    Rows that repeat a doc_id lose the same spans (a text that ends before them stays whole). Null texts and ids stay as they are; extra columns stay, whatever their names.
    """
    found = repeated(docs, least, passage).select(F.col("doc_id").alias("_id"), F.col("removable").alias("_spans"))
    joined = packed(docs, "doc_id", "text").join(found, F.col("doc_id") == F.col("_id"), "left")
    raw = F.col("text").cast("binary")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(raw, acc["at"] + 1, x["start"] - acc["at"])).alias("out"), x["stop"].alias("at"))
    rest = F.aggregate("_spans", F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(raw, acc["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.col("_spans").isNull() | (F.octet_length("text") < F.try_element_at("_spans", F.lit(-1))["stop"]), F.col("text")).otherwise(rest.cast("string"))
    return joined.select(*unpacked(docs, text=text))
