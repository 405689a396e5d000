"""SimHash fingerprints and near-duplicate groups.

Fingerprints are compared exactly: tiles of them meet tile by tile, numpy takes the exclusive or
and counts bits, and pairs of tiles whose population counts differ by more than the radius are
skipped. A full grid of tiles grows with the square of the corpus, so the grid is first cut into
cells that no link can leave unseen:

* small radius r: the bits are dealt into r+k blocks; two fingerprints within r bits agree on at
  least k whole blocks, so a cell is a choice of k blocks and (a part of) their value. Exact.
* large radius (similarity of 0.8 on 256 bits): a cell is one of `keys` smallest shingle hashes
  under different mixings; sets with a Jaccard similarity of J share a cell with 1-(1-J)^keys.

Cells larger than a tile are dealt into tiles over many tasks. A task returns a spanning forest of
its links, not its links; components come from alternating star contractions over tables in the
shared folder. Nothing about documents is collected.

At a large radius such links are candidates only: the shingle sets of their components' fingerprints, one
representative each, meet once more, and links whose Jaccard similarity is below the one asked for go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, mix, packed, slices, small, unpacked

TILE = 4096
SETS_TILE = 1024  # sets a tile, and so many shingles, where sets are compared exactly
SHINGLES_TILE = 1 << 21
_SUB = 512
_PRINT_SCHEMA = "node long, fp binary, keys array<long>, n_shingles long, text_key long"


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, A-Z in lower case, joined by one space, repeats included.

    Fewer words: the whole sequence. No word (or a null text): nothing.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` words of 64 bits; a bit is 1 if it is set in more than half of the hashes. No hash: all zero."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        h = hashes if not lane else mix(hashes + np.uint64(lane))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, distinct: bool = False, keys: int = 0) -> DataFrame:
    """A row per row of docs: doc_id, node (a 64-bit name of the fingerprint), fp (big-endian bytes), keys, n_shingles, text_key.

    distinct: count each shingle once, so that the fingerprint speaks of sets (else without the last two columns); keys: so many smallest hashes.
    text_key: a hash of the text, with doc_id the way back to a row.
    """
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                prints, nodes, mins, sizes = [], [], [], []
                for text in batch.column("text").to_pylist():
                    h = shingle_hashes(text, shingle)
                    h = np.unique(h) if distinct else h
                    p = fingerprint(h, lanes)
                    raw = p.astype(">u8").tobytes()
                    prints.append(raw)
                    sizes.append(len(h))
                    nodes.append(int(p[0]) if lanes == 1 else xxhash.xxh64_intdigest(raw))
                    mins.append([int(mix(h ^ np.uint64(k * 0x9E3779B9 + 1)).min().view(np.int64)) for k in range(keys)] if len(h) else [0] * keys)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), batch.column("text_key")],
                    names=["doc_id", "node", "fp", "keys", "n_shingles", "text_key"],
                )

    made = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_PRINT_SCHEMA}")
    return made if distinct else made.drop("n_shingles", "text_key")


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest, as pairs of row numbers, of the links within `left` or, if given, between left and right.

    Rows of `right` are numbered after those of `left`. Each side is ordered by population count and cut
    into tiles; a pair of tiles whose counts are further apart than the radius holds no link.
    """
    both = left if right is None else np.concatenate((left, right))
    count = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    a = np.argsort(count[: len(left)], kind="stable")
    b = a if right is None else len(left) + np.argsort(count[len(left) :], kind="stable")
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs: list[tuple[int, int]] = []
    for x in range(0, len(a), _SUB):
        rows = a[x : x + _SUB]
        for y in range(x if right is None else 0, len(b), _SUB):
            cols = b[y : y + _SUB]
            if count[cols[0]] - count[rows[-1]] > radius or count[rows[0]] - count[cols[-1]] > radius:
                continue
            apart = np.bitwise_count(both[rows, 0][:, None] ^ both[cols, 0][None, :])
            if both.shape[1] > 1:
                apart = apart.astype(np.int16)
                for lane in range(1, both.shape[1]):
                    apart += np.bitwise_count(both[rows, lane][:, None] ^ both[cols, lane][None, :])
            near = apart <= radius
            if right is None and x == y:
                near &= np.tri(len(rows), len(cols), -1, dtype=bool)
            for i in np.flatnonzero(near.any(axis=1)):
                others = cols[near[i]]
                me = root(rows[i])
                for j in np.unique(parent[others]):  # many of them already hang on one root
                    if (r := root(int(j))) != me:
                        low, high = min(r, me), max(r, me)
                        pairs.append((low, high))
                        parent[high] = low
                        me = low
                parent[others] = me
                parent[rows[i]] = me
    return np.array(pairs, np.int64).reshape(-1, 2)


def _plan_blocks(n: int, bits: int, radius: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each kind of cell its blocks (first bit, width), and how many of those bits name the cell."""
    for k in (1, 2, 3):
        blocks = radius + k
        marks = [round(i * bits / blocks) for i in range(blocks + 1)]
        spans = [(marks[i], marks[i + 1] - marks[i]) for i in range(blocks)]
        width = k * (bits // blocks)
        if n <= (TILE // 2) << width or k == 3:
            break
    used = max(0, min(width, math.ceil(math.log2(max(1, n) / (TILE // 2)))))
    return [list(c) for c in combinations(spans, k)], used


def _cells(prints: DataFrame, n: int, bits: int, radius: int) -> DataFrame:
    """(cell, node, fp) for every cell a fingerprint is in."""
    kinds, used = _plan_blocks(n, bits, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)
            for kind, spans in enumerate(kinds):
                value = np.zeros(len(fp), np.uint64)
                for at, width in spans:
                    lane, shift = divmod(at, 64)
                    part = fp[:, lane] >> np.uint64(shift)
                    if shift + width > 64 and lane + 1 < fp.shape[1]:
                        part = part | (fp[:, lane + 1] << np.uint64(64 - shift))
                    value = (value << np.uint64(width)) | (part & np.uint64((1 << width) - 1))
                value = mix(value) & np.uint64((1 << used) - 1)
                cell = (np.uint64(kind) << np.uint64(40)) | value
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("node"), batch.column("fp")], names=["cell", "node", "fp"])

    return prints.select("node", "fp").mapInArrow(run, "cell long, node long, fp binary")


def links(prints: DataFrame, bits: int, radius: int, by_keys: bool) -> DataFrame:
    """u, v: links between fingerprint names that join the same components as all links do. prints: distinct."""
    lanes = bits // 64
    if by_keys:
        cells = prints.select(F.posexplode("keys").alias("k", "key"), "node", "fp").select(F.xxhash64("k", "key").alias("cell"), "node", "fp")
        sizes = cells.groupBy("cell").count().where("count > 1")
        cells = cells.join(sizes.select("cell"), "cell", "left_semi")
    else:
        cells = _cells(prints, prints.count(), bits, radius)
        sizes = cells.groupBy("cell").count()
    hot = small(cut(sizes.where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "hot-cells"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.hash("node"), tiles)
    dealt = (
        cells.join(hot, "cell", "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("cell", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "node", "fp")
    )

    def compare(group: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
        node = group.column("node").to_numpy()
        ti, tj = group.column("ti")[0].as_py(), group.column("tj")[0].as_py()
        first = group.column("own").to_numpy() == ti
        order = np.concatenate((np.flatnonzero(first), np.flatnonzero(~first)))
        fp, node = fp[order], node[order]
        found = tile_links(fp, None, radius) if ti == tj else tile_links(fp[: first.sum()], fp[first.sum() :], radius)
        return pa.table({"u": node[found[:, 0]], "v": node[found[:, 1]]})

    return dealt.groupBy("cell", "ti", "tj").applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge, by alternating large and small stars until nothing changes."""
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour of a node hangs on the node's least neighbour
        both = edges.union(edges.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        next_ = big.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        edges = cut(next_, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
        state = now


def set_links(fp: np.ndarray, sets: list[np.ndarray], first: int, radius: int, similarity: float) -> np.ndarray:
    """A spanning forest, as pairs of row numbers, of the links at `radius` or fewer bits whose sets have the similarity.

    sets: the distinct shingles of each row. All rows meet if first is their number, else those before `first` meet the others.
    """
    n = len(fp)
    size = np.fromiter(map(len, sets), np.int64, n)
    ends = np.cumsum(size)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    parent = np.arange(n)
    pairs: list[tuple[int, int]] = []
    for i in range(1, n) if first == n else range(first, n):
        other = min(i, first)
        near = np.bitwise_count(fp[:other] ^ fp[i]).sum(axis=1, dtype=np.int64) <= radius
        near &= np.minimum(size[:other], size[i]) >= similarity * np.maximum(size[:other], size[i]) - 1e-9
        near &= parent[:other] != parent[i]
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        for j in np.flatnonzero(near).tolist():
            if parent[i] == parent[j]:
                continue
            both = int(np.count_nonzero(mark[flat[ends[j] - size[j] : ends[j]]]))
            if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                pairs.append((j, i))
                low, high = min(parent[i], parent[j]), max(parent[i], parent[j])
                parent[parent == high] = low
        mark[own] = False
    return np.array(pairs, np.int64).reshape(-1, 2)


def confirmed(docs: DataFrame, distinct: DataFrame, joined: DataFrame, shingle: int, bits: int, radius: int, similarity: float) -> DataFrame:
    """u, v: links with the exact similarity that join the same components as all of them do.

    joined: node and root of the candidates' components, roots left out; no link leaves one. A representative's set is taken from its
    text and goes to its component only, which is dealt into tiles if it is large.
    """
    lanes = bits // 64
    members = joined.select("node", "root").union(joined.select("root", "root").distinct())
    nodes = distinct.join(members, "node").select("node", "fp", "root", "n_shingles", "sample")
    sizes = nodes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / SETS_TILE), F.ceil(F.sum("n_shingles") / SHINGLES_TILE)).cast("int").alias("tiles"))
    hot = small(cut(sizes.where("tiles > 1"), "hot-components"))
    tiles = F.coalesce("tiles", F.lit(1))
    wanted = cut(nodes.join(hot, "root", "left").select("node", "fp", "root", tiles.alias("tiles"), F.col("sample.doc_id").alias("_doc"), F.col("sample.text_key").alias("_key")), "wanted")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "fp", "root", "tiles")), pa.array(sets, pa.binary())], names=["node", "fp", "root", "tiles", "shingles"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = texts.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("text", "node", "fp", "root", "tiles")
    sets = found.mapInArrow(shingled, "node long, fp binary, root long, tiles int, shingles binary").dropDuplicates(["node", "fp"])
    dealt = (
        sets.withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("root", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "node", "fp", "shingles")
    )

    def compare(group: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
        node = group.column("node").to_numpy()
        ti, tj = group.column("ti")[0].as_py(), group.column("tj")[0].as_py()
        first = group.column("own").to_numpy() == ti
        order = np.concatenate((np.flatnonzero(first), np.flatnonzero(~first)))
        raw = group.column("shingles").to_pylist()
        found = set_links(fp[order], [np.frombuffer(raw[k], np.uint64) for k in order], len(order) if ti == tj else int(first.sum()), radius, similarity)
        return pa.table({"u": node[order][found[:, 0]], "v": node[order][found[:, 1]]})

    return dealt.groupBy("root", "ti", "tj").applyInArrow(compare, "u long, v long")


def groups(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3, similarity: float | None = None, keys: int = 6) -> DataFrame:
    """A row per row of docs: doc_id, fp (binary), component_id, the smallest doc_id reachable over links.

    Fingerprints link at `radius` or fewer differing bits. With `similarity` the fingerprints speak of sets
    of shingles, and the radius is where sets of that Jaccard similarity are expected plus two deviations;
    a link then also needs that similarity of the sets themselves, and rows also have text_key, a hash of the
    text, and head: doc_id and text_key of the group's first row (by doc_id, null last, then text_key).
    Null and empty texts have the fingerprint zero and are linked like others. A null doc_id is passed
    over when the smallest is sought; a group of such rows only has a null component_id. doc_id may be of any
    ordered type. Extra columns are not read. An empty table gives an empty result.
    """
    by_keys = similarity is not None
    if by_keys:
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        radius = math.floor(bits * p + 2 * math.sqrt(bits * p * (1 - p)))
    prints = cut(fingerprints(docs, shingle, bits, by_keys, keys if by_keys else 0), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key") if by_keys else F.lit(None).cast("string")
    sample = [F.min_by("n_shingles", F.struct("doc_id", "text_key")).alias("n_shingles"), F.min(F.struct("doc_id", "text_key")).alias("sample")] if by_keys else []
    distinct = cut(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least_doc"), F.min("keys").alias("keys"), F.min(first).alias("head"), *sample), "distinct")
    joined = cut(components(links(distinct, bits, radius, by_keys)), "components")
    if by_keys:
        joined = cut(components(confirmed(docs, distinct, joined, shingle, bits, radius, similarity)), "components")
    named = distinct.join(joined, "node", "left").select("node", "fp", "least_doc", "head", F.coalesce("root", "node").alias("root"))
    heads = named.where("root <> node").select("root").distinct()
    linked = named.join(heads, "root", "left_semi")
    of_root = linked.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.min("head").alias("head"))
    of_node = linked.drop("head").join(of_root, "root").select("node", "fp", "component_id", "head")
    alone = named.join(heads, "root", "left_anti").select("node", "fp", F.col("least_doc").alias("component_id"), "head")
    classes = of_node.union(alone).withColumnRenamed("fp", "fp_")
    found = prints.join(classes, (prints.node == classes.node) & (prints.fp == classes.fp_))
    return found.select("doc_id", "fp", "component_id", *(["text_key", "head"] if by_keys else []))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """docs without the near copies: of each group the first row stays, by doc_id (null last), then a hash of the text.

    A row is known by its doc_id and text: rows that share an id only are documents of their own, and of rows with the same
    id and text one stays. Null ids are ids like others. Extra columns are kept, whatever their names. An empty table stays empty.
    """
    per = groups(docs, shingle, bits, similarity=similarity).groupBy("doc_id", "text_key").agg(F.first("head").alias("head"), F.count("*").alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    per = cut(per.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "rows", stays.alias("stays")), "heads")
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # the rows that go are fewer than those that stay, and so is what meets the texts
    out = rows.join(small(cut(per.where(~F.col("stays")).select("_id", "_key"), "gone")), same, "left_anti")
    repeated = cut(per.where(F.col("stays") & (F.col("rows") > 1)).select("_id", "_key"), "repeated")
    if not repeated.isEmpty():
        repeated = small(repeated)
        out = out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select(*unpacked(docs))
