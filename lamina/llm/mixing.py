"""Mixing sources to target weights, in DataFrame functions only.

1. Targets: sources weigh 5, 2, 1, repeating in code point order, and share a multiple of all words;
   none gets more than `repeats` times its own, and the excess is dealt again by weight (a water
   level, found in one window over the sources).
2. Blocks: a source's documents are dealt by hash into blocks of about `block_words` words: a
   permutation of the source, cut into disjoint pieces. A source's quota is an exact number of block
   draws, whole passes over its blocks and then the first blocks of one more; the last block drawn
   is cut at a word, so that a source gives its target to the word.
3. Splitting tree: the quotas of a node, one number a source, are parted between its two children by
   multivariate hypergeometric draws, down to one leaf a shard. A leaf takes, of every source, as
   many of the next permuted blocks as its quota says: disjoint by construction.
4. A document's copies are what the leaves that drew its block take of it, each with its shard and a
   random position there; write_shards orders every shard by position: the local shuffle.

Draws come from hashes of seed, node and source: reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import WORD, cut, packed, small, unpacked

WEIGHTS = (5, 2, 1)
SEED = 7
_SUPER = 1024  # blocks a group for running sums
SPREAD = 6  # levels of the tree between two repartitions of its nodes


@dataclass
class Plan:
    sources: DataFrame  # a row a source, with its target and where its draws end
    draws: DataFrame  # _sid, _b, draws: for each block the leaves that drew it, an array of (pass, shard)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, _sid, _weight, source_size, target: one row a source; sized has source and size."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("_sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    found = found.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_sid") % len(weights) + 1).cast("int")))
    found = found.withColumn("_cap", repeats * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("_weight"))
    w = Window.orderBy("_full", "_sid")
    before = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("_level", (total * share - before) / rest)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min_by(F.when(F.col("_level") <= F.col("_full") * (1 + 1e-12), F.col("_level")), F.when(F.col("_level") <= F.col("_full") * (1 + 1e-12), F.struct("_full", "_sid"))).over(every)
    found = found.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_weight"), F.col("_cap").cast("double"))))
    return found.select("source", "_sid", "_weight", "source_size", "target")


def _draw(total: Column, marked: Column, n: Column, u: Column) -> Column:
    """How many of n draws without replacement from `total`, `marked` of them marked, are marked: the u-quantile.

    The probabilities within ten deviations of the mean follow from their ratios; the rest is under 1e-20.
    """
    low, high = F.greatest(F.lit(0).cast("long"), n + marked - total), F.least(marked, n)
    mean = n * marked / total
    sd = F.sqrt(mean * (1 - marked / total) * (total - n) / F.greatest(total - 1, F.lit(1)))
    a = F.greatest(low, F.floor(mean - 10 * sd) - 1)
    b = F.least(high, F.ceil(mean + 10 * sd) + 1)
    ratio = lambda k: ((marked - k) * (n - k)).cast("double") / ((k + 1) * (total - marked - n + k + 1)).cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)

    def pick(bounds: Column) -> Column:
        ks = F.sequence(bounds["a"], bounds["b"])
        more = lambda acc, k: F.struct(F.when(k < bounds["b"], acc["w"] * ratio(k)).otherwise(zero).alias("w"), (acc["s"] + acc["w"]).alias("s"))
        whole = F.aggregate(ks, F.struct(one.alias("w"), zero.alias("s")), more, lambda acc: acc["s"] * u)

        def find(goal: Column) -> Column:
            step = lambda acc, k: F.struct(F.when(k < bounds["b"], acc["w"] * ratio(k)).otherwise(zero).alias("w"), (acc["s"] + acc["w"]).alias("s"), F.when(acc["s"] < goal, k).otherwise(acc["x"]).alias("x"))
            return F.aggregate(ks, F.struct(one.alias("w"), zero.alias("s"), bounds["a"].alias("x")), step, lambda acc: acc["x"])

        return F.get(F.transform(F.array(whole), find), F.lit(0))

    return F.when(low >= high, low).otherwise(F.get(F.transform(F.array(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))), pick), F.lit(0)))


def _left(quotas: Column, node: Column, seed: int) -> Column:
    """What the left child gets of each source: draws for half of the node's blocks, source after source."""
    n0 = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(n0.alias("total"), F.floor(n0 / 2).cast("long").alias("n"), F.lit(0).alias("i"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, q: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, acc["i"]), 11).cast("double") * 2.0**-53
        x = _draw(acc["total"], q, acc["n"], u)
        bound = lambda x: F.struct((acc["total"] - q).alias("total"), (acc["n"] - x).alias("n"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.get(F.transform(F.array(x), bound), F.lit(0))

    return F.aggregate(quotas, start, step, lambda acc: acc["out"])


def splitting_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """_sid, shard, first, last: the half-open range of each source's draws that each of 2**depth shards takes.

    quotas: _sid (0, 1, ...) and quota, one row a source. A node carries, for every source, how many draws
    it has and where they begin, so a leaf needs no other leaf; levels are spread over tasks as they grow.
    """
    gathered = F.sort_array(F.collect_list(F.struct("_sid", "quota")))
    nodes = quotas.agg(F.transform(gathered, lambda x: x["quota"].cast("long")).alias("q")).select(F.lit(0).cast("long").alias("shard"), "q", F.transform("q", lambda _: F.lit(0).cast("long")).alias("o"))
    for level in range(depth):
        if level and level % SPREAD == 0:
            nodes = cut(nodes.repartition("shard"), "nodes")
        nodes = nodes.withColumn("l", _left(F.col("q"), F.col("shard") + (1 << level), seed))
        left = F.struct((2 * F.col("shard")).alias("shard"), F.col("l").alias("q"), F.col("o").alias("o"))
        right = F.struct((2 * F.col("shard") + 1).alias("shard"), F.zip_with("q", "l", lambda q, x: q - x).alias("q"), F.zip_with("o", "l", lambda o, x: o + x).alias("o"))
        nodes = nodes.select(F.inline(F.array(left, right)))
    leaves = nodes.select("shard", F.posexplode(F.arrays_zip("q", "o")).alias("_sid", "x"))
    return leaves.select("_sid", "shard", F.col("x.o").alias("first"), (F.col("x.o") + F.col("x.q")).alias("last"))


def row_key() -> Column:
    """A hash of a row: doc_id, source and text, so that rows of one id fall into different blocks. Wholly equal rows share it, and any of them may stand for another."""
    return F.xxhash64("doc_id", "source", "text")


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.col("_blocks"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, block_words: int = 1 << 16, shard_words: int = 1 << 24, seed: int = SEED) -> Plan:
    """Targets, quotas and the splitting tree. sized: key, source and size of every document."""
    sources = targets(sized, weights, share, repeats)
    sources = sources.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    sources = sources.withColumn("_want", F.least(F.round("target").cast("long"), repeats * F.col("source_size")))
    size = F.greatest(F.col("source_size"), F.lit(1))
    sources = cut(sources.withColumn("_passes", F.floor(F.col("_want") / size).cast("long")).withColumn("_more", F.col("_want") % size), "sources")

    told = sized.select("key", "source", "size").join(small(sources.select(F.col("source").alias("_source"), "_sid", "_blocks")), F.col("source").eqNullSafe(F.col("_source")))
    blocks = told.withColumn("_b", _block(seed)).groupBy("_sid", "_b").agg(F.sum("size").alias("words"))
    blocks = cut(blocks.withColumn("_group", F.floor(F.col("_b") / _SUPER)), "blocks")
    group = Window.partitionBy("_sid").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("_sid", "_group").agg(F.sum("words").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(group), F.lit(0)))
    within = Window.partitionBy("_sid", "_group").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0))
    ends = blocks.join(groups.select("_sid", "_group", "ahead"), ["_sid", "_group"]).withColumn("ahead", ahead).join(sources.select("_sid", "_more"), "_sid")
    ends = ends.where("ahead <= _more and _more < ahead + words").select("_sid", F.col("_b").alias("_last"), (F.col("_more") - F.col("ahead")).alias("_cut"))
    sources = sources.join(ends, "_sid", "left").fillna(0, ["_last", "_cut"])
    drawn = F.when(F.col("_more") > 0, F.col("_last") + (F.col("_cut") > 0).cast("long")).otherwise(0)
    sources = cut(sources.withColumn("_quota", F.col("_passes") * F.col("_blocks") + drawn), "sources")

    words = sources.agg(F.coalesce(F.sum("_want"), F.lit(0))).first()[0]
    depth = max(0, math.ceil(math.log2(max(1, words / shard_words))))
    tree = splitting_tree(sources.select("_sid", F.col("_quota").alias("quota")), depth, seed).where("first < last")
    draws = tree.join(small(sources.select("_sid", "_blocks")), "_sid").select("_sid", "shard", "_blocks", F.explode(F.sequence("first", F.col("last") - 1)).alias("_k"))
    there = F.struct(F.floor(F.col("_k") / F.col("_blocks")).alias("pass"), "shard")
    draws = draws.groupBy("_sid", (F.col("_k") % F.col("_blocks")).alias("_b")).agg(F.sort_array(F.collect_list(there)).alias("draws"))  # a draw a pass
    return Plan(sources, cut(draws, "draws"))


def assign(rows: DataFrame, made: Plan, seed: int = SEED, size: Column | None = None, taken_only: bool = False) -> DataFrame:
    """rows with size, source_size, target and copies: an array of (pass, shard, position, words), one for each time the tree takes the document.

    rows: key, source and what else is to be kept; size: how to get a document's words where rows do not hold them.
    taken_only: leave out the documents that are not taken.
    """
    own = made.sources.withColumnRenamed("source", "_source")
    found = rows.join(small(own), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_b", _block(seed))
    found = found.join(small(made.draws), ["_sid", "_b"], "inner" if taken_only else "left")
    at_end = (F.col("_b") == F.col("_last")) & (F.col("_cut") > 0)
    sizes = lambda df: df if size is None else df.withColumn("size", size)
    others = sizes(found.where(~at_end)).withColumn("_part", F.when((F.col("_more") > 0) & (F.col("_b") < F.col("_last")), F.col("size")).otherwise(0).cast("long"))
    # the last block of a source: about block_words words
    order = Window.partitionBy("_sid").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    last = sizes(found.where(at_end)).withColumn("_ahead", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_cut") - F.col("_ahead"))).cast("long")).drop("_ahead")
    words = lambda p: F.when(p < F.col("_passes"), F.col("size")).when(p == F.col("_passes"), F.col("_part")).otherwise(0)
    place = lambda p: F.xxhash64(F.lit(seed + 2), "key", p)
    copy = lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), place(d["pass"]).alias("position"), words(d["pass"]).cast("long").alias("words"))
    copies = F.filter(F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:bigint>>")), copy), lambda x: x["words"] > 0)
    kept = [c for c in rows.columns if c != "size"]
    return others.unionByName(last).select(*kept, "size", "source_size", "target", copies.alias("copies"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = SEED, **how: object) -> DataFrame:
    """The mixture: a row for each time a document is taken, with its columns, `pass`, `taken` (words), shard and position.

    A document that is taken in part keeps the text up to its last word taken. Documents without words
    weigh nothing and are not taken. A null source is a source, the last; a null doc_id is a value like any other.
    Repeated rows are documents of their own (of equal rows, which is taken in part makes no difference).
    An empty table gives an empty mixture. Extra columns are kept, whatever their names, but for those named
    pass, taken, shard and position, which are replaced. Rows of a shard are in random order when sorted by
    position; write_shards does that.
    """
    docs = docs.drop("pass", "taken", "shard", "position")
    rows = packed(docs, "source", "text", row_key().alias("key"))
    made = plan(cut(rows.select("source", "key", word_count().alias("size")), "sizes"), seed=seed, **how)
    taken = assign(rows, made, seed, word_count(), taken_only=True).select("_row", "text", "size", F.explode("copies").alias("_copy"))
    text = F.when(F.col("_copy.words") < F.col("size"), first_words(F.col("text"), F.col("_copy.words"))).otherwise(F.col("text"))
    return taken.select(*unpacked(docs, text=text), F.col("_copy.pass").alias("pass"), F.col("_copy.words").alias("taken"), F.col("_copy.shard").alias("shard"), F.col("_copy.position").alias("position"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """A folder a shard, each in the order of its positions: the local shuffle."""
    mixed.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
