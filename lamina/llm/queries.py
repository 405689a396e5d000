"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, langid, mixing, quality_model, rules, secrets, simhash, substrings, tokens, warc
from lamina.llm.common import cut, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splitting tree's leaves take of every document: doc_id, size, source_size, target, taken, times, and copies, an array of (pass, shard, position, words)."""
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.row_key().alias("key"), mixing.word_count().alias("size")), "sizes")
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return mixing.assign(sized, mixing.plan(sized)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("times"), "copies")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.sha2(text(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256)
    return found.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), base.alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_warc, op3_tokens, op4_language, op5_secrets, op6_repeats, op7_decontaminate, op8_quality, op9_simhash, op10_rules)
}

_DIGEST = "array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex_, 1 + 5 * (i // 20), 5))::bigint >> (15 - i % 20)) % 32, 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex_ from pages),
        f as (select *, first_value(page_id) over (partition by html order by page_id nulls last) as first_,
                     row_number() over (partition by html order by page_id nulls last) as n from p)
        select page_id, octet_length(encode(html))::bigint as payload_bytes, {_DIGEST} as payload_digest,
               case when n = 1 then 'response' else 'revisit' end as record_type,
               case when n > 1 then first_ end as refers_to from f""",
}



def registered(pipeline: Callable[[SparkSession, str], DataFrame] | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return QUERIES | ({"pipeline": pipeline} if pipeline else {})
