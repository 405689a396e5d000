"""The training-data operators against brute force, exact round trips and held-out accuracy, with nulls, empty and repeated rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import decontaminate, langid, mixing, quality_model, queries, rules, secrets, simhash, substrings, tokens, warc
from lamina.llm.common import WordHashes, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"
ODD = ["", None, "one", "a b c", " \n\t ", "word " * 5000, "héé ünï 日本語 テキスト", "a\n\nb\na\n", "x" * 9000, "same text here with eight words or more in it", "same text here with eight words or more in it"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if t is not None else None, t, None, None if i % 3 == 0 else f"s{i % 2}", 0, "clash", "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def measures(text):
    text = text or ""
    words, at, covered, seen, dup = WORD.findall(text), collections.defaultdict(list), set(), set(), 0
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules(request, which):
    df = request.getfixturevalue(which)
    got = rules.judge(df.select("doc_id", "text")).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text) for r in got)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert rules.keep(df).count() == sum(r.kept for r in got)


def test_rules_order_does_not_change_the_verdict(docs):
    env = lambda name: rules.MEASURES[name](F.col("text"))
    every = rules.BASE_RULES | rules.RULES
    a, b = rules.cascade(list(every), every, env), rules.cascade(list(every)[::-1], every, env)
    assert docs.where(a != b).isEmpty()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "source", mixing.row_key().alias("key"), mixing.word_count().alias("size"))
    made = mixing.plan(rows, block_words=500, shard_words=3000)
    got = mixing.assign(rows, made).select("doc_id", "source", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken")).collect()
    assert len(got) == df.count() and all(r.taken <= 2 * r.size for r in got)
    taken, goal = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
    assert all(abs(taken[s] - t) <= 1 for s, (t, _) in goal.items())
    # the water level, by hand
    names = sorted(goal, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(n for _, n in goal.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * goal[s][1]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2 * goal[s][1] for s in over}
        left -= sum(2 * goal[s][1] for s in over)
        free -= over
    assert all(abs(want[s] - goal[s][0]) < 1e-6 * max(1, want[s]) for s in names)
    again = mixing.assign(rows, mixing.plan(rows, block_words=500, shard_words=3000)).select("doc_id", F.to_json("copies")).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.assign(rows, made).select("doc_id", F.to_json("copies")).collect()))


def test_more_than_eight_passes(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", 10 if i % 2 else 500) for i in range(40)], "doc_id long, source string, size long").withColumn("key", F.xxhash64("doc_id"))
    made = mixing.plan(rows, weights=(1, 1), share=1.5, repeats=20, block_words=50)
    got = mixing.assign(rows, made).select("source", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken")).collect()
    for name in ("s0", "s1"):
        target = next(r.target for r in got if r.source == name)
        assert abs(sum(r.taken for r in got if r.source == name) - target) <= 1
    assert max(r.taken for r in got if r.source == "s1") == 200  # twenty times its ten words


def test_mixture_rows(docs, odd, empty):
    got = mixing.mix(docs, block_words=500, shard_words=3000).select("doc_id", "taken", "shard", "pass", mixing.word_count().alias("w"))
    rows = got.collect()
    assert all(r.taken == r.w for r in rows) and len({r.shard for r in rows}) > 4
    assert mixing.mix(empty).count() == 0
    assert "node" in mixing.mix(odd).columns and mixing.mix(odd).where("text is null").count() == 0


def test_shards_are_shuffled(spark, docs, tmp_path):
    mixed = mixing.mix(docs, block_words=500, shard_words=20000)
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == mixed.count()
    for folder in (tmp_path / "mix").glob("shard=*"):
        files = sorted(folder.glob("*.parquet"))
        places = [r.position for r in spark.read.parquet(str(files[0])).collect()]
        assert len(files) == 1 and places == sorted(places)


def test_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 2)
    leaves = mixing.splitting_tree(spark.createDataFrame([(0, 900), (1, 70)], "_sid int, quota long"), 5).collect()
    spans = sorted((r.first, r.last) for r in leaves if r._sid == 0)
    assert len(spans) == 32 and spans[0][0] == 0 and spans[-1][1] == 900 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 7), (2, 0), (3, 100)], "_sid int, quota long")
    leaves = mixing.splitting_tree(quotas, 3).collect()
    for s, q in ((0, 40), (1, 7), (2, 0), (3, 100)):
        spans = sorted((r.first, r.last) for r in leaves if r._sid == s)
        assert spans[0][0] == 0 and spans[-1][1] == q and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    sizes = [sum(r.last - r.first for r in leaves if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 3
    draws = [mixing.splitting_tree(quotas, 1, seed).where("_sid = 0 and shard = 0").first() for seed in range(40)]
    assert 18 < np.mean([r["last"] - r["first"] for r in draws]) < 22


def test_archives_round_trip(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "x\ny", None), (5, "v", ""), (7, "w", "é" * 9), (7, "w", "é" * 9), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = sorted((r.page_id if r.page_id is not None else 99, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 4, digest("same"), "response", None), (2, 0, digest(""), "response", None), (3, 4, digest("same"), "revisit", 1), (5, 0, digest(""), "revisit", 2), (7, 18, digest("é" * 9), "response", None), (7, 18, digest("é" * 9), "revisit", 7), (99, 4, digest("same"), "revisit", 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0


def test_archives_of_rows_without_ids_and_ties(spark, tmp_path):
    rows = [(None, "b", "same"), (None, "a", "same"), (None, None, "same"), (4, "z", "tie"), (4, "y", "tie"), (4, "y", "tie"), (None, "q", "alone"), (9, "w", "tie")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    back = warc.read(warc.write(pages, path), path).collect()
    assert sorted((str(r.page_id), str(r.url), r.record_type, str(r.refers_to)) for r in back) == sorted(
        [("None", "a", "response", "None"), ("None", "b", "revisit", "None"), ("None", "None", "revisit", "None"), ("4", "y", "response", "None"), ("4", "y", "revisit", "4"), ("4", "z", "revisit", "4"), ("9", "w", "revisit", "4"), ("None", "q", "response", "None")]
    )
    heads = [warc.parse(raw)[0] for f in (tmp_path / "w").glob("*.zst") for raw in warc.read_archive(f.read_bytes())]
    names = [h["WARC-Record-ID"] for h in heads]
    assert len(set(names)) == len(rows) and all(h["WARC-Refers-To"] in names and h["WARC-Refers-To"] != h["WARC-Record-ID"] for h in heads if "WARC-Refers-To" in h)
    assert warc.archive(pages.withColumn("page_id", F.col("page_id").cast("string"))).where("refers_to = '4'").count() == 3


def test_archive_head_holds_the_dictionary(tmp_path):
    records = [f"WARC/1.1\r\nn: {i}\r\n\r\n<html>the same words again {i % 7}</html>".encode() for i in range(400)]
    with open(tmp_path / "a", "wb") as f:
        warc.write_archive(f, records)
    data = (tmp_path / "a").read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18") and list(warc.read_archive(data)) == records


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_counts(request, which):
    df = request.getfixturevalue(which)
    counter = tokens.PrefixCounter(queries.tokenizer_path())
    whole = lambda t: len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), whole(t), whole(t) > 2048) for i, t in texts(df))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, queries.tokenizer_path()).collect()) == want


def test_every_prefix(docs):
    counter, r = tokens.PrefixCounter(queries.tokenizer_path()), random.Random(1)
    count = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    for text in ["", "it's <|endoftext|>foo ΟΔΟΣ\u0085b", "  x\n\n y'll", *[t[a : a + 150] for _, t in texts(docs)[:25] if t for a in [r.randrange(max(1, len(t) - 150))]]]:
        want = [count(text[:i]) for i in range(len(text) + 1)]
        assert counter.table(text).tolist() == want
        for budget in (0, 1, 5, 40):
            longest = max(i for i, n in enumerate(want) if n <= budget)
            assert counter.truncate(text, budget) == len(text[:longest].rstrip(tokens.BLANKS))


def test_long_words_are_truncated_inside():
    counter = tokens.PrefixCounter(queries.tokenizer_path())
    count = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    text = "before " + "日本語x1y" * 1500
    end = counter.truncate(text, 300)
    assert count(text[:end]) <= 300 < count(text[: end + 1]) and end > 100
    assert not [w for w in counter.memo if len(w) > tokens.KEPT]


def test_counts_of_all_prefixes_as_a_column(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in tokens.token_counts(df, queries.tokenizer_path(), limit=1, tables=True).collect()}
    assert got["a"].prefix_tokens[-1] == got["a"].n_tokens and len(got["a"].prefix_tokens) == 8 and got["a"].chars_in_limit < 8 and list(got["b"].prefix_tokens) == [0]


def test_language_identification(docs, odd, empty):
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}  # nothing to learn from
    assert langid.identify(empty).count() == 0


def test_secret_patterns():
    base = lambda t: secrets.joined(secrets.base_spans(t))
    assert base('x token = "abcdef12" y') == "assign:2:19"
    assert base("token=abc password:'abcdefg") == "assign:10:27"
    assert base("token=token:abcdefgh") == ""  # the failing match takes the second word
    assert base("AKIA" + "A1" * 8) == "access:0:20" and base("AKIA" + "A" * 15) == ""
    assert base("0" * 24 + " é " + "a" * 23) == "hex:0:24"
    novelty = secrets.Novelty()
    text = "the bearer credential is ghp_16C7e42F292c6912E7710c838347Ae178B4a and more words follow here"
    assert secrets.novel_spans(text, novelty, []) == [(25, 65, "novel")]
    assert not secrets.novel_spans("the token is changeme_placeholder_value1 and so on", novelty, [])


def plain_spans(text):
    """The three patterns, kind by kind, as they are written."""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_secret_scan_rows(docs, odd):
    got = {r.doc_id: r for r in queries.op5_secrets(docs.sparkSession, SF).collect()}
    for i, t in texts(docs):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and got[i].n_hex == sum(s.startswith("hex") for s in base)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("novel")] == base
    assert secrets.scan(odd).where("size(spans) > 0").isEmpty()
    assert not any(plain_spans(r.text or "") for r in secrets.redact(docs).collect() if "[SECRET]" in (r.text or ""))


def test_patterns_on_hard_strings():
    r = random.Random(8)
    parts = ["token", "API_KEY", "apikey", "passwd", '"', "'", " ", ":", "=", "AKIA", "A1" * 8, "Z" * 15, "0af" * 8, "é", "f" * 23, "abcdef", "\n", "ſecret=abcdefg"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 14)))
        assert [f"{k}:{a}:{b}" for a, b, k in secrets.ordered(secrets.base_spans(text))] == plain_spans(text), text


@pytest.mark.parametrize("letters, size, least", [("ABCDEFabcdefghijkLMNOPxyz0123456789+/", 40, 0.95), ("abcdefghijklmnopqrstuvwxyz0123456789", 32, 0.9), ("0123456789ABCDEF", 32, 0.95), ("ABCDEFGHIJabcdefghij0123456789", 20, 0.9)])
def test_planted_secrets_are_novel(docs, letters, size, least):
    r, novelty, prose = random.Random(4), secrets.Novelty(), [t for _, t in texts(docs) if t]
    found = 0
    for i in range(120):
        head = r.choice(prose)[:300] + r.choice([" the private key is ", " bearer credential is ", " api key: use ", " passphrase ", " signing key\n"])
        text = head + "".join(r.choices(letters, k=size)) + " " + r.choice(prose)[:200]
        found += (len(head), len(head) + size, "novel") in secrets.novel_spans(text, novelty, secrets.base_spans(text))
    assert found >= least * 120
    known = ["configuration_value_2024", "client_secret_example1", "my.application.settings.v2", "placeholder_token_0001", "production_database_password_3"]
    assert not any(secrets.novel_spans(f"{t[:200]} the token is {w} {t[:200]}", novelty, []) for w in known for t in prose[:20])


def test_identifiers_of_the_corpus(spark):
    rows = [(i, f"call frobnicate_the_widget then openFileHandle {'once_only' if i else ''} x{i}_9a") for i in range(2)]
    got = secrets.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).decode().split()
    assert {"frobnicate_the_widget", "openFileHandle"} <= set(got) and "once_only" not in got


def plain_fingerprint(text, shingle):
    """By the contract's words, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, shingle, radius):
    prints = [(i, plain_fingerprint(t, shingle)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), f"{p:016x}", str(least.get(root(k)))) for k, (i, p) in enumerate(prints))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    got = simhash.groups(df).select("doc_id", F.lower(F.hex("fp")).alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, str(r.component_id)) for r in got) == brute_components(texts(df), 3, 3)


def test_simhash_tiles(monkeypatch):
    monkeypatch.setattr(simhash, "_SUB", 16)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 63, 40).astype(np.uint64)) for _ in range(4)]).reshape(-1, 1)
    found = simhash.tile_links(near, None, 3)
    assert len(found) == len(near) - 40  # a spanning forest of forty groups
    assert all(np.bitwise_count(near[a, 0] ^ near[b, 0]) <= 24 for a, b in found)


def test_near_copies_go(spark, docs, odd, empty):
    words = [f"w{i}" for i in range(300)]
    changed = words.copy()
    changed[150] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[::-1])), (4, " ".join(words)), (4, " ".join(words)), (9, None), (8, "")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_near_copies_without_repeats_or_ids(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[::-1])), (None, " ".join(words)), (None, " ".join(words)), (5, "alone"), (5, "alone"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(7)).withColumn("heads", F.lit("x"))
    for some, left in ((df.where("doc_id is null"), [None]), (df.where("doc_id is null or doc_id < 5"), [1, 3]), (df, [1, 3, 5, 5])):
        kept = simhash.drop_near_duplicates(some)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == left


def shingled_pair(name, similarity, shingles=1000):
    """Two texts of so many distinct five-word shingles each; as many are common as the Jaccard similarity allows."""
    common = int(2 * shingles * similarity / (1 + similarity))
    words = [[f"{name}c{i}" if i < common + 4 else f"{name}{side}{i}" for i in range(shingles + 4)] for side in "xy"]
    return [" ".join(w) for w in words]


def test_pairs_below_the_similarity_stay(spark):
    rows = [(10 * k + side, text) for k, j in enumerate((0.6, 0.7, 0.75, 0.79, 0.81, 0.9)) for name in "ab" for side, text in enumerate(shingled_pair(f"{k}{name}", j), 2 * (name == "b"))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(i for i, _ in rows) == sorted([r.doc_id for r in kept.collect()] + [41, 43, 51, 53])


@pytest.mark.parametrize("limits", [(1024, 1 << 21), (4, 1 << 21), (1024, 900)])
def test_near_copies_have_the_similarity(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "SETS_TILE", limits[0])
    monkeypatch.setattr(simhash, "SHINGLES_TILE", limits[1])
    r, rows = random.Random(4), []
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(300)]
        for _ in range(20):  # a chain: each text is the last one with three words changed
            words = [f"{w}n{len(rows)}" if i in set(r.sample(range(300), 3)) else w for i, w in enumerate(words)] if r.random() < 0.3 else words[:-3] + [f"t{len(rows)}{i}" for i in range(3)]
            rows.append((len(rows), " ".join(words)))
    rows += [(None, rows[5][1]), (None, rows[5][1]), (5, rows[5][1])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {i: root(k) for k, (i, _) in enumerate(rows) if i is not None}
    got = {x.doc_id: x.component_id for x in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 256, similarity=0.8).collect() if x.doc_id is not None}
    assert got == want


def test_repeats(spark, docs, odd):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(80)} {passage if i in (3, 7) else words(60)} {words(40)}") for i in range(12)]
    got = {x.doc_id: x for x in substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {3, 7} and list(got[7].owners) == [3] and not got[3].removable
    raw = dict(rows)[7].encode()
    assert all(raw[s.start : s.stop].decode() in passage for s in got[7].removable)
    out = dict(texts(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert all(out[i] == t for i, t in rows if i != 7) and len(out[7]) < len(dict(rows)[7]) - 150
    assert substrings.remove_repeats(odd).count() == odd.count()


def common_lengths(rows):
    """For each document the longest run of bytes that another one holds too, by a suffix array of all."""
    joined = b"".join(t.encode() + b"\xff" for _, t in rows)
    owner = [k for k, (_, t) in enumerate(rows) for _ in range(len(t.encode()) + 1)]
    order = sorted(range(len(joined)), key=lambda i: joined[i : i + 2000])
    out = [0] * len(rows)
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while a + n < len(joined) and b + n < len(joined) and joined[a + n] == joined[b + n] != 0xFF:
            n += 1
        if owner[a] != owner[b]:
            out[owner[a]], out[owner[b]] = max(out[owner[a]], n), max(out[owner[b]], n)
    return dict(zip((i for i, _ in rows), out, strict=True))


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_against_a_suffix_array(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "SAMPLED", 1)
        monkeypatch.setattr(substrings, "HOT_COUNT", 2)
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choices("abcdefghé", k=r.randint(2, 9))) for _ in range(n))
    passages = [words(n) for n in (5, 8, 30, 55, 55, 70, 120)]
    rows = [(i, " ".join([words(r.randint(5, 60)), *r.sample(passages, r.choice((0, 0, 1, 2))), words(r.randint(5, 40))])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, words(3))]
    longest = common_lengths(rows)
    got = {x.doc_id: x for x in substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in longest.items() if n >= 250} <= set(got) and all(longest[i] >= 100 for i in got)
    raw = {i: t.encode() for i, t in rows}
    for i, x in got.items():
        assert x.n_bytes == sum(s.stop - s.start for s in x.spans)
        assert all(any(raw[i][s.start : s.start + 64] in raw[j] for j in raw if j != i) for s in x.spans)
        assert all(any(raw[i][s.start : s.start + 64] in raw[j] for j in x.owners) and max(x.owners) < i for s in x.removable)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hot_chunks_of_a_document_travel_as_one_row(spark, monkeypatch, kind):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    passage, other, twice = words(200), words(60), words(30)
    rows = [(i, f"{words(20)} {passage} {other if i % 5 == 0 else words(30)}") for i in range(40)]
    rows += [(40, passage), (40, passage), (40, f"{words(30)} {other}"), (41, " ".join([twice] * 4)), (42, words(50)), (43, ""), (44, None), (None, passage)]
    rows = [(i if i is None or kind == "long" else f"{i * 7 % 50:02}é", t) for i, t in rows]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    every = {x.doc_id: x for x in substrings.repeated(frame).collect()}
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    written = {}
    monkeypatch.setattr(substrings, "cut", lambda df, name, cut=substrings.cut: written.setdefault(name, cut(df, name)))
    for least in (8, 20, 1000):  # all passages are hot, the long one is, none is
        monkeypatch.setattr(substrings, "HOT_COUNT", least)
        written.clear()
        assert {x.doc_id: x for x in substrings.repeated(frame).collect()} == every and len(every) == 41
        assert least != 8 or written["marks"].count() < 120  # not a row for each of some 40 chunks in 41 documents


def test_digests_do_not_depend_on_neighbours():
    d = substrings.Digests()
    a, b = b"some text " * 30, bytes(range(97, 120)) * 20
    alone = d([b])
    both = d([a, b"", b])
    own = both[0] == 2
    assert all((x == y[own]).all() for x, y in zip(alone[1:], both[1:], strict=True))


@pytest.fixture(scope="module")
def searcher(spark, docs):
    bench = table(spark, SF, "benchmark")
    return decontaminate._searchers(decontaminate._prepare(docs, bench))[0], [(b.item_id, b.text) for b in bench.collect()]


def test_decontamination(spark, docs):
    items = [(1, " ".join(f"item{i} of" for i in range(20))), (2, "too short"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(100))
    rows = [(10, f"{filler} {items[0][1]} {filler}"), (11, filler), (12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()] == [(10, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(df, bench).collect()) == [11, 12, 13]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("kind, share, tail", [("replace", 0, 0), ("replace", 0.2, 0), ("delete", 0.2, 0), ("insert", 0.2, 0), ("replace", 0.3, 0), ("replace", 0.35, 5), ("replace", 0.4, 5), ("delete", 0.35, 5)])
def test_planted_paraphrases(searcher, docs, kind, share, tail):
    r, s, items = random.Random(9), *searcher
    fill = [w for _, t in texts(docs) if t for w in t.split()]
    rows, want = [], []
    for item, text in items * 3:
        own, made = re.findall(r"[^\W_]+", text), []
        for i, w in enumerate(own):
            hit = i < len(own) - tail and r.random() < share
            made += [] if hit and kind == "delete" else [r.choice(fill)] if hit and kind == "replace" else [w, r.choice(fill)] if hit else [w]
        at = r.randrange(len(fill) - 400)
        rows.append(" ".join([*fill[at : at + r.randrange(20, 200)], *made, *fill[at + 200 : at + 300]]))
        a, b = ([h for h in s.words([t])[0].tolist()] for t in (" ".join(made), text))
        covered = decontaminate.common_subsequence(a, b) / len(b)
        want.append((item, covered >= 0.6 or covered >= 0.5 and decontaminate.common_subsequence(a, b[-5:]) >= 4))
    got = s.find(rows)
    found = [item in f for (item, ok), f in zip(want, got, strict=True) if ok]
    assert len(found) > len(items) and np.mean(found) > 0.98
    assert np.mean([item in f for (item, _), f in zip(want, got, strict=True)]) >= 0.9  # whatever the rule says of them


def test_short_and_unspaced_items(spark, docs):
    items = [(1, "quartz vixen"), (2, "Zephyr"), (3, "日本語の文章を探す"), (4, "kept apart here now"), (5, " ... ")]
    rows = [(10, "a quartz, vixen b"), (11, "vixen quartz"), (12, "the zephyr"), (13, "前の文。日本語の文章を探す。次の文"), (14, "kept apart there now"), (15, "kept-apart here; now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (12, 2), (13, 3), (15, 4)} and got[10, 1] == (1, 3)


def test_many_blocks_of_items(spark, docs, monkeypatch):
    bench = table(spark, SF, "benchmark")
    whole = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == whole


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(50):
        a, b = r.choices(range(6), k=r.randint(0, 40)), r.choices(range(6), k=r.randint(1, 90))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_planted_passages_of_the_benchmark(spark, docs):
    bench = table(spark, SF, "benchmark")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {(i, b.item_id) for b in bench.collect() for i, t in texts(docs) if plain(b.text) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(want - got) <= 0.02 * len(want) and len(got - want) <= 0.1 * max(10, len(want))


def test_quality_model(spark, docs, empty):
    big = "/root/testdata/sf0.01"
    labels = table(spark, big, "labels")
    rated = quality_model.rate(table(spark, big, "documents"), labels).join(labels, "doc_id").collect()
    good = [r.kept for r in rated if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rated if r.toxic == 1]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    assert all(r.p_not_toxic >= r.p_good for r in rated)
    assert quality_model.rate(empty, labels).count() == 0
    assert quality_model.rate(docs, labels.limit(0)).where("kept").count() == docs.count()


def test_quality_model_on_labels_it_has_not_seen(spark):
    big = "/root/testdata/sf0.1"
    labels = table(spark, big, "labels")
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    rated = quality_model.rate(table(spark, big, "documents"), seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").collect()
    good = [r.kept for r in rated if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rated if r.toxic == 1]
    assert len(good) > 300 and len(bad) > 20 and np.mean(good) > 0.9 and np.mean(bad) < 0.15
    assert np.mean([r.expected_grade for r in rated if r.toxic == 1]) < np.mean([r.expected_grade for r in rated if r.quality == 0 and r.toxic == 0]) < np.mean([r.expected_grade for r in rated if r.quality == 1 and r.toxic == 0])


CLASH = "size target source_size copies key _row _sid _b _blocks _part draws n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept m _id _spans _key span owner last d1 d2 hot held_out _held _lang _share lang_pred score grade c v _picked count node fp head rows stays text_key _gone item_id cosine covered marks doc_id_ pass taken shard position n w".split()
OPERATORS = {
    "mix": lambda d, b, lab: mixing.mix(d),
    "tokens": lambda d, b, lab: tokens.token_counts(d, queries.tokenizer_path()),
    "identify": lambda d, b, lab: langid.identify(d),
    "scan": lambda d, b, lab: secrets.scan(d),
    "redact": lambda d, b, lab: secrets.redact(d),
    "repeated": lambda d, b, lab: substrings.repeated(d),
    "remove_repeats": lambda d, b, lab: substrings.remove_repeats(d),
    "leaks": lambda d, b, lab: decontaminate.leaks(d, b),
    "drop_leaking": lambda d, b, lab: decontaminate.drop_leaking(d, b),
    "rate": lambda d, b, lab: quality_model.rate(d, lab),
    "groups": lambda d, b, lab: simhash.groups(d),
    "drop_near_duplicates": lambda d, b, lab: simhash.drop_near_duplicates(d),
    "judge": lambda d, b, lab: rules.judge(d),
    "keep": lambda d, b, lab: rules.keep(d),
}
A_ROW_EACH = {"tokens", "identify", "scan", "redact", "remove_repeats", "rate", "groups", "judge"}


@pytest.fixture(scope="module")
def clashing(spark, docs):
    rows = spark.createDataFrame([(i if t is not None else None, t, None, None if i % 3 == 0 else f"s{i % 2}", 0) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    some = docs.where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    return rows.union(some).union(some.where("doc_id < 3")).withColumns({c: F.lit("mine") for c in CLASH}).persist()


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("ids", ["long", "string"])
def test_clashing_columns_and_ids(spark, clashing, name, ids):
    df = clashing.withColumn("doc_id", F.col("doc_id").cast(ids))
    bench = table(spark, SF, "benchmark").withColumn("item_id", F.col("item_id").cast(ids)).withColumn("doc_id", F.lit("mine"))
    labels = table(spark, SF, "labels").withColumn("doc_id", F.col("doc_id").cast(ids)).withColumn("text", F.lit("mine"))
    got = OPERATORS[name](df, bench, labels)
    rows = got.collect()
    if name in A_ROW_EACH:
        assert len(rows) == df.count()
    if name in ("redact", "remove_repeats", "drop_leaking", "drop_near_duplicates", "keep"):
        assert got.columns == df.columns and all(r["_row"] == r["count"] == "mine" for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, clashing, name):
    assert OPERATORS[name](clashing.limit(0), table(spark, SF, "benchmark"), table(spark, SF, "labels")).count() == 0


def test_word_hashes():
    h, owner, a, b = WordHashes()(["Ab c", None, "", " ab\n"])
    assert owner.tolist() == [0, 0, 3] and h[0] == h[2] != h[1] and (a[2], b[2]) == (1, 3)


def test_pipeline(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    clean = {i for i, t in texts(docs) if measures(t)[0] >= 20}
    out = {r.doc_id for r in kept.collect()}
    assert out <= clean and len(out) > 0.6 * docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} <= out


def test_pipeline_stages_on_odd_and_empty_tables(spark, clashing):
    for stage_name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clashing, SF)
        assert got.count() > 0, stage_name
        assert set(clashing.columns) <= set(got.columns) if stage_name == "mixture" else got.columns == clashing.columns
        assert stage(spark, clashing.limit(0), SF).count() == 0, stage_name
