"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition to reject. On a bounded sample of rows its cost (seconds) and selectivity (share
rejected) are measured, and rules run in order of rejection per cost: a CASE expression stops at
the first that holds. The order changes the time only; a row is kept if no rule rejects it.

Null texts have no words. A rule never sees a null: every measure of an empty text is zero.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import WORD, WS, cut, packed, unpacked

SAMPLE_ROWS = 256
SAMPLE_CHARS = 100_000
SAMPLED = 4
COPIES = 1
ROUNDS = 3
LEAST_COST = 1e-4  # seconds; below the clock's noise
WINDOW = 8
Measures = dict[str, Callable[[Column], Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that occurs twice or more, the first included.

    Windows are told apart by 64-bit hashes of their word sequences (within one text). Repeats are
    found by sorting the hashes, and only where some hash occurs twice.
    """

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"]))
            return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

        def union(at: Column) -> Column:
            step = lambda acc, p: F.struct((p + window).cast("long").alias("end"), (acc["n"] + F.least(F.lit(window), p + window - acc["end"])).cast("long").alias("n"))
            return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, places), union))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(windows, covered))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _chars(text: Column, which: str) -> Column:
    """How many characters of a text are among `which`."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, which, ""))).cast("long")


#: Measures of a text; a cascade evaluates one only if a rule that needs it is reached.
MEASURES: Measures = {
    "n_words": lambda t: _count(t, WORD),
    "word_chars": lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), WS + "+", "")).cast("long"),
    "n_symbols": lambda t: _chars(t, "#*$%&|<>"),
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda t: let(words_of(t), lambda w: repeated_words(w)),  # of one parameter: a second would be the index
    "n_lines": lambda t: _count(t, r"(?m)^.*[^\x20\x09-\x0D].*$"),
    "n_shouted": lambda t: _chars(t, "!"),
    "n_alpha_words": lambda t: _count(t, r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"),
}

Env = Callable[[str], Column]
BASE_RULES: dict[str, Callable[[Env], Column]] = {
    "few_words": lambda m: m("n_words") < 20,
    "repeats": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
}
RULES: dict[str, Callable[[Env], Column]] = {
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "shouting": lambda m: 10 * m("n_shouted") > 3 * m("n_words"),
    "duplicate_lines": lambda m: (m("n_dup_lines") >= 3) & (10 * m("n_dup_lines") > 3 * m("n_lines")),
    "not_words": lambda m: 2 * m("n_alpha_words") < m("n_words"),
    "long_words": lambda m: m("word_chars") > 100 * m("n_words"),
}


def measured(text: Column) -> Column:
    """A struct of a text's words' measures (n_words, word_chars, n_repeat_words), its word list made once."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def order_rules(docs: DataFrame, rules: dict[str, Callable[[Env], Column]], text: str = "text", rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) by rejection per second on a sample, best first; of ties the cheaper, then the first by name.

    The sample is of at most `rows` texts of at most SAMPLE_CHARS, one of SAMPLED by hash, from as many partitions as it takes to find
    them; it is bounded, and not taken from every partition. A rule's cost is the median time of an aggregate of it over the sample,
    read COPIES times, less that of an aggregate of no rule, in `rounds` rounds.
    """
    spark, t = docs.sparkSession, F.col("text")
    picked = docs.select(F.col(text).alias("text")).where((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)).limit(rows).collect()
    sample = cut(spark.range(1).select(F.explode(F.array(*(F.lit(r["text"]) for r in picked)).cast("array<string>")).alias("text")), "rules-sample").select("text", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    env = lambda name: let(t, lambda x: MEASURES[name](x))
    n = max(1, len(picked) * COPIES)

    def timed(condition: Column) -> tuple[int, float]:
        began = time.perf_counter()
        bad = sample.agg(F.sum(F.length("text")), F.count_if(condition)).first()[1]
        return bad, time.perf_counter() - began

    took: dict[str, list[float]] = {name: [] for name in rules}
    bad: dict[str, int] = {}
    idle = []
    for _ in range(rounds):
        idle.append(timed(F.col("text").isNull())[1])
        for name, rule in rules.items():
            bad[name], seconds = timed(rule(env))
            took[name].append(seconds)
    base = median(idle)
    found = [(name, bad[name] / n, max(LEAST_COST, median(took[name]) - base)) for name in rules]
    return sorted(found, key=lambda r: (-r[1] / r[2], r[2], r[0]))


def cascade(order: list[str], rules: dict[str, Callable[[Env], Column]], env: Env) -> Column:
    """True unless a rule rejects; rules are tried in order, and none after the first that holds."""
    out = F.when(F.lit(False), F.lit(False))
    for name in order:
        out = out.when(rules[name](env), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed and kept.

    A null text is an empty one and fails. Repeated rows have a row each, an empty table none. Extra columns are kept,
    whatever their names, but for those named like the new ones, which are replaced.
    """
    order = [name for name, _, _ in order_rules(docs, RULES, text)]
    t = F.col(f"_row.{text}")
    rows = packed(docs).select("_row", F.inline(F.array(measured(t)))).withColumns({"n_symbols": MEASURES["n_symbols"](t), "n_dup_lines": MEASURES["n_dup_lines"](t)})
    there = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    env = lambda name: F.col(name) if name in there else MEASURES[name](t)
    rows = rows.withColumn("base_failed", BASE_RULES["few_words"](env) | BASE_RULES["repeats"](env))
    rows = rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order, RULES, env)))
    new = (*there, "base_failed", "kept")
    return rows.select(*unpacked(docs.drop(*new)), *new)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, by the cascade over base and other rules; n_words, which most need, is counted once.

    A null text is an empty one and goes. Repeated rows are judged each; extra columns are kept, whatever their names; an empty table stays empty.
    """
    rules = BASE_RULES | RULES
    order = [name for name, _, _ in order_rules(docs, rules, text)]
    t = F.col(text)
    return docs.where(let(MEASURES["n_words"](t), lambda n: cascade(order, rules, lambda name: n if name == "n_words" else MEASURES[name](t))))
