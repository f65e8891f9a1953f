"""Quality rules whose cutoffs are chosen on labelled holdouts under a guarantee, as Spark SQL expressions only.

Each rule rejects a document whose measure lies beyond a cutoff. For each stratum (language) and rule, cutoffs are
tried from the most lenient to the strictest. Among the stratum's documents labelled good, the number that a cutoff
rejects gives the exact binomial tail P(Bin(n, limit) <= rejected): how likely so few rejections are if the true
false-rejection rate exceeded the limit. A cutoff holds while that is at most ``delta`` divided by the number of strata
and rules (Bonferroni); within a rule the fixed order of testing needs no further correction, and testing stops at the
first cutoff that does not hold. Rules share the limit, so with probability 1 - ``delta`` no stratum loses more than
``limit`` of its good documents to the method. A stratum or rule with too few labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.llm.columns import let
from plotyard.session import hand_over

LIMIT, DELTA = 0.05, 0.05
BROADCAST_STRATA = 10_000  # rows of at most 100 bytes each
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Rule: measure, whether larger values are worse, cutoffs from lenient to strict. Fixed in advance of any label.
RULES = {
    "symbols": ("symbol_ratio", True, (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05)),
    "repeats": ("repeat_ratio", True, (0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.09, 0.06)),
    "dup_lines": ("dup_line_ratio", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "capitals": ("capital_ratio", True, (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25)),
    "same_word": ("same_word_ratio", False, (0.01, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2)),
    "long_words": ("mean_word", True, (40.0, 30.0, 20.0, 16.0, 14.0, 13.0, 12.0)),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text has twice or more, the first included. Windows are compared by a
    64-bit hash of their words' hashes."""

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(keys: Column) -> Column:
        by_key = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            twin = lambda x, k: F.get(rows, k - 1)["h"].eqNullSafe(x["h"]) | F.get(rows, k + 1)["h"].eqNullSafe(x["h"])
            return F.array_sort(F.transform(F.filter(rows, lambda x, k: twin(x, k)), lambda x: x["i"]))

        def add(acc: Column, i: Column) -> Column:
            return F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(by_key, repeated), start, add)["n"]

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(covered(keys))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(let(hashes, windows), count))


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``stratum``, the base counts, ``base_failed`` and the measures of ``RULES``; a row per document.

    ``documents`` needs ``doc_id``, ``text`` and ``lang``; other columns are ignored. A null text has no words, a null language is
    a stratum of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    counted = docs.select(
        "doc_id",
        "stratum",
        let(words_of(F.col("text")), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        F.when(F.col("text").rlike(SYMBOLS), F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        F.when(F.col("text").rlike("[A-Z]"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).otherwise(0).alias("capitals"),
    )
    n_words, chars = F.col("w.n_words"), F.greatest(F.col("w.word_chars"), F.lit(1))
    failed = (n_words < 20) | (100 * F.col("w.n_repeat_words") > 30 * n_words)
    return counted.select(
        "doc_id",
        "stratum",
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        "w.n_repeat_words",
        failed.alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("w.n_repeat_words") / F.greatest(n_words, F.lit(1))).alias("repeat_ratio"),
        (F.col("l.dup") / F.greatest(F.col("l.n"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("capitals") / chars).alias("capital_ratio"),
        (F.col("w.n_distinct_words") / F.greatest(n_words, F.lit(1))).alias("same_word_ratio"),
        (F.col("w.word_chars") / F.greatest(n_words, F.lit(1))).alias("mean_word"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exactly summed; 1 where k is at least the mean, which no level of testing accepts."""
    odds = F.lit(rate / (1 - rate))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    first = n * F.ln(F.lit(1 - rate))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<long>)"))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.aggregate(steps, start, add)["sum"], F.lit(1.0)))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """A row per stratum: ``n_good`` holdouts and the cutoff of each rule, null where none holds.

    Holdouts are documents that pass the base rules and whose labels, at least one, all say quality 1. A ``doc_id`` that
    several documents bear is not used, nor is a null one.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1 AND doc_id IS NOT NULL")
    once = measured.join(good.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ["stratum", "base_failed", *(r[0] for r in RULES.values())])
    )
    holdouts = once.filter("n = 1 AND NOT base_failed")
    beyond = lambda measure, larger, cutoff: F.col(measure) > cutoff if larger else F.col(measure) < cutoff
    rejected = [
        F.sum(beyond(measure, larger, c).cast("long")).alias(f"{rule}_{k}")
        for rule, (measure, larger, cutoffs) in RULES.items()
        for k, c in enumerate(cutoffs)
    ]
    counts = holdouts.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *rejected)
    counts = counts.crossJoin(counts.agg(F.count(F.lit(1)).alias("n_strata")))  # one row
    level = F.lit(delta / len(RULES)) / F.col("n_strata")

    def strictest(rule: str, cutoffs: tuple[float, ...]) -> Column:
        tests = F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"{rule}_{k}").alias("k")) for k, c in enumerate(cutoffs)))

        def add(acc: Column, t: Column) -> Column:
            holds = acc["on"] & (binomial_tail(F.col("n_good"), t["k"], limit / len(RULES)) <= level)
            return F.struct(holds.alias("on"), F.when(holds, t["cutoff"]).otherwise(acc["cutoff"]).alias("cutoff"))

        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cutoff"))
        return F.aggregate(tests, start, add)["cutoff"].alias(f"cut_{rule}")

    return counts.select("stratum", "n_good", *(strictest(rule, cutoffs) for rule, (_, _, cutoffs) in RULES.items()))


def judge(documents: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """``measures`` with the stratum's cutoffs and ``kept``: false if the base rules or a cutoff reject the document.

    ``labels`` needs ``doc_id`` and ``quality``. Measures are written once and read for choosing and for judging.
    """
    measured = hand_over(measures(documents), "measures")
    cutoffs = hand_over(choose_cutoffs(measured, labels.select("doc_id", "quality"), limit, delta), "cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:  # a stratum can hold most rows; beyond the bound strata are many and small
        cutoffs = F.broadcast(cutoffs)
    judged = measured.join(cutoffs, "stratum", "left")
    bad = F.col("base_failed")
    for rule, (measure, larger, _) in RULES.items():
        cut = F.col(f"cut_{rule}")
        bad = bad | F.coalesce(F.col(measure) > cut if larger else F.col(measure) < cut, F.lit(False))
    return judged.withColumn("kept", ~bad)
