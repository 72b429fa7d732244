"""Quality rules with risk-controlled thresholds.

Base rules reject texts of few words or of many repeated ones. Beyond them, each signal has a cutoff for each stratum
(language) with enough labels, and one for all other languages, pooled from the labels of all: the lowest one that is
certain, by an exact binomial (Clopper-Pearson) bound on the labelled good texts, to reject at most the signal's share
of ALPHA of good texts. Cutoffs are tested from the loosest down until one fails; so fixed an order needs no division
by their number. DELTA is the chance that any bound fails, divided over signals, strata with enough labels and the
pool. Enough is when a cutoff above all good labels is certain, which follows from numbers of labels only. The pooled
promise is for all languages together, not for each. If even the pool has too few, there are only the base rules.

The labelled texts are the holdout: nothing is fitted to them but the choice of a cutoff, which the fixed order pays for.
Equal texts of one language are one trial, however many documents and labels they have.

One pass over the texts makes the table of signals. Labels meet it in a join by doc_id, and only counts by (stratum,
signal, cutoff) of strata with enough labels, and of the pool, come to the driver.

Cases: null and empty texts have no words and fail the base rules. A null language is a stratum of its own. Documents
without labels or with null ones don't count for the bounds; one labelled several times counts once if any label is good.
Repeated rows are judged each. An empty table gives none.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, table, text_bytes, written
from ._words import WordTable, repeated_windows, sums
from .token_files import slices

ALPHA, DELTA, CUTOFFS, WINDOW = 0.02, 0.05, 40, 8
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
#: Strata whose cutoffs are sent to all tasks; more meet the texts in a shuffle.
SMALL = 10_000
#: Stands for all languages without cutoffs of their own; no language is a tuple.
POOLED = ("pooled",)
#: The signals are rates from 0 to 1; higher is worse.
SIGNALS = ("symbol_rate", "shout_rate", "dup_line_rate", "repeat_rate", "stutter_rate")
FOUND = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{s} double" for s in SIGNALS)


def describe(words: list[bytes]) -> np.ndarray:
    """characters, symbols, shouted: of each word."""
    out = np.zeros((len(words), 3))
    for k, w in enumerate(words):
        n = len(w) if w.isascii() else len(w.decode("utf-8", "replace"))
        out[k] = n, len(w.translate(None, NOT_SYMBOL)), len(w) > 2 and w.upper() == w != w.lower()
    return out


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def signals(docs: DataFrame) -> DataFrame:
    """The base counts and SIGNALS of each row of docs (doc_id, lang, text)."""

    def work(batches):
        memo = kept("risk_rules", lambda: WordTable(3, describe, np.float64))
        for batch in batches:
            all_texts = batch.column(2).to_pylist()
            for x in slices(all_texts):
                texts = all_texts[x]
                codes, ends = memo.look_up(texts)
                n = np.diff(ends)
                chars, symbols, shouted = sums(memo.rows[codes], ends).T if len(codes) else np.zeros((3, len(texts)))
                lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
                repeat = repeated_windows(codes, ends, WINDOW)
                again = np.zeros(len(codes), np.int64)
                again[1:] = codes[1:] == codes[:-1]
                again[ends[:-1][n > 0]] = 0
                some = np.maximum(n, 1)
                rates = (symbols / np.maximum(chars, 1), shouted / some, lines[:, 0] / np.maximum(lines[:, 1], 1), repeat / some, sums(again, ends) / some)
                whole = lambda v: pa.array(np.asarray(v).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[x.start : x.stop] for c in ("doc_id", "lang", "text_hash")), *map(whole, (n, chars, symbols, lines[:, 0], repeat)), *(pa.array(np.minimum(r, 1.0).astype(np.float64)) for r in rates)],
                    ["doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *SIGNALS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_bytes().alias("text")).withColumn("text_hash", F.xxhash64("text")).mapInArrow(work, FOUND)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, -1, -1)]
    top, total = max(terms), 0.0
    for t in terms:
        total += exp(t - top)
    return min(1.0, total * exp(top))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k in n were seen, failing with chance delta."""
    low, high = k / max(n, 1), 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high if n else 1.0


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def own_strata(sizes: dict, alpha: float = ALPHA, delta: float = DELTA) -> tuple[list, float]:
    """The strata with enough good labels for cutoffs of their own, and the delta of each test. sizes: {lang: labels}."""
    order = sorted(sizes, key=lambda x: (-sizes[x], x is None, x or ""))
    enough = lambda m: upper_bound(0, sizes[order[m - 1]], delta / ((m + 1) * len(SIGNALS))) <= alpha / len(SIGNALS)
    m = next((m for m in range(len(order), 0, -1) if enough(m)), 0)
    return order[:m], delta / ((m + 1) * len(SIGNALS))


def thresholds(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """{(lang, signal): cutoff}: values above are rejected; POOLED is all languages that have none. found: signals(); labels: (doc_id, quality)."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    grade = lambda s: F.ceil(F.col(s) * CUTOFFS - 1e-9).cast("int")  # noqa: E731  cutoff j/CUTOFFS rejects grades above j
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), grade(s).alias("grade")) for s in SIGNALS)))
    trials = found.filter(~base_failed()).join(good, "doc_id").dropDuplicates(["lang", "text_hash"])
    counts = written(trials.select("lang", each.alias("x")).groupBy("lang", "x.signal", "x.grade").count(), "counts")
    least = ceil(log(delta / (2 * len(SIGNALS))) / log(1 - alpha / len(SIGNALS)))  # of one stratum's labels, fewer are never enough
    large = counts.filter(F.col("signal") == SIGNALS[0]).groupBy("lang").agg(F.sum("count").alias("n")).filter(F.col("n") >= least).select(F.col("lang").alias("large_lang"))
    own_counts = counts.join(large, F.col("lang").eqNullSafe(F.col("large_lang"))).select("lang", "signal", "grade", "count").collect()
    pooled = counts.groupBy("signal", "grade").agg(F.sum("count").alias("count")).collect()
    seen: dict = {}
    for lang, r in [*((r.lang, r) for r in own_counts), *((POOLED, r) for r in pooled)]:
        seen.setdefault(lang, {s: np.zeros(CUTOFFS + 1, np.int64) for s in SIGNALS})[r.signal][min(max(r.grade, 0), CUTOFFS)] += r["count"]
    sizes = {lang: int(x[SIGNALS[0]].sum()) for lang, x in seen.items() if lang != POOLED}
    own, each_delta = own_strata(sizes, alpha, delta)
    out = {}
    for lang in [*own, *([POOLED] if seen else [])]:
        for s in SIGNALS:
            n, cut = int(seen[lang][s].sum()), CUTOFFS
            while cut and upper_bound(int(seen[lang][s][cut:].sum()), n, each_delta) <= alpha / len(SIGNALS):
                cut -= 1
            if cut < CUTOFFS or lang != POOLED:  # a stratum of its own without a certain cutoff rejects nothing, whatever the pool does
                out[lang, s] = cut / CUTOFFS
    return out


def judged(found: DataFrame, cutoffs: dict) -> DataFrame:
    """found with base_failed, rule (the first signal at fault, or null) and kept."""
    grade = lambda lang, s, other: round(cutoffs.get((lang, s), other) * CUTOFFS)
    own = [(lang, [grade(lang, s, 1.0) for s in SIGNALS]) for lang in {lang for lang, _ in cutoffs if lang != POOLED}]
    table_ = found.sparkSession.createDataFrame(own, "cut_lang string, cut array<int>")
    most = F.coalesce(F.col("cut"), F.array(*(F.lit(grade(POOLED, s, 1.0)) for s in SIGNALS)))
    rule = F.lit(None).cast("string")
    for k, s in reversed(list(enumerate(SIGNALS))):
        rule = F.when(F.ceil(F.col(s) * CUTOFFS - 1e-9).cast("int") > most[k], s).otherwise(rule)
    dealt = found.join(F.broadcast(table_) if len(own) <= SMALL else table_, F.col("lang").eqNullSafe(F.col("cut_lang")), "left")
    return dealt.withColumn("base_failed", base_failed()).withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("cut_lang", "cut")


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(signals(table(spark, sf_dir, "documents")), "signals")
    cutoffs = thresholds(found, table(spark, sf_dir, "labels"))
    return judged(found, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
