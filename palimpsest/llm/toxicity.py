"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a lexicon (of all entries, of strong ones, of different ones), lexicon words near the second
person, capitals, exclamation and question marks, and rates of obfuscation (letters swapped for digits or signs,
letters parted by dots or dashes, lexicon words seen only after that is undone). The lexicon is learnt: words and word
beginnings that are in many more toxic than clean labelled texts. Lexicon, trees and calibration each learn from
documents of their own. The labelled sample is bounded: MOST documents of each class for the trees and LEXICON_DOCS for
the lexicon; counts and scores cover every text.

Cases: null and empty texts have no words and get the score of a text without any sign. Without toxic or without clean
labels, the score is the share of toxic labels, or 0 without any. Repeated rows get equal scores. A document labelled
several times is toxic if any label says so. Held-out labels are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._boost import Isotonic, Trees
from ._labelled import drawn, joined
from ._shared import held_out, kept, table, text_bytes, trimmed
from ._words import WordTable, sums
from .token_files import slices

MOST, LEXICON_DOCS, ENTRIES, NEAR, LIMIT = 4000, 1200, 400, 5, 0.7
FEATURES = ("hits", "strong", "distinct", "per_word", "strong_per_word", "near_second", "hidden", "capitals", "shouted", "marks", "swapped", "parted", "log_words")
#: Second-person words of the four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú usted su tus ti".split())
#: What digits and signs stand for in disguised words.
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SWAPPED = re.compile(r"[^\W\d_][0-9@$!*][^\W\d_]")
PARTED = re.compile(r"(?:[^\W\d_][.\-_*]){2,}[^\W\d_]")
SHORT, LONG = 3, 9


def bare(word: bytes) -> tuple[str, str]:
    """The word in lower case without signs at its ends, and undisguised."""
    text = word.decode("utf-8", "replace")
    plain = EDGE.sub("", text).lower()
    undone = re.sub(r"[\W_]+", "", text.lower().translate(SWAPS)) if not plain.isalpha() else plain
    return plain, undone


def beginnings(word: str) -> list[str]:
    """Beginnings of a word that may be entries; a whole word is marked by a final space."""
    if len(word) < SHORT:
        return []
    return [*(word[:k] for k in range(SHORT, min(len(word), LONG) + 1)), word + " "]


def learnt_lexicon(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Entry -> log ratio of its shares of toxic and clean documents."""
    sample = drawn(labels, "toxic", LEXICON_DOCS, salt=1)

    def counted(batches):
        for batch in batches:
            found = {0: Counter(), 1: Counter()}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[y].update({p for w in {bare(w)[0] for w in set(text.split())} for p in beginnings(w)})
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = joined(docs, sample).select(text_bytes().alias("text"), "y").mapInArrow(counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1) / ((F.col("clean") + 0.5) / (n[0] + 1)))
    best = counts.filter(F.col("toxic") >= max(3, n[1] // 200)).withColumn("ratio", ratio).filter(F.col("ratio") > 1.2).orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "entry").limit(ENTRIES)
    return {r.entry: r.ratio for r in best.collect()}


STRONG = 3.0


class Features:
    """Features of texts, with a memo of words."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.words = lexicon, WordTable(9, self.describe)

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(b, 0.0) for b in beginnings(word)), default=0.0)

    def describe(self, words: list[bytes]) -> np.ndarray:
        """weight, hidden, second person, letters, capitals, shouted, marks, swapped, parted: of each word."""
        out = np.zeros((len(words), 9), np.float32)
        for k, w in enumerate(words):
            plain, undone = bare(w)
            weight = self.weight(plain)
            hidden = 0.0
            if undone != plain and len(undone) >= SHORT:
                hidden = self.lexicon.get(undone + " ", 0.0)
                weight = max(weight, hidden)
            text = w.decode("utf-8", "replace")
            upper = sum(map(str.isupper, text)) if text != text.lower() else 0
            odd = not plain.isalpha()
            out[k] = weight, hidden > 0, plain in SECOND, len(plain), upper, upper > 1 and text.upper() == text, w.count(b"!") + w.count(b"?"), odd and bool(SWAPPED.search(text)), odd and bool(PARTED.search(text))
        return out

    def rows(self, texts: list[bytes]) -> np.ndarray:
        codes, ends = self.words.look_up(texts)
        n = np.maximum(np.diff(ends), 1).astype(float)
        if not len(codes):
            return np.zeros((len(texts), len(FEATURES)))
        x = self.words.rows[codes]
        hit, strong = x[:, 0] > 0, x[:, 0] >= STRONG
        weight, hidden, _, letters, upper, shouted, marks, swapped, parted = sums(x, ends).T
        total = np.concatenate([[0], np.cumsum(x[:, 2])])
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        low, high = np.maximum(np.arange(len(codes)) - NEAR, ends[owner]), np.minimum(np.arange(len(codes)) + NEAR + 1, ends[owner + 1])
        near = hit & (total[high] > total[low])
        where = np.flatnonzero(hit)
        kinds = np.bincount(np.unique((owner[where] << 32) | codes[where]) >> 32, minlength=len(texts)) if len(where) else np.zeros(len(texts))
        hits, strongs = sums(hit, ends), sums(strong, ends)
        return np.stack([hits, strongs, kinds, weight / n, strongs / n, sums(near, ends), hidden, upper / np.maximum(letters, 1), shouted / n, marks / n, swapped / n, parted / n, np.log1p(np.diff(ends))], axis=1)


class Model:
    """Features, trees and calibration, as sent to executors: a few hundred numbers."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.curve, self.rate = lexicon, trees, curve, rate

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        name = ("toxicity", hash(tuple(sorted(self.lexicon.items()))))
        rows = kept(name, lambda: Features(self.lexicon)).rows(texts)
        return np.clip(self.curve.rates(self.trees.margin(rows)), 0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic), of which held-out rows are never used."""
    third = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id").cast("long")), F.lit(3)) == 0
    lexicon = learnt_lexicon(docs, labels.filter(third))
    sample = drawn(labels.filter(~third), "toxic", MOST, salt=2)

    def work(batches):
        own = Features(lexicon)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for x in slices(texts):
                y, share, ids = (batch.column(k)[x.start : x.stop] for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([ids, y, share, pa.array(list(own.rows(texts[x])), pa.list_(pa.float64()))], ["doc_id", "y", "share", "x"])

    rows = joined(docs, sample).select(text_bytes().alias("text"), "y", "share", "doc_id").mapInArrow(work, "doc_id long, y int, share double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * MOST).collect()
    y = np.array([r.y for r in rows], float)
    if not rows or y.min() == y.max():
        few = drawn(labels, "toxic", 2 * MOST, salt=1).agg(F.sum(F.col("y") * F.col("share")), F.sum("share")).first()
        return Model(lexicon, None, None, float((few[0] or 0) / few[1]) if few[1] else 0.0)
    x, w = np.array([r.x for r in rows]), np.array([r.share for r in rows])
    fit = np.arange(len(rows)) % 4 != 0
    if y[fit].min() == y[fit].max() or y[~fit].min() == y[~fit].max():
        fit = np.ones(len(rows), bool)
    trees = Trees().fit(x[fit], y[fit], w[fit])
    held = ~fit if not fit.all() else fit
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[held]), y[held], w[held]), float(np.average(y, weights=w)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column toxicity added; all other columns are kept."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "toxicity"]
    schema = docs.select(*names).withColumn("toxicity", F.lit(0.0)).schema
    at = names.index("text")

    def work(batches):
        own = sent.value
        for batch in batches:
            texts = [x.encode() if x is not None else b"" for x in batch.column(at).to_pylist()]
            found = [own.scores(texts[x]) for x in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], [*names, "toxicity"])
        trimmed()

    return docs.select(*names).mapInArrow(work, schema)


def without_text(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and toxicity only: texts don't come back from the workers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[x.start : x.stop], pa.array(own.scores(texts[x]), pa.float64())], ["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(work, "doc_id long, toxicity double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = without_text(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= LIMIT).cast("int").alias("predicted"))
