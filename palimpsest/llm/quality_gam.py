"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns a lookup table for each feature of a text, then one for each chosen pair of
features. A score is the sum of a text's table entries, read for a whole batch at once, so every score can be
explained by its parts. Features are rates of a whole text: word lengths, signs, capitals, repeats of words, lines and
windows, sentence ends. Language, source and id are no features.

At most MOST labelled texts of each class are learnt from, the classes weighed back to their shares; every text is
scored. Held-out labels are never read.

Cases: null and empty texts have all features 0 and the score the tables give these. Without labels of both classes
the score is the share of label 1, or 0.5 without any. A document labelled several times counts once, as the larger
label. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._boost import Additive
from ._labelled import drawn, joined
from ._shared import held_out, kept, table, text_bytes
from ._words import WordTable, owners, repeated_windows, sums
from .risk_rules import NOT_SYMBOL, dup_lines
from .token_files import slices

MOST = 4000
FEATURES = ("log_words", "word_length", "symbol_words", "bars", "shouted", "capitals", "digits", "ends", "short", "long", "different", "stutter", "most_common", "dup_lines", "line_words", "repeats")
NOT_LETTER_END = (b".", b"!", b"?")


def describe(words: list[bytes]) -> np.ndarray:
    """length, holds signs, is a bar, shouted, capitalised, holds digits, ends a sentence, short, long: of each word."""
    out = np.zeros((len(words), 9), np.float32)
    for k, w in enumerate(words):
        n = len(w) if w.isascii() else len(w.decode("utf-8", "replace"))
        low = w.lower()
        out[k] = n, len(w.translate(None, NOT_SYMBOL)) > 0, w == b"|", n > 2 and w.upper() == w != low, w != low, any(48 <= b < 58 for b in w), w[-1:] in NOT_LETTER_END, n <= 3, n >= 12
    return out


def rows(texts: list[bytes]) -> np.ndarray:
    """FEATURES of each text."""
    words = kept("quality_gam", lambda: WordTable(9, describe))
    codes, ends = words.look_up(texts)
    if not len(codes):
        return np.zeros((len(texts), len(FEATURES)))
    n = np.diff(ends)
    some = np.maximum(n, 1).astype(float)
    length, signs, bars, shouted, capitals, digits, stops, short, long_ = (sums(words.rows[codes], ends) / some[:, None]).T
    keys = np.sort((owners(ends) << 32) | codes)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, of = np.diff(np.append(first, len(keys))), keys[first] >> 32
    different, most = np.bincount(of, minlength=len(texts)), np.zeros(len(texts))
    np.maximum.at(most, of, counts)
    again = np.zeros(len(codes), np.int64)
    again[1:] = codes[1:] == codes[:-1]
    again[ends[:-1][n > 0]] = 0
    lines = np.array([dup_lines(t) for t in texts], float).reshape(-1, 2)
    out = np.stack([np.log1p(n), length, signs, bars, shouted, capitals, digits, stops, short, long_, different / some, sums(again, ends) / some, most / some, lines[:, 0] / np.maximum(lines[:, 1], 1), n / np.maximum(lines[:, 1], 1), repeated_windows(codes, ends, 8) / some], axis=1)
    out[n == 0] = 0
    return out


class Model:
    def __init__(self, tables: Additive | None, rate: float):
        self.tables, self.rate = tables, rate

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.rate) if self.tables is None else self.tables.score(rows(texts))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text); labels: (doc_id, quality), of which held-out rows are never used."""
    sample = drawn(labels, "quality", MOST, salt=3)

    def work(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for x in slices(texts):
                ids, y, share = (batch.column(k)[x.start : x.stop] for k in (3, 1, 2))
                yield pa.RecordBatch.from_arrays([ids, y, share, pa.array(list(rows(texts[x])), pa.list_(pa.float64()))], ["doc_id", "y", "share", "x"])

    found = joined(docs, sample).select(text_bytes().alias("text"), "y", "share", "doc_id").mapInArrow(work, "doc_id long, y int, share double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * MOST).collect()
    if not found:
        return Model(None, 0.5)
    y, w = np.array([r.y for r in found], float), np.array([r.share for r in found])
    if y.min() == y.max():
        return Model(None, float(y[0]))
    return Model(Additive().fit(np.array([r.x for r in found]), y, w), float(np.average(y, weights=w)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[x.start : x.stop], pa.array(sent.value.scores(texts[x]), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(work, "doc_id long, score double")


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
