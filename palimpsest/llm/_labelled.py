"""Labelled rows for learning, drawn by a bound, and what is worked out for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out


def drawn(labels: DataFrame, column: str, most: int, salt: int = 0) -> DataFrame:
    """doc_id, y, share of at most `most` labelled documents of each class that aren't held out, in a fixed random order.

    share: labelled documents of the class for each one drawn. A document labelled several times counts once, as the
    larger label. The result has at most 2 * most rows, whatever the input.
    """
    one = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    parts = [
        one.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most).withColumn("share", F.lit(max(1.0, counts.get(y, 0) / most)))
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def joined(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id and text of docs in the sample, with y and share; the sample's size is bounded, so it is sent to all."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
