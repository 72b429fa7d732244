"""Snapshots that arrive one after the other: each key's changes against the last snapshot that held it.

An extension: batch operators need none of this. Rows (repo, key, slice_idx, value) come in order of snapshots within a
micro-batch or over several; the state of a key is the last snapshot and value seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "repo string, key string, slice_idx int, status string, before string, after string"


def changes(rows: DataFrame) -> DataFrame:
    """added (new, or back after a gap), changed or stable, for each key and snapshot of a stream."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("slice_idx").itertuples(index=False):
            if last is not None and row.slice_idx <= last:
                continue  # a repeat, or one that comes too late to compare
            near = last is not None and row.slice_idx == last + 1
            out.append((*group, row.slice_idx, "stable" if near and row.value == value else "changed" if near else "added", value if near else None, row.value))
            last, value = row.slice_idx, row.value
        state.update((None if last is None else int(last), value))
        yield pd.DataFrame(out, columns=["repo", "key", "slice_idx", "status", "before", "after"])

    return rows.select("repo", "key", F.col("slice_idx").cast("int").alias("slice_idx"), F.col("value").cast("string").alias("value")).groupBy("repo", "key").applyInPandasWithState(step, CHANGES, "last int, value string", "append", "NoTimeout")


def activity(events: DataFrame, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Events and values by window and type; rows later than `late` behind the newest are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
