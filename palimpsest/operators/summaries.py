"""Counts of what a run has read and made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(content: Column) -> Column:
    """Lines of a text; a last line without an end counts, an empty text has none."""
    return F.when(content == "", 0).otherwise(F.length(content) - F.length(F.replace(content, F.lit("\n"))) + F.when(content.endswith("\n"), 0).otherwise(1))


def repository_totals(files: DataFrame, content: str = "content") -> DataFrame:
    """Files and text lines of each repo, without those of the version control itself."""
    own = files.filter(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    return own.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum(lines_of(F.col(content))), F.lit(0)).alias("total_lines"))


def slice_statistics(files: DataFrame) -> DataFrame:
    """Files of each snapshot by language; those without one are unknown."""
    name = F.coalesce("language", F.lit("unknown"))
    by = files.groupBy("repo", "slice_idx", name.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("repo", "slice_idx").agg(F.sum("n").alias("total_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def dataset_summary(slices: DataFrame) -> DataFrame:
    """Totals of a repo's snapshots (files, lines, functions, classes) and how many of each type there are."""
    sums = slices.groupBy("repo").agg(F.count(F.lit(1)).alias("n_slices"), *(F.sum(c).alias(f"total_{c}") for c in ("files", "lines", "functions", "classes")))
    types = slices.groupBy("repo", "slice_type").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slice_type", "n")))).alias("slice_types"))
    return sums.join(types, "repo")
