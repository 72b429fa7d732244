"""Evaluation results: scores of each answer and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A


def scored(results: DataFrame) -> DataFrame:
    """results (qa_type, qa_subtype, prediction, ground_truth) with metrics, a map that is empty without prediction."""
    return results.withColumn("metrics", A.metrics(F.col("prediction"), F.col("ground_truth"), F.col("qa_type"), F.col("qa_subtype")))


def means(results: DataFrame) -> DataFrame:
    """qa_type, qa_subtype, metric, mean: sums of a metric over all rows of the subtype that have any metric."""
    rows = results.filter(F.size("metrics") > 0)
    by = ["qa_type", "qa_subtype"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sums = rows.select(*by, F.explode("metrics").alias("metric", "value")).groupBy(*by, "metric").agg(F.sum("value").alias("total"))
    return sums.join(sizes, by).select(*by, "metric", (F.col("total") / F.col("n")).alias("mean"))


def counts(results: DataFrame) -> DataFrame:
    """Answers without prediction, without context, and all."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("prediction").isNull()).alias("no_prediction"), F.count_if(~F.col("context_retrieved")).alias("context_missing"))


def summary_lines(results: DataFrame, repo: str, tag: str, model: str, mode: str) -> list[str]:
    """The summary text of one run; one row for each subtype and metric comes to the driver."""
    c = counts(results).first()
    label = "Context absent" if mode == "question_only" else "Context missing"
    lines = [f"=== Evaluation summary ({repo} / {tag}) ===", f"  Model           : {model}", f"  Prompt mode     : {mode}", f"  Total evaluated : {c.total}", f"  No prediction   : {c.no_prediction}", f"  {label:<15}: {c.context_missing}", "", "  Metrics by subtype:"]
    by: dict[str, list[str]] = {}
    for r in means(results).orderBy("qa_type", "qa_subtype", "metric").collect():
        by.setdefault(f"{r.qa_type}/{r.qa_subtype}", []).append(f"{r.metric}={r['mean']:.4f}")
    return [*lines, *(f"    {k}: {', '.join(v)}" for k, v in by.items())]


def safe_name(model: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "__", model.strip()).strip("._-") or "unknown_model"
