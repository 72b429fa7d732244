"""Choosing snapshots of a history: anchors, distances of neighbours, optimal segments, their audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T

#: Weights of changed lines, changed files and API breaks.
WEIGHTS = (0.45, 0.45, 0.10)


def anchors(tags: DataFrame) -> DataFrame:
    """One row for each commit of tags (repo, tag_ord, tag_name, commit_hash, commit_date): its highest release, the first of equals."""
    named = tags.withColumn("version", T.release_version(F.col("tag_name"))).filter(F.col("version").isNotNull())
    best = F.max_by(F.struct("tag_name", "commit_date", "version"), F.struct("version", (-F.col("tag_ord")).alias("early")))
    return named.groupBy("repo", "commit_hash").agg(best.alias("_tag")).select("repo", "commit_hash", "_tag.*").withColumn("kind", T.version_kind(F.col("version")))


def ordered(rows: DataFrame) -> DataFrame:
    """anchors with their place in the order of versions, dates breaking ties."""
    own = Window.partitionBy("repo").orderBy("version", "commit_date", "commit_hash")
    return rows.withColumn("idx", F.row_number().over(own) - 1)


def numstat(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines and files of numstat rows (added, deleted, path); "-" stands for a binary file, which has no lines."""
    n = lambda c: F.when(F.col(c) == "-", 0).otherwise(F.col(c).try_cast("long"))
    sound = lines.filter(F.col("added").isNotNull() & F.col("deleted").isNotNull() & F.col("path").isNotNull())
    return sound.groupBy(*by).agg(F.coalesce(F.sum(n("added") + n("deleted")), F.lit(0)).alias("delta_lines"), F.count(F.lit(1)).alias("delta_files"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Each anchor with the next one of its repo."""
    own = Window.partitionBy("repo").orderBy("idx")
    return rows.withColumn("next_hash", F.lead("commit_hash").over(own)).filter(F.col("next_hash").isNotNull())


def distances(pairs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """pairs (repo, idx, delta_lines, delta_files, api_break) with shares of pairs that change as much or less, and their weighted sum."""
    rank = lambda c: F.cume_dist().over(Window.partitionBy("repo").orderBy(c))
    out = pairs.withColumn("norm_lines", rank("delta_lines")).withColumn("norm_files", rank("delta_files"))
    return out.withColumn("distance", weights[0] * F.col("norm_lines") + weights[1] * F.col("norm_files") + weights[2] * F.col("api_break"))


def running(pairs: DataFrame) -> DataFrame:
    """The distance before each pair."""
    own = Window.partitionBy("repo").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("before", F.coalesce(F.sum("distance").over(own), F.lit(0.0)))


def best_segments(distance: np.ndarray, n: int, gain: str = "log1p", force_first: bool = True) -> list[int]:
    """n of len(distance) + 1 anchors with the largest sum of gains of the distances between them.

    Row k of the table holds, for each anchor, the best sum of k anchors that end there; a row follows from the one
    before in one vectorised step. Of equal sums the smallest predecessor and the smallest last anchor win.
    """
    m = len(distance) + 1
    if n >= m:
        return list(range(m))
    if n <= 0:
        return []
    if n == 1:
        return [0] if force_first else [m - 1]
    place = np.concatenate([[0.0], np.cumsum(distance)])
    span = place[None, :] - place[:, None]
    worth = np.where(np.arange(m)[:, None] < np.arange(m)[None, :], np.sqrt(np.maximum(span, 0)) if gain == "sqrt" else np.log1p(np.maximum(span, 0)), -np.inf)
    best = np.where((np.arange(m) == 0) | (not force_first), 0.0, -np.inf)
    came: list[np.ndarray] = []
    for _ in range(n - 1):
        total = best[:, None] + worth
        came.append(total.argmax(0))
        best = total.max(0)
    at = int(best.argmax())
    chosen = [at]
    for row in reversed(came):
        at = int(row[at])
        chosen.append(at)
    return chosen[::-1]


def selected(pairs: DataFrame, n: int, gain: str = "log1p", force_first: bool = True) -> DataFrame:
    """repo, position, idx of the chosen anchors. A repo's pairs, one for each release, meet in one task."""

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        idx = best_segments(own["distance"].to_numpy(), n, gain, force_first)
        return pd.DataFrame({"repo": own["repo"].iloc[0], "position": range(len(idx)), "idx": idx})

    return pairs.select("repo", "idx", "distance").groupBy("repo").applyInPandas(work, "repo string, position int, idx int")


def segments(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """What lies between each chosen anchor and the one chosen before: sums of pairs, and whether any breaks the API."""
    own = Window.partitionBy("repo").orderBy("position")
    spans = chosen.withColumn("prev_idx", F.lag("idx").over(own))
    s, p = spans.alias("s"), pairs.alias("p")
    within = (F.col("s.repo") == F.col("p.repo")) & (F.col("p.idx") >= F.col("s.prev_idx")) & (F.col("p.idx") < F.col("s.idx"))
    return s.join(p, within, "left").groupBy("s.repo", "s.position", "s.idx", "s.prev_idx").agg(
        F.coalesce(F.sum("p.distance"), F.lit(0.0)).alias("distance"), F.coalesce(F.sum("p.delta_lines"), F.lit(0)).alias("delta_lines"),
        F.coalesce(F.sum("p.delta_files"), F.lit(0)).alias("delta_files"), F.coalesce(F.max("p.api_break"), F.lit(0)).alias("api_break")).withColumn("is_first", F.col("prev_idx").isNull())


def variation(rows: DataFrame) -> DataFrame:
    """Standard deviation over mean of the segments' distances; 0 for fewer than two."""
    real = rows.filter(~F.col("is_first"))
    mean, sd, n = F.avg("distance"), F.stddev_samp("distance"), F.count(F.lit(1))
    return rows.select("repo").distinct().join(real.groupBy("repo").agg(F.when((n < 2) | (mean == 0), 0.0).otherwise(sd / mean).alias("cv")), "repo", "left").select("repo", F.coalesce("cv", F.lit(0.0)).alias("cv"))


def mean_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean distance of anchors chosen in two ways, position by position; 0 if their numbers differ."""
    sizes = a.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("repo").agg(F.count(F.lit(1)).alias("m")), "repo", "full_outer")
    both = a.select("repo", "position", F.col("idx").alias("i")).join(b.select("repo", "position", F.col("idx").alias("j")), ["repo", "position"])
    means = both.groupBy("repo").agg(F.avg(F.abs(F.col("i") - F.col("j"))).alias("shift"))
    return sizes.join(means, "repo", "left").select("repo", F.when(F.col("n") == F.col("m"), F.coalesce("shift", F.lit(0.0))).otherwise(0.0).alias("shift"))


def api_breaks(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """1 for each change whose public symbols (by, symbol, signature) differ in any way, else 0."""
    a, b = before.select(*by, "symbol", F.col("signature").alias("old")), after.select(*by, "symbol", F.col("signature").alias("new"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), [*by, "symbol"], "full_outer")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.groupBy(*by).agg(F.max(differs.cast("int")).alias("api_break"))


def ablation(pairs: DataFrame, sweeps: dict[str, tuple], n: int, gain: str = "log1p") -> DataFrame:
    """For each set of weights: how far the choice moves from that of the first set, and how even its segments are."""
    names = list(sweeps)
    chosen: dict[str, DataFrame] = {}
    out = None
    for name in names:
        weighed = distances(pairs, sweeps[name])
        chosen[name] = selected(weighed, n, gain)
        row = variation(segments(chosen[name], weighed)).join(mean_shift(chosen[names[0]], chosen[name]), "repo").select(F.lit(name).alias("sweep"), "repo", "shift", "cv")
        out = row if out is None else out.unionByName(row)
    return out


def consistent(slices: DataFrame) -> DataFrame:
    """Whether a repo's snapshots have different commits and dates that never go back."""
    own = Window.partitionBy("repo").orderBy("slice_idx")
    rows = slices.withColumn("later", F.coalesce(F.col("commit_date") >= F.lag("commit_date").over(own), F.lit(True)))
    return rows.groupBy("repo").agg(((F.count(F.lit(1)) == F.count_distinct("commit_hash")) & F.bool_and("later")).alias("consistent"))


def quality(files: DataFrame, least_files: int = 1, least_rate: float = 0.9) -> DataFrame:
    """Of files (repo, slice_idx, language, parsed): code files, their share that was parsed, and what is wrong."""
    code = F.col("language").isNotNull()
    out = files.groupBy("repo", "slice_idx").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(code).alias("code_files"), F.count_if(code & F.col("parsed")).alias("parsed_files"))
    rate = F.when(F.col("code_files") > 0, F.col("parsed_files") / F.col("code_files")).otherwise(0.0)
    few, low = F.col("code_files") < least_files, (F.col("code_files") > 0) & (rate < least_rate)
    issues = F.array_compact(F.array(F.when(few, F.format_string(f"Too few code files: %d < {least_files}", "code_files")), F.when(low, F.format_string(f"Low symbol parsing success rate: %.2f%% < {least_rate * 100:.2f}%%", rate * 100))))
    return out.withColumn("success_rate", rate).withColumn("issues", issues).withColumn("valid", ~(few | low))


