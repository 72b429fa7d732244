"""Differences between adjacent snapshots and facts over a whole chain of snapshots.

Symbols are laid out once by (repo, key) and sorted by snapshot. Adjacent differences are gaps between a row and the
one before or after it, so the full outer join of every snapshot with the next needs no join at all; first and last
presence and trajectories use the same partitioning.

Columns of a symbol table: repo, slice_idx, ord, key, ref, file_path and values. Of slices: repo, slice_idx, slice_id,
version_tag; slice_idx counts from 0 without gaps in a repo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols as S
from .qa import qa_rows

STABLE, UNCHANGED = 20, 10


def one_per_key(symbols: DataFrame, last: bool) -> DataFrame:
    """A row for each (repo, slice_idx, key): the last or the first of the file scan."""
    rest = [c for c in symbols.columns if c not in ("repo", "slice_idx", "key")]
    pick = F.max_by if last else F.min_by
    out = symbols.groupBy("repo", "key", "slice_idx").agg(pick(F.struct(*rest), F.col("ord")).alias("row"))
    return out.select("repo", "key", "slice_idx", *(F.col(f"row.{c}").alias(c) for c in rest))


def labelled(slices: DataFrame) -> DataFrame:
    return slices.select("repo", "slice_idx", "slice_id", S.version_label(F.col("version_tag"), F.col("slice_id")).alias("label"))


def transitions(symbols: DataFrame, slices: DataFrame) -> DataFrame:
    """repo, key, status (added, removed, stable), prev, curr and the names of both snapshots, for each adjacent pair."""
    rows = one_per_key(symbols, last=True)
    value = F.struct(*(c for c in rows.columns if c not in ("repo", "key")))
    own = Window.partitionBy("repo", "key").orderBy("slice_idx")
    near = rows.select("repo", "key", value.alias("curr"), F.lag(value).over(own).alias("prev"), F.lead("slice_idx").over(own).alias("next_idx"))
    at = F.col("curr.slice_idx")
    stable = F.coalesce(F.col("prev.slice_idx") == at - 1, F.lit(False))
    none = F.lit(None)
    here = F.struct(F.when(stable, "stable").otherwise("added").alias("status"), F.when(stable, F.col("prev")).alias("prev"), F.col("curr").alias("curr"), (at - 1).alias("from_idx"))
    gone = F.struct(F.lit("removed").alias("status"), F.col("curr").alias("prev"), F.when(F.lit(False), F.col("curr")).alias("curr"), at.alias("from_idx"))
    left = F.coalesce(F.col("next_idx") != at + 1, F.lit(True))
    events = near.select("repo", "key", F.explode(F.when(left, F.array(here, gone)).otherwise(F.array(here))).alias("_event")).select("repo", "key", "_event.*")
    names = labelled(slices)
    first = names.select("repo", F.col("slice_idx").alias("from_idx"), F.col("slice_id").alias("from_slice_id"), F.col("label").alias("prev_v"))
    second = names.select("repo", (F.col("slice_idx") - 1).alias("from_idx"), F.col("slice_id").alias("to_slice_id"), F.col("label").alias("curr_v"))
    return events.join(first.join(second, ["repo", "from_idx"]), ["repo", "from_idx"])


def stride(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """At most n rows of each group, evenly spread in the order; places are cut down from doubles."""
    own = Window.partitionBy(*by)
    numbered = rows.withColumn("place", F.row_number().over(own.orderBy(order)) - 1).withColumn("total", F.count(F.lit(1)).over(own))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("total").cast("double") / n)).cast("int"))
    return numbered.filter((F.col("total") <= n) | F.array_contains(places, F.col("place"))).drop("place", "total")


def set_change(before: Column, after: Column) -> Column:
    """added: ...; removed: ... of two sets, null if they are equal."""
    empty = F.array().cast("array<string>")
    side = lambda name, x, y: F.when(F.size(F.array_except(x, y)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(F.array_except(x, y)), ", ")))
    a, b = F.coalesce(before, empty), F.coalesce(after, empty)
    both = F.concat_ws("; ", side("added", b, a), side("removed", a, b))
    return F.when(both != "", both)


def from_to(before: Column, after: Column) -> Column:
    return F.concat(F.lit("from: "), before, F.lit(" ; to: "), after)


def change_questions(moves: DataFrame, kind: str, subtype: str) -> DataFrame:
    """The rows of one subtype of adjacent differences. kind: function or class; moves: transitions()."""
    what = "function/method" if kind == "function" else "class"
    name = subtype.removeprefix(f"{kind}_")
    side = "prev" if name in ("removed", "not_removed") else "curr"
    ref, path = F.col(f"{side}.ref"), F.col(f"{side}.file_path")
    between = lambda head, tail: F.concat(F.lit(head), ref, F.lit(tail), F.lit("between "), F.col("prev_v"), F.lit(" and "), F.col("curr_v"), F.lit("?"))
    pair = ["repo", "from_idx"]
    stable = moves.filter("status = 'stable'")
    p, c = (lambda x: F.col(f"prev.{x}")), (lambda x: F.col(f"curr.{x}"))
    signature = lambda s: S.blank(s("signature"), s("params"))
    returns = lambda s: S.blank(s("return_type"), F.lit("unknown"))
    yes, no = F.lit("Yes"), F.lit("No")
    if name in ("introduced", "removed"):
        rows, question, answer = moves.filter(F.col("status") == {"introduced": "added"}.get(name, name)), between(f"Was {what} ", f" {name} "), yes
    elif name in ("not_introduced", "not_removed"):
        rows, question, answer = stride(stable, pair, "key", STABLE), between(f"Was {what} ", f" {name.removeprefix('not_')} "), no
    elif name == "signature_changed":
        rows, question, answer = stable.filter(signature(p) != signature(c)), between(f"How did the signature of {what} ", " change "), from_to(signature(p), signature(c))
    elif name == "return_type_changed":
        rows, question, answer = stable.filter(returns(p) != returns(c)), between(f"Did the return type of {what} ", " change "), from_to(returns(p), returns(c))
    elif name in ("calls_changed", "instantiations_changed"):
        column, of = ("calls", "functions called") if name == "calls_changed" else ("instantiations", "classes instantiated")
        answer = set_change(p(column), c(column))
        rows, question = stable.filter(answer.isNotNull()), between(f"Did the set of {of} within ", " change ")
    elif name == "signature_unchanged":
        rows, question, answer = stride(stable.filter(signature(p) == signature(c)), pair, "key", UNCHANGED), between(f"Did the signature of {what} ", " change "), no
    elif name == "return_type_unchanged":
        rows, question, answer = stride(stable.filter(returns(p) == returns(c)), pair, "key", UNCHANGED), between(f"Did the return type of {what} ", " change "), no
    elif name == "inheritance_changed":
        rows, question, answer = stable.filter(p("base_classes") != c("base_classes")), between("How did the inheritance of class ", " change "), from_to(S.list_text(p("base_classes")), S.list_text(c("base_classes")))
    elif name == "inheritance_unchanged":
        rows, question, answer = stride(stable.filter(p("base_classes") == c("base_classes")), pair, "key", UNCHANGED), between("Did the inheritance of class ", " change "), no
    else:
        raise ValueError(subtype)
    return qa_rows(rows, "temporal", subtype, question, answer, ref, path, kind=kind, from_id=F.col("from_slice_id"), to_id=F.col("to_slice_id"), keyed=True)


def ends(slices: DataFrame) -> DataFrame:
    """First and last snapshot of each repo, and their number."""
    row = F.struct("slice_idx", "slice_id", "label")
    return labelled(slices).groupBy("repo").agg(F.min_by(row, "slice_idx").alias("first"), F.max_by(row, "slice_idx").alias("last"), F.count(F.lit(1)).alias("n_slices"))


def presence_questions(symbols: DataFrame, slices: DataFrame, kind: str, which: str) -> DataFrame:
    """first_introduced or last_present: keys that the first, or the last, snapshot of their repo doesn't hold."""
    what = "function/method" if kind == "function" else "class"
    least = F.min_by(F.struct("ref", "file_path"), F.struct("slice_idx", "ord"))
    span = symbols.groupBy("repo", "key").agg(F.min("slice_idx").alias("from_idx"), F.max("slice_idx").alias("to_idx"), least.alias("row"))
    names, bounds = labelled(slices), ends(slices)
    first = which == "first_introduced"
    at, bound = ("from_idx", "first") if first else ("to_idx", "last")
    rows = span.join(bounds, "repo").filter((F.col("n_slices") >= 2) & (F.col(at) != F.col(f"{bound}.slice_idx"))).join(names.select("repo", F.col("slice_idx").alias(at), F.col("label")), ["repo", at])
    question = F.concat(F.lit(f"In which version was {what} "), F.col("row.ref"), F.lit(" first introduced?" if first else " last present?"))
    return qa_rows(rows, "temporal", f"{kind}_{which}", question, F.col("label"), F.col("row.ref"), F.col("row.file_path"), kind=kind, from_id=F.col("first.slice_id"), to_id=F.col("last.slice_id"), keyed=True)


def trajectory_questions(symbols: DataFrame, slices: DataFrame, kind: str, which: str, value: Column) -> DataFrame:
    """Runs of equal values of a key over its repo's snapshots, for keys with two runs or more and three snapshots."""
    what = "function/method" if kind == "function" else "class"
    own = Window.partitionBy("repo", "key").orderBy("slice_idx")
    rows = one_per_key(symbols.withColumn("value", value).select("repo", "slice_idx", "key", "ord", "ref", "file_path", "value"), last=False)
    runs = rows.withColumn("before", F.lag("value").over(own)).withColumn("new_run", F.col("before").isNull() | (F.col("before") != F.col("value")))
    runs = runs.join(labelled(slices).select("repo", "slice_idx", "label"), ["repo", "slice_idx"])
    step = F.struct("slice_idx", F.concat(F.col("label"), F.lit(": "), F.col("value")).alias("text"))
    found = runs.groupBy("repo", "key").agg(F.array_sort(F.collect_list(F.when(F.col("new_run"), step))).alias("steps"), F.min_by(F.struct("ref", "file_path"), F.struct("slice_idx", "ord")).alias("row"))
    found = found.filter(F.size("steps") >= 2).join(ends(slices), "repo").filter("n_slices >= 3")
    topic = {"return_type_evolution": "return type", "signature_evolution": "signature", "inheritance_evolution": "inheritance"}[which]
    question = F.concat(F.lit(f"How did the {topic} of {what} "), F.col("row.ref"), F.lit(" evolve from "), F.col("first.label"), F.lit(" to "), F.col("last.label"), F.lit("?"))
    answer = F.array_join(F.transform("steps", lambda s: s["text"]), " -> ")
    return qa_rows(found, "temporal", f"{kind}_{which}", question, answer, F.col("row.ref"), F.col("row.file_path"), kind=kind, from_id=F.col("first.slice_id"), to_id=F.col("last.slice_id"), keyed=True)
