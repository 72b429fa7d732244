"""Facts within one snapshot: projections of a symbol, and who calls, extends, implements or instantiates it.

Edges are arrays of names on symbols. A lookup by name explodes the array, groups it by (snapshot, name) and joins the
result: aggregation before the join keeps one row for each name, and nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols as S
from .qa import qa_rows

AT = ["repo", "slice_idx"]


def referrers(symbols: DataFrame, edges: str, distinct: bool) -> DataFrame:
    """repo, slice_idx, target, who: the references of symbols that name target in an array column.

    distinct: sorted without repeats; else in the order of the file scan, repeats kept.
    """
    flat = symbols.select(*AT, "ord", "ref", F.posexplode(edges).alias("pos", "target"))
    if distinct:
        return flat.groupBy(*AT, "target").agg(F.array_sort(F.collect_set("ref")).alias("who"))
    return flat.groupBy(*AT, "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref", "pos"))), lambda x: x["ref"]).alias("who"))


def absent(symbols: DataFrame) -> DataFrame:
    """repo, slice_idx, ref of symbols that other snapshots of the repo have and this one doesn't.

    For n present references the first max(1, n // 10) absent ones in order, so as many rows at most as are present.
    """
    here = symbols.select(*AT, "ref").distinct()
    sizes = here.groupBy(*AT).agg(F.count(F.lit(1)).alias("n"))
    all_refs = here.select("repo", "ref").distinct()
    missing = all_refs.join(sizes, "repo").join(here, [*AT, "ref"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*AT).orderBy("ref"))
    return missing.withColumn("place", place).filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).select(*AT, "ref")


def joined_or_none(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none")


#: subtype -> (question before and after the reference, column, only if not empty); projections of functions.
FUNCTION_FACTS = {
    "function_parameters": ("What are the parameters of function/method ", "?", "params", False),
    "function_return_type": ("What is the return type of function/method ", "?", "return_type", True),
    "symbol_callers": ("What other functions or methods does function/method ", " call internally?", "calls", True),
    "object_instantiations": ("What classes/objects does function/method ", " instantiate internally?", "instantiations", True),
    "field_accesses": ("What class fields/attributes does function/method ", " access or manipulate internally?", "field_accesses", True),
}
CLASS_FACTS = {
    "class_inheritance": ("What base classes does class ", " inherit from?", "base_classes"),
    "class_implemented_interfaces": ("What interfaces does class ", " implement?", "implemented_interfaces"),
    "class_methods": ("What methods does class ", " have?", "methods"),
    "class_fields": ("What fields/attributes does class ", " have?", "fields"),
}


def labelled(symbols: DataFrame, slices: DataFrame) -> DataFrame:
    return symbols.join(slices.select(*AT, "slice_id", S.version_label(F.col("version_tag"), F.col("slice_id")).alias("label")), AT)


def _rows(df: DataFrame, subtype: str, kind: str, head: str, tail, answer: Column, name: Column | None = None, path: Column | None = None) -> DataFrame:
    name = F.col("ref") if name is None else name
    question = F.concat(F.lit(head), name, tail if isinstance(tail, Column) else F.lit(tail))
    return qa_rows(df, "intrinsic", subtype, question, answer, name, F.col("file_path") if path is None else path, kind=kind, slice_id=F.col("slice_id"))


def existence(symbols: DataFrame, slices: DataFrame, kind: str) -> DataFrame:
    """Yes for every symbol, No for absent ones."""
    subtype, what = ("symbol_existence", "function/method") if kind == "function" else ("class_existence", "class")
    tail = F.concat(F.lit(" exist in version "), F.col("label"), F.lit("?"))
    there = _rows(labelled(symbols, slices), subtype, kind, f"Does {what} ", tail, F.lit("Yes"))
    return there.unionByName(_rows(labelled(absent(symbols), slices), subtype, kind, f"Does {what} ", tail, F.lit("No"), path=F.lit("")))


def location(functions: DataFrame, classes: DataFrame, slices_f: DataFrame, slices_c: DataFrame) -> DataFrame:
    parts = [_rows(labelled(df, s), "symbol_location", kind, f"Which file is {what} ", " located in?", F.col("file_path")) for df, s, kind, what in ((functions, slices_f, "function", "function/method"), (classes, slices_c, "class", "class"))]
    return parts[0].unionByName(parts[1])


def signature(functions: DataFrame, slices: DataFrame) -> DataFrame:
    whole = S.complete_signature(F.col("signature"), F.col("params"), F.col("return_type"))
    return _rows(labelled(functions, slices), "function_signature", "function", "What is the signature of function/method ", "?", whole)


def function_fact(functions: DataFrame, slices: DataFrame, subtype: str) -> DataFrame:
    head, tail, column, only = FUNCTION_FACTS[subtype]
    is_list = dict(functions.dtypes)[column].startswith("array")
    value = F.array_join(column, ", ") if is_list else F.col(column)
    rows = functions.filter((F.size(column) > 0) if is_list else (S.text(F.col(column)) != "")) if only else functions
    return _rows(labelled(rows, slices), subtype, "function", head, tail, value)


def class_fact(classes: DataFrame, slices: DataFrame, subtype: str) -> DataFrame:
    head, tail, column = CLASS_FACTS[subtype]
    return _rows(labelled(classes, slices), subtype, "class", head, tail, joined_or_none(F.col(column)))


def looked_up(symbols: DataFrame, referring: DataFrame, slices: DataFrame, subtype: str) -> DataFrame:
    """class_subclasses, symbol_call_sites, class_instantiation_sites: referring are the symbols that hold the edges."""
    edges, head, tail, kind, distinct = {
        "class_subclasses": ("base_classes", "What subclasses does class ", " have?", "class", False),
        "symbol_call_sites": ("calls", "What functions or methods call ", " internally?", "function", True),
        "class_instantiation_sites": ("instantiations", "Which functions/methods instantiate class ", " internally?", "class", True),
    }[subtype]
    who = referrers(referring, edges, distinct).withColumnRenamed("target", "ref")
    rows = symbols.join(who, [*AT, "ref"], "left" if subtype == "class_subclasses" else "inner")
    return _rows(labelled(rows, slices), subtype, kind, head, tail, F.when(F.col("who").isNull(), "none").otherwise(F.array_join("who", ", ")))


def implementors(classes: DataFrame, slices: DataFrame) -> DataFrame:
    """For each class and interface of it, all classes with that interface."""
    who = referrers(classes, "implemented_interfaces", False)
    rows = classes.select(*AT, "file_path", F.explode("implemented_interfaces").alias("target")).join(who, [*AT, "target"])
    return _rows(labelled(rows, slices), "interface_implementors", "interface", "What classes implement interface ", "?", F.array_join("who", ", "), name=F.col("target"))
