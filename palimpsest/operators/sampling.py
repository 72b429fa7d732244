"""Stratified samples under a budget: filters, balance, caps, shares by weight, repair of rounding, the draw.

A question has repo, qa_type, qa_subtype, answer, file_path and qa_id. Orders that were random are orders of a hash of
the seed and the identifier here, so a draw can be repeated and is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.symbols import is_test_path, text

#: Shares of types, weights of subtypes, and what is filtered how.
TYPE_SHARES = {"intrinsic": 0.48, "extrinsic": 0.10, "temporal": 0.42}
SUBTYPE_WEIGHTS = {
    "intrinsic": {
        "function_signature": 5.0, "function_return_type": 4.0, "function_parameters": 2.0, "symbol_callers": 3.0, "class_inheritance": 3.0, "class_methods": 2.5, "class_fields": 2.5, "field_accesses": 2.0, "object_instantiations": 2.0,
        "class_instantiation_sites": 2.0, "class_implemented_interfaces": 2.0, "interface_implementors": 2.0, "class_subclasses": 1.5, "symbol_existence": 0.5, "symbol_location": 0.2, "class_existence": 0.3, "symbol_call_sites": 1.0,
    },
    "extrinsic": {"__all__": 1.0},
    "temporal": {
        "function_signature_evolution": 5.0, "function_signature_changed": 5.0, "function_return_type_evolution": 4.0, "function_return_type_changed": 4.0, "function_calls_changed": 4.0, "class_inheritance_evolution": 4.0, "class_inheritance_changed": 4.0, "function_instantiations_changed": 3.0,
        "function_introduced": 1.5, "function_removed": 1.5, "class_introduced": 1.5, "class_removed": 1.5, "function_first_introduced": 0.3, "function_last_present": 0.3, "class_first_introduced": 0.3, "class_last_present": 0.3,
        "function_not_introduced": 5.0, "function_not_removed": 5.0, "class_not_introduced": 5.0, "class_not_removed": 5.0, "function_signature_unchanged": 10.0, "function_return_type_unchanged": 10.0, "class_inheritance_unchanged": 10.0,
    },
}
BINARY = ("symbol_existence", "symbol_location", "class_existence", "function_introduced", "function_removed", "class_introduced", "class_removed", "function_not_introduced", "function_not_removed", "class_not_introduced", "class_not_removed", "function_signature_unchanged", "function_return_type_unchanged", "class_inheritance_unchanged")
TRIVIAL_SUBTYPES = ("class_subclasses", "class_implemented_interfaces", "class_methods", "class_fields", "function_parameters", "interface_implementors")
TRIVIAL_ANSWERS = ("none", "()", "[]", "{}")
PER_FILE, POOL_CAP, SEED = 8, 2000, 42


def weight_table(spark: SparkSession, weights: dict = SUBTYPE_WEIGHTS) -> DataFrame:
    return spark.createDataFrame([(t, s, w) for t, own in weights.items() for s, w in own.items()], "qa_type string, weight_subtype string, weight double")


def weighted(pool: DataFrame, weights: DataFrame) -> DataFrame:
    """pool with the weight of its subtype, of its type's __all__, or 1; weight 0 is left out. The table is a few rows."""
    own = weights.filter("weight_subtype <> '__all__'").withColumnRenamed("weight_subtype", "qa_subtype")
    rest = weights.filter("weight_subtype = '__all__'").select("qa_type", F.col("weight").alias("all_weight"))
    out = pool.join(F.broadcast(own), ["qa_type", "qa_subtype"], "left").join(F.broadcast(rest), "qa_type", "left")
    return out.withColumn("weight", F.coalesce("weight", "all_weight", F.lit(1.0))).drop("all_weight").filter("weight <> 0")


def telling(pool: DataFrame) -> DataFrame:
    """Without answers that only say there is nothing, for the subtypes where that says little."""
    return pool.filter(~(F.col("qa_subtype").isin(*TRIVIAL_SUBTYPES) & F.lower(F.trim(text(F.col("answer")))).isin(*TRIVIAL_ANSWERS)))


def production(pool: DataFrame) -> DataFrame:
    return pool.filter(~is_test_path(F.col("file_path")))


def draw_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "qa_id").cast("binary"))


def balanced(pool: DataFrame, group: list[str], order: list) -> DataFrame:
    """As many Yes as No answers in binary subtypes, the first in order; a subtype without both stays as it is."""
    low = F.lower(F.trim("answer"))
    own = Window.partitionBy(*group)
    n = F.least(F.count_if(low == "yes").over(own), F.count_if(low == "no").over(own))
    rows = pool.withColumn("low", low).withColumn("n_each", n).withColumn("place", F.row_number().over(Window.partitionBy(*group, "low").orderBy(*order)))
    keep = ~F.col("qa_subtype").isin(*BINARY) | (F.col("n_each") == 0) | (F.col("low").isin("yes", "no") & (F.col("place") <= F.col("n_each")))
    return rows.filter(keep).drop("low", "n_each", "place")


def capped(pool: DataFrame, group: list[str], key: Column, most: int = PER_FILE) -> DataFrame:
    """At most `most` questions from one file."""
    place = F.row_number().over(Window.partitionBy(*group, "file_path").orderBy(key, "qa_id"))
    return pool.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def drawable(pool: DataFrame, weights: DataFrame, group: list[str], order: list, seed: int = SEED) -> DataFrame:
    """The whole chain of filters."""
    return capped(balanced(telling(production(weighted(pool, weights))), group, order), group, draw_key(seed))


def allocation(sizes: DataFrame, by: list[str], budget: Column) -> DataFrame:
    """How many to draw of each subtype: sizes has by, qa_subtype, weight, n. Adds share (rounded) and alloc (repaired).

    Shares go by weight times size, sizes counting POOL_CAP at most. What rounding leaves over is taken from, or given
    to, subtypes in order of weight, then name, as far as each has room.
    """
    whole = Window.partitionBy(*by)
    part = F.col("weight") * F.least("n", F.lit(POOL_CAP))
    share = F.least(F.bround(budget * part / F.sum(part).over(whole)).cast("long"), F.col("n"))
    rows = sizes.withColumn("budget", budget).withColumn("share", share)
    drift = F.least(F.col("budget"), F.sum("n").over(whole)) - F.sum("share").over(whole)
    rows = rows.withColumn("drift", drift).withColumn("room", F.when(F.col("drift") >= 0, F.col("n") - F.col("share")).otherwise(F.col("share")))
    before = F.coalesce(F.sum("room").over(whole.orderBy(F.desc("weight"), "qa_subtype").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("drift") - before))
    return rows.withColumn("alloc", F.col("share") + F.signum("drift").cast("long") * moved).drop("room", "drift")


def type_budgets(drawables: DataFrame, budget: int) -> DataFrame:
    """repo, qa_type, budget: shares of the types, what one can't use going on to the next. drawables: repo, qa_type, n.

    Extrinsic questions come first, then temporal, then intrinsic ones, which also get what rounding down leaves.
    """
    raw = {t: int(budget * s) for t, s in TYPE_SHARES.items()}
    raw["intrinsic"] += budget - sum(raw.values())
    n = lambda t: F.coalesce(F.max(F.when(F.col("qa_type") == t, F.col("n"))), F.lit(0)).alias(f"n_{t}")
    rows = drawables.groupBy("repo").agg(*map(n, TYPE_SHARES))
    carried, parts = F.lit(0), []
    for t in ("extrinsic", "temporal", "intrinsic"):
        want = F.lit(raw[t]) + carried
        parts.append(F.struct(F.lit(t).alias("qa_type"), F.least(want, F.col(f"n_{t}")).cast("long").alias("budget")))
        carried = F.greatest(F.lit(0), want - F.col(f"n_{t}"))
    return rows.select("repo", F.explode(F.array(*parts)).alias("_budget")).select("repo", "_budget.*")


def sample(pool: DataFrame, weights: DataFrame, budget: int, order: list, seed: int = SEED) -> DataFrame:
    """The sample of each repo: drawable rows, their types' budgets, their subtypes' allocations, then the draw."""
    group = ["repo", "qa_type", "qa_subtype"]
    rows = drawable(pool, weights, group, order, seed)
    sizes = rows.groupBy(*group, "weight").agg(F.count(F.lit(1)).alias("n"))
    budgets = type_budgets(sizes.groupBy("repo", "qa_type").agg(F.sum("n").alias("n")), budget).withColumnRenamed("budget", "type_budget")
    allocs = allocation(sizes.join(budgets, ["repo", "qa_type"]), ["repo", "qa_type"], F.col("type_budget")).select(*group, "alloc")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(draw_key(seed), "qa_id"))
    return rows.withColumn("place", place).join(allocs, group).filter(F.col("place") <= F.col("alloc")).drop("place", "alloc", "weight")


def uniform(rows: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows at random, the same ones each time."""
    return rows.orderBy(draw_key(seed), "qa_id").limit(n)
