"""Scoring of predicted answers: normal forms, exact match, token F1, longest common subsequence, per-subtype rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: ASCII punctuation but the underscore, and the articles that don't count.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"
#: Subtypes by the normal form of their answers.
VERSION_SUBTYPES = ("function_first_introduced", "class_first_introduced", "function_last_present", "class_last_present", "function_introduced", "class_introduced", "function_not_introduced", "function_not_removed", "class_not_removed", "function_return_type_evolution")
CHANGE_SUBTYPES = ("function_calls_changed", "function_instantiations_changed")
#: Markers after which a model's output is cut.
END_MARKERS = ("im_end", "endoftext", "end", "eos", "pad", "user", "assistant", "system")
SPACES = r"(?U)\s+"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def normalized(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, " " * len(PUNCTUATION)), ARTICLES, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalized(c), " "), lambda x: x != "")


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalized(prediction) == normalized(truth)).cast("double")


def f_measure(same: Column, n: Column, m: Column) -> Column:
    p, r = same / n, same / m
    return F.when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: lambdas would repeat an expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_f1(prediction: Column, truth: Column) -> Column:
    """Overlap of tokens with repeats; if either has none, 1 only if both have."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))

    def score(x: Column) -> Column:
        p, g = x["p"], x["g"]
        same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda a, t: a + F.least(count(p, t), count(g, t)))
        measure = let(same.cast("double"), lambda n: f_measure(n, F.size(p), F.size(g)))
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(measure)

    return let(F.struct(tokens(prediction).alias("p"), tokens(truth).alias("g")), score)


def common_subsequence(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is one whole number, a bit for each token of x."""
    places: dict[str, int] = {}
    for i, t in enumerate(x):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for t in y:
        hit = row & places.get(t, 0)
        row = (row + hit) | (row - hit)
        row &= full
    return len(x) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(a), list(b)) if a is not None and b is not None else None for a, b in zip(x, y)], dtype="Int32")


def rouge_l(prediction: Column, truth: Column) -> Column:
    """F measure of the longest common subsequence of tokens; 0 if either has none."""
    p, g = tokens(prediction), tokens(truth)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f_measure(lcs_length(p, g).cast("double"), F.size(p), F.size(g)))


def yesno_match(prediction: Column, truth: Column) -> Column:
    first = F.regexp_extract(prediction, r"(?U)\A\s*(\S+)", 1)
    return F.when(first == "", 0.0).otherwise((F.regexp_replace(F.lower(first), r"[.,!?:;]+\z", "") == F.lower(stripped(truth))).cast("double"))


def plain_version(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\bv(\d)", "$1")


def plain_change(c: Column) -> Column:
    """added/removed lists without empty ones, their keys in lower case."""
    parts = F.filter(F.transform(F.split(c, ";"), stripped), lambda x: x != "")
    head = r"(?i)\A(added|removed)\s*:\s*(.+)\z"

    def one(p: Column) -> Column:
        value = stripped(F.regexp_extract(p, head, 2))
        return F.when(p.rlike(head), F.when(~F.lower(value).isin("null", "none", "n/a", ""), F.concat(F.lower(F.regexp_extract(p, head, 1)), F.lit(": "), value))).otherwise(p)

    return F.array_join(F.filter(F.transform(parts, one), lambda x: x.isNotNull()), "; ")


def _items(c: Column, clean) -> Column:
    parts = F.filter(F.transform(F.split(c, "[,;]"), stripped), lambda x: x != "")
    bare = F.transform(parts, lambda p: clean(stripped(F.regexp_replace(p, r"\A`+|`+\z", ""))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != ""))), ", ")


def item_list(c: Column) -> Column:
    return _items(c, lambda p: F.regexp_replace(p, r"\Athis\.", ""))


def caller_list(c: Column) -> Column:
    def clean(p: Column) -> Column:
        p = F.regexp_replace(p, r"(?U)\Anew\s+\w+\([^)]*\)\.", "")
        return stripped(F.regexp_replace(F.regexp_replace(p, r"(?U)\A\w+\.", ""), r"\(.*\)\z", ""))

    return _items(c, clean)


def by_subtype(c: Column, qa_type: Column, subtype: Column) -> Column:
    temporal, intrinsic = qa_type == "temporal", qa_type == "intrinsic"
    return (
        F.when(temporal & subtype.isin(*VERSION_SUBTYPES), plain_version(c)).when(temporal & subtype.isin(*CHANGE_SUBTYPES), plain_change(plain_version(c)))
        .when(intrinsic & (subtype == "field_accesses"), item_list(c)).when(intrinsic & (subtype == "symbol_callers"), caller_list(c)).otherwise(c)
    )


def metrics(prediction: Column, truth: Column, qa_type: Column, subtype: Column) -> Column:
    """The map of metrics of an answer; empty if there is no prediction."""
    p, g = by_subtype(prediction, qa_type, subtype), by_subtype(truth, qa_type, subtype)
    none = F.create_map().cast("map<string,double>")
    both = F.struct(p.alias("p"), g.alias("g"))
    return (
        F.when(prediction.isNull(), none).when((qa_type == "extrinsic") & (subtype == "yesno"), F.create_map(F.lit("yesno_em"), yesno_match(p, g)))
        .when(qa_type == "extrinsic", F.create_map(F.lit("rouge_l"), rouge_l(p, g)))
        .otherwise(let(both, lambda x: F.create_map(F.lit("em"), exact_match(x["p"], x["g"]), F.lit("f1"), token_f1(x["p"], x["g"]))))
    )


def without_fence(c: Column) -> Column:
    """The body of the first fenced block, or of a text that is one backticked span."""
    t = stripped(c)
    body = stripped(F.regexp_extract(t, r"(?sU)```\w*\n(.*?)```", 1))
    single = F.regexp_extract(t, r"\A`([^`\n]+)`\n?\z", 1)
    return F.when(body != "", body).when(single != "", stripped(single)).otherwise(t)


def without_markers(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?s)<\|(?:" + "|".join(END_MARKERS) + r")\|>.*", ""))
