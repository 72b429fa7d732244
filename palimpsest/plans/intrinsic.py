"""Intrinsic queries, and those on identifiers and unions of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as S
from ..operators import intrinsic as O
from ..operators.qa import flat, qa_rows
from . import adaptors as A

QUERIES, ORACLES = {}, {}


def tables(spark, sf_dir, kind):
    raw = (A.functions if kind == "function" else A.classes)(spark, sf_dir)
    return A.public(raw), A.slices(raw)


def instantiating(functions):
    """Classes and functions of the test views live in repos of their own; here both are moved into one."""
    return functions.withColumn("repo", F.concat(F.lit("R"), F.pmod(F.col("ord"), F.lit(3)).cast("string")))


def register(name, sql):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return keep


def select(kind, subtype, question, answer, rows, name="ref", path="file_path", of=None):
    return f"{A.symbols_cte(kind, False)}, lab AS (SELECT s.*, l.slice_id, l.label FROM sym s JOIN slices l ON s.repo = l.repo AND s.slice_idx = l.slice_idx) SELECT {A.qa_sql('intrinsic', subtype, question, answer, name, path, of or kind, slice_id='slice_id')} FROM ({rows}) r"


def absent_sql(kind):
    return f"""SELECT m.repo, m.ref, m.slice_id, m.label, '' AS file_path FROM (
SELECT a.repo, a.ref, l.slice_id, l.label, row_number() OVER (PARTITION BY a.repo, l.slice_idx ORDER BY a.ref) AS place,
       (SELECT COUNT(DISTINCT s.ref) FROM sym s WHERE s.repo = l.repo AND s.slice_idx = l.slice_idx) AS n
FROM (SELECT DISTINCT repo, ref FROM sym) a JOIN slices l ON a.repo = l.repo
WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.repo = a.repo AND s.slice_idx = l.slice_idx AND s.ref = a.ref)) m
WHERE n > 0 AND place <= greatest(1, n // 10)"""


for _kind, _name, _what in (("function", "symbol_existence", "function/method"), ("class", "class_existence", "class")):
    _q = f"concat('Does {_what} ', ref, ' exist in version ', label, '?')"
    _rows = f"SELECT repo, ref, slice_id, label, file_path, 'Yes' AS yes FROM lab UNION ALL SELECT *, 'No' FROM ({absent_sql(_kind)}) n"
    register(_name, select(_kind, _name, _q, "yes", _rows))(lambda spark, sf, kind=_kind: flat(O.existence(*tables(spark, sf, kind), kind)))
    register("negative_" + ("symbols" if _kind == "function" else "classes"), f"{A.symbols_cte(_kind, False)} SELECT repo, slice_id, ref FROM ({absent_sql(_kind)}) r")(
        lambda spark, sf, kind=_kind: (lambda t: O.labelled(O.absent(t[0]), t[1]).select("repo", "slice_id", "ref"))(tables(spark, sf, kind)))

_sig = "CASE WHEN regexp_matches(COALESCE(signature, ''), ':\\s*$') THEN signature ELSE concat(rtrim(split_part(COALESCE(signature, ''), '(', 1)), params, CASE WHEN COALESCE(return_type, '') <> '' THEN concat(' -> ', return_type) ELSE '' END, ':') END"
register("function_signature", select("function", "function_signature", "concat('What is the signature of function/method ', ref, '?')", _sig, "SELECT * FROM lab"))(lambda spark, sf: flat(O.signature(*tables(spark, sf, "function"))))
for _n, (_h, _t, _c, _only) in O.FUNCTION_FACTS.items():
    _list = _c in ("calls", "instantiations", "field_accesses")
    _where = (f"WHERE len({_c}) > 0" if _list else f"WHERE COALESCE({_c}, '') <> ''") if _only else ""
    register(_n, select("function", _n, f"concat('{_h}', ref, '{_t}')", f"array_to_string({_c}, ', ')" if _list else _c, f"SELECT * FROM lab {_where}"))(lambda spark, sf, n=_n: flat(O.function_fact(*tables(spark, sf, "function"), n)))
for _n, (_h, _t, _c) in O.CLASS_FACTS.items():
    register(_n, select("class", _n, f"concat('{_h}', ref, '{_t}')", f"CASE WHEN len({_c}) > 0 THEN array_to_string({_c}, ', ') ELSE 'none' END", "SELECT * FROM lab"))(lambda spark, sf, n=_n: flat(O.class_fact(*tables(spark, sf, "class"), n)))


def _location(spark, sf_dir):
    (f, sf), (c, sc) = tables(spark, sf_dir, "function"), tables(spark, sf_dir, "class")
    return flat(O.location(f, c, sf, sc))


register("symbol_location", "SELECT * FROM (" + select("function", "symbol_location", "concat('Which file is function/method ', ref, ' located in?')", "file_path", "SELECT * FROM lab") + ") a UNION ALL SELECT * FROM (" + select("class", "symbol_location", "concat('Which file is class ', ref, ' located in?')", "file_path", "SELECT * FROM lab") + ") b")(_location)

_edge = "SELECT l.*, e.who FROM lab l {kind} JOIN (SELECT repo, slice_idx, target, {agg} AS who FROM (SELECT repo, slice_idx, ord, ref, unnest({col}) AS target FROM {of}) u GROUP BY repo, slice_idx, target) e ON e.repo = l.repo AND e.slice_idx = l.slice_idx AND e.target = l.ref"
register("class_subclasses", select("class", "class_subclasses", "concat('What subclasses does class ', ref, ' have?')", "COALESCE(who, 'none')", _edge.format(kind="LEFT", agg="string_agg(ref, ', ' ORDER BY ord, ref)", col="base_classes", of="sym")))(
    lambda spark, sf: (lambda t: flat(O.looked_up(t[0], t[0], t[1], "class_subclasses")))(tables(spark, sf, "class")))
_sorted = "array_to_string(list_sort(list_distinct(list(ref))), ', ')"
register("symbol_call_sites", select("function", "symbol_call_sites", "concat('What functions or methods call ', ref, ' internally?')", "who", _edge.format(kind="INNER", agg=_sorted, col="calls", of="sym")))(
    lambda spark, sf: (lambda t: flat(O.looked_up(t[0], t[0], t[1], "symbol_call_sites")))(tables(spark, sf, "function")))


def _instantiation_sites(spark, sf_dir):
    classes, slices = tables(spark, sf_dir, "class")
    return flat(O.looked_up(classes, instantiating(tables(spark, sf_dir, "function")[0]), slices, "class_instantiation_sites"))


_fn = A.symbols_cte("function", False).removeprefix("WITH ").split(", slices AS")[0].replace("raw AS (", "fraw AS (", 1).replace("FROM raw", "FROM fraw").replace("sym AS (", "fsym AS (", 1)
register("class_instantiation_sites", select("class", "class_instantiation_sites", "concat('Which functions/methods instantiate class ', ref, ' internally?')", "who", _edge.format(kind="INNER", agg=_sorted, col="instantiations", of="(SELECT * REPLACE (concat('R', CAST(ord % 3 AS VARCHAR)) AS repo) FROM fsym)")).replace("WITH raw AS", f"WITH {_fn}, raw AS", 1))(_instantiation_sites)
register("interface_implementors", select("class", "interface_implementors", "concat('What classes implement interface ', target, '?')", "who", "SELECT u.repo, u.slice_id, u.file_path, u.target, w.who FROM (SELECT repo, slice_idx, slice_id, file_path, unnest(implemented_interfaces) AS target FROM lab) u JOIN (SELECT repo, slice_idx, target, string_agg(ref, ', ' ORDER BY ord, ref) AS who FROM (SELECT repo, slice_idx, ord, ref, unnest(implemented_interfaces) AS target FROM sym) x GROUP BY repo, slice_idx, target) w ON w.repo = u.repo AND w.slice_idx = u.slice_idx AND w.target = u.target", name="target", of="interface"))(lambda spark, sf: flat(O.implementors(*tables(spark, sf, "class"))))


@register("qa_stable_id", "SELECT c_custkey, substr(sha1(concat(c_mktsegment, '||', c_name, '||', '{\"file_path\": \"', c_name, '\", \"kind\": \"function\", \"name\": \"', c_mktsegment, '\"}')), 1, 16) AS qa_id FROM customer")
def qa_stable_id(spark, sf_dir):
    c = A.views(spark, sf_dir, "customer")["customer"]
    return c.select("c_custkey", S.stable_id(F.col("c_mktsegment"), F.col("c_name"), S.evidence_text(F.lit("function"), F.col("c_mktsegment"), F.col("c_name"))).alias("qa_id"))


def all_questions(spark, sf_dir):
    """Union of questions of the three types, repeats kept."""
    f, slices = tables(spark, sf_dir, "function")
    lab = O.labelled(f, slices)
    own = O.function_fact(f, slices, "function_return_type")
    doc = qa_rows(lab, "extrinsic", "wh_object", F.concat(F.lit("What does "), F.col("ref"), F.lit(" return?")), S.text(F.col("return_type")), F.col("ref"), F.col("file_path"), kind="function", slice_id=F.col("slice_id"))
    return own.unionByName(doc).unionByName(O.existence(f, slices, "function"))


_union = ("(SELECT repo, 'intrinsic' AS qa_type, 'function_return_type' AS qa_subtype FROM sym WHERE COALESCE(return_type, '') <> '' UNION ALL SELECT repo, 'extrinsic', 'wh_object' FROM sym UNION ALL SELECT repo, 'intrinsic', 'symbol_existence' FROM sym UNION ALL SELECT repo, 'intrinsic', 'symbol_existence' FROM (" + absent_sql("function") + ") n) u")


@register("qa_union_all", A.symbols_cte("function", False) + f" SELECT repo, qa_type, qa_subtype, COUNT(*) AS n FROM {_union} GROUP BY ALL")
def qa_union_all(spark, sf_dir):
    return all_questions(spark, sf_dir).groupBy("repo", "qa_type", "qa_subtype").agg(F.count(F.lit(1)).alias("n"))


@register("qa_type_summary", A.symbols_cte("function", False) + f" SELECT repo, qa_type, COUNT(*) AS n FROM {_union} GROUP BY ROLLUP (repo, qa_type)")
def qa_type_summary(spark, sf_dir):
    return all_questions(spark, sf_dir).rollup("repo", "qa_type").agg(F.count(F.lit(1)).alias("n"))
