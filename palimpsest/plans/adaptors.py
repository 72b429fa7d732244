"""Symbol tables, slices and the like, derived from the verification tables.

A view is written once as SQL that Spark and other engines both read; what they spell differently is filled in. The
operators are applied to these views as DataFrames; the checking SQL starts from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import symbols as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK = {"set": "array_sort(collect_set({0}))", "strings": "array<string>", "int": "INT"}
DUCK = {"set": "list_sort(list_distinct(list({0})))", "strings": "VARCHAR[]", "int": "INTEGER"}


def _set(d: dict, x: str) -> str:
    return d["set"].format(x)


def function_sql(d: dict) -> str:
    """Functions: customers are symbols, market segments repos, order years snapshots, orders the file scan."""
    return f"""
SELECT c.c_mktsegment AS repo, CAST(year(o.o_orderdate) - 1995 AS {d['int']}) AS slice_idx, o.o_orderkey AS ord,
       CASE WHEN c.c_custkey % 23 = 0 THEN concat('_f', CAST(c.c_custkey AS VARCHAR(20))) ELSE concat('f', CAST(c.c_custkey AS VARCHAR(20))) END AS name,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 7 = 0 THEN '' ELSE concat('C', CAST(c.c_nationkey AS VARCHAR(20))) END AS container,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'function' ELSE 'method' END AS kind,
       CASE WHEN c.c_custkey % 11 = 0 THEN 'Private' WHEN c.c_custkey % 5 = 0 THEN 'PUBLIC' WHEN c.c_custkey % 2 = 0 THEN '' ELSE NULL END AS visibility,
       CASE WHEN c.c_custkey % 19 = 0 THEN 'tests/test_m.py' ELSE concat('src/m', CAST(c.c_custkey % 40 AS VARCHAR(20)), '.py') END AS file_path,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL WHEN o.o_orderkey % 4 = 0 THEN concat('def f(', o.o_orderpriority, '):') ELSE concat('def f(', substr(o.o_orderpriority, 1, 1)) END AS signature,
       concat('p', CAST(o.o_orderkey % 3 AS VARCHAR(20))) AS p_name,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderstatus END AS p_type,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'None' ELSE NULL END AS p_default,
       CASE WHEN o.o_orderkey % 8 = 0 THEN '' ELSE o.o_orderstatus END AS return_type,
       l.calls, l.instantiations, l.field_accesses
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, {_set(d, "concat('C', CAST(l_suppkey % 25 AS VARCHAR(20)), '.f', CAST(l_partkey % 1500 AS VARCHAR(20)))")} AS calls,
                  {_set(d, "concat('K', CAST(l_suppkey % 40 AS VARCHAR(20)))")} AS instantiations,
                  {_set(d, "concat('self.', l_returnflag)")} AS field_accesses
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"""


def class_sql(d: dict) -> str:
    """Classes: parts are symbols, their suppliers' nations repos, ship years snapshots; all lines count. A part that no supplier
    of a repo shipped in a year is absent from that snapshot; bases, interfaces and methods come from the lines."""
    return f"""
SELECT concat('R', CAST(s.s_nationkey % 3 AS VARCHAR(20))) AS repo, CAST(year(l.l_shipdate) - 1995 AS {d['int']}) AS slice_idx,
       l.l_partkey AS ord, concat('K', CAST(l.l_partkey AS VARCHAR(20))) AS name, 'class' AS kind,
       CASE WHEN l.l_partkey % 10 = 0 THEN 'private' WHEN l.l_partkey % 4 = 0 THEN 'public' ELSE NULL END AS visibility,
       concat('src/k', CAST(l.l_partkey % 9 AS VARCHAR(20)), '.java') AS file_path,
       {_set(d, "CASE WHEN l.l_quantity <= 3 THEN concat('K', CAST(l.l_suppkey % 4 + 1 AS VARCHAR(20))) END")} AS base_classes,
       {_set(d, "CASE WHEN l.l_quantity >= 50 THEN concat('I', CAST(l.l_linenumber AS VARCHAR(20))) END")} AS implemented_interfaces,
       {_set(d, "CASE WHEN l.l_discount = 0 THEN concat('m', CAST(l.l_suppkey % 50 AS VARCHAR(20))) END")} AS methods,
       {_set(d, "CASE WHEN l.l_tax = 0 THEN concat('x', CAST(l.l_suppkey % 20 AS VARCHAR(20))) END")} AS fields
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_nationkey % 3, l.l_partkey, year(l.l_shipdate)"""


def slice_sql(of: str) -> str:
    """Snapshots of a symbol view; every fourth one has no tag, so its identifier is its label."""
    return f"""
SELECT repo, slice_idx, concat(repo, '_', substr(sha1(concat(repo, CAST(slice_idx AS VARCHAR(20)))), 1, 8), '_', CAST(1995 + slice_idx AS VARCHAR(20)), '0101') AS slice_id,
       CASE WHEN slice_idx % 4 = 3 THEN '' ELSE concat('v', CAST(1995 + slice_idx AS VARCHAR(20))) END AS version_tag
FROM (SELECT DISTINCT repo, slice_idx FROM {of}) x"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql_over(spark: SparkSession, sf_dir: str, text: str, *names: str, **more: DataFrame) -> DataFrame:
    """Spark SQL over tables and frames, without registering views in the session."""
    import re

    frames = {**views(spark, sf_dir, *names), **more}
    text = text.replace("{", "{{").replace("}", "}}")
    for n in frames:
        text = re.sub(rf"(?<=FROM |JOIN ){n}\b(?![.'])", "{" + n + "}", text)
    return spark.sql(text, **frames)


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All function symbols with keys and references; calls and the like are sorted arrays, never null."""
    raw = sql_over(spark, sf_dir, function_sql(SPARK), "orders", "customer", "lineitem")
    empty = F.array().cast("array<string>")
    params = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type_annotation"), F.col("p_default").alias("default_value")))
    for c in ("calls", "instantiations", "field_accesses"):
        raw = raw.withColumn(c, F.coalesce(c, empty))
    return raw.withColumn("ref", S.symbol_ref(F.col("container"), F.col("name"))).withColumn("key", S.joined_key(*map(F.col, ("file_path", "container", "kind", "name")))).withColumn("params", S.format_params(params)).drop("p_name", "p_type", "p_default")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sql_over(spark, sf_dir, class_sql(SPARK), "lineitem", "supplier")
    return raw.withColumn("ref", F.col("name")).withColumn("key", S.joined_key(*map(F.col, ("file_path", "kind", "name"))))


def public(df: DataFrame, production: bool = False) -> DataFrame:
    """Public functions or classes, without those of test files if production."""
    df = df.filter(S.public_function(F.col("visibility"), F.col("name")) if "calls" in df.columns else S.public_class(F.col("visibility")))
    return df.filter(~S.is_test_path(F.col("file_path"))) if production else df


def slices(symbols: DataFrame) -> DataFrame:
    base = symbols.select("repo", "slice_idx").distinct()
    return base.sparkSession.sql(slice_sql("{base}"), base=base)


# --- the same in the checking SQL ------------------------------------------------------------------------------
REF = "CASE WHEN COALESCE(container, '') <> '' THEN concat(container, '.', name) ELSE name END"
PARAMS = "concat('(', p_name, CASE WHEN COALESCE(p_type, '') <> '' THEN concat(': ', p_type) ELSE '' END, CASE WHEN p_default IS NOT NULL THEN concat(' = ', p_default) ELSE '' END, ')')"
FUNCTION_KEY = "concat_ws('|', COALESCE(file_path, ''), COALESCE(container, ''), COALESCE(kind, ''), COALESCE(name, ''))"
CLASS_KEY = "concat_ws('|', COALESCE(file_path, ''), COALESCE(kind, ''), COALESCE(name, ''))"
PUBLIC_FUNCTION = "CASE WHEN COALESCE(visibility, '') <> '' THEN lower(visibility) = 'public' ELSE name NOT LIKE '\\_%' ESCAPE '\\' END"
PUBLIC_CLASS = "(visibility IS NULL OR lower(visibility) = 'public')"
NOT_TEST = "NOT regexp_matches(file_path, '(?i)(^|[/\\\\])tests?[/\\\\]|(^|[/\\\\])test_|_tests?\\.py$|[/\\\\]src[/\\\\]test[/\\\\]|Test\\.java$|Tests\\.java$')"


def symbols_cte(kind: str, production: bool) -> str:
    """CTEs raw, sym (public, keyed) and slices with labels."""
    if kind == "function":
        body = f"SELECT *, {REF} AS ref, {PARAMS} AS params, {FUNCTION_KEY} AS key FROM raw WHERE {PUBLIC_FUNCTION}"
        body = body.replace("SELECT *,", "SELECT * REPLACE (COALESCE(calls, []) AS calls, COALESCE(instantiations, []) AS instantiations, COALESCE(field_accesses, []) AS field_accesses),")
        raw = function_sql(DUCK)
    else:
        keep = "list_filter({0}, lambda v: v IS NOT NULL) AS {0}"
        raw = class_sql(DUCK)
        body = f"SELECT * REPLACE ({', '.join(keep.format(c) for c in ('base_classes', 'implemented_interfaces', 'methods', 'fields'))}), name AS ref, {CLASS_KEY} AS key FROM raw WHERE {PUBLIC_CLASS}"
    if production:
        body += f" AND {NOT_TEST}"
    return f"WITH raw AS ({raw}), sym AS ({body}), slices AS (SELECT *, COALESCE(NULLIF(version_tag, ''), slice_id) AS label FROM ({slice_sql('raw')}) s)"


def qa_sql(qa_type: str, subtype: str, question: str, answer: str, name: str, path: str, kind: str, slice_id: str = "NULL", from_id: str = "NULL", to_id: str = "NULL", keyed: bool = False) -> str:
    """The select list of a question-answer row."""
    evidence = f"concat('{{\"file_path\": \"', {path}, '\", \"kind\": \"{kind}\", \"name\": \"', {name}, '\"}}')"
    some = lambda x: "''" if x == "NULL" else x
    parts = ["repo", f"'{qa_type}'", f"'{subtype}'", question, answer, some(slice_id), some(from_id), some(to_id), evidence]
    joined = "concat(" + ", '||', ".join(parts) + ")"
    key = f"concat(repo, '||{qa_type}||{subtype}||', {name}, '||', {path})" if keyed else "CAST(NULL AS VARCHAR)"
    null = lambda x: "CAST(NULL AS VARCHAR)" if x == "NULL" else x
    return f"substr(sha1({joined}), 1, 16) AS qa_id, repo, '{qa_type}' AS qa_type, '{subtype}' AS qa_subtype, {question} AS question, {answer} AS answer, {null(slice_id)} AS slice_id, {null(from_id)} AS from_slice_id, {null(to_id)} AS to_slice_id, {key} AS question_key, '{kind}' AS evidence_kind, {name} AS evidence_name, {path} AS evidence_path"
