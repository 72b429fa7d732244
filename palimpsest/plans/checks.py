"""Queries on filters, validity and source text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import docs as D
from ..functions import prompts as P
from ..functions import symbols as S
from ..functions import tags as T
from . import adaptors as A

QUERIES, ORACLES = {}, {}
SYMBOLS = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE NULL END AS lang, c_custkey % 5 = 0 AS is_class,
 CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN '' ELSE NULL END AS visibility, CASE c_custkey % 6 WHEN 0 THEN '_K' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'K' END AS container,
 CASE WHEN c_custkey % 7 = 0 THEN concat('_', c_name) ELSE c_name END AS name, concat(CASE c_custkey % 8 WHEN 0 THEN 'latest/' WHEN 1 THEN 'src/.hid/' WHEN 2 THEN 'a/test_' WHEN 3 THEN '.x/' ELSE 'src/' END, c_mktsegment, CASE c_custkey % 9 WHEN 0 THEN '_test.py' ELSE '.py' END) AS path FROM customer"""
SNAPSHOTS = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE concat('id', CAST(o_orderkey AS VARCHAR(20)), 'xx') END AS slice_id, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE 'hash' END AS commit_hash,
 CASE o_orderkey % 4 WHEN 0 THEN 'not a date' WHEN 1 THEN '2020-02-03T04:05:06Z' WHEN 2 THEN '2020-02-03T04:05:06+02:00' ELSE '2021-12-31' END AS date_text FROM orders"""
COMMENTS = """SELECT doc_id, concat('/** ', substr(text, 1, 20), chr(10), '   * ', replace(text, '*', ''), chr(10), ' */') AS comment, CASE doc_id % 4 WHEN 0 THEN 'import a.b.C;' WHEN 1 THEN 'import static x.y.Z.*;' WHEN 2 THEN 'import one;' ELSE concat(' import p', CAST(doc_id AS VARCHAR(9)), '.Q ; ') END AS line FROM documents"""


def register(name, sql):
    def keep(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return keep


c = F.col
symbols = lambda s, d: A.sql_over(s, d, SYMBOLS, "customer")
register("public_api_filter", f"SELECT c_custkey FROM ({SYMBOLS}) x WHERE CASE lang WHEN 'python' THEN NOT starts_with(name, '_') AND NOT starts_with(COALESCE(container, ''), '_') WHEN 'java' THEN is_class OR lower(COALESCE(visibility, '')) = 'public' ELSE false END")(lambda s, d: symbols(s, d).filter(S.public_api(c("lang"), c("is_class"), c("visibility"), c("container"), c("name"))).select("c_custkey"))
register("public_symbol_filters", f"SELECT c_custkey, {A.PUBLIC_FUNCTION} AS as_function, {A.PUBLIC_CLASS} AS as_class, {A.REF} AS ref FROM ({SYMBOLS}) x")(lambda s, d: symbols(s, d).select("c_custkey", S.public_function(c("visibility"), c("name")).alias("as_function"), S.public_class(c("visibility")).alias("as_class"), S.symbol_ref(c("container"), c("name")).alias("ref")))
register("source_walk_filter", f"SELECT c_custkey FROM ({SYMBOLS}) x WHERE NOT regexp_matches(path, '(^|/)[.]') AND NOT contains(lower(path), 'test/') AND NOT contains(lower(path), 'tests/') AND NOT contains(lower(path), '/test_') AND NOT contains(lower(path), '_test.')")(lambda s, d: symbols(s, d).filter(S.walked(c("path"))).select("c_custkey"))
register("snapshot_validity", f"SELECT o_orderkey, COALESCE(slice_id, '') <> '' AND COALESCE(commit_hash, '') <> '' AND date_text <> 'not a date' AND length(slice_id) >= 5 AS valid FROM ({SNAPSHOTS}) x")(lambda s, d: A.sql_over(s, d, SNAPSHOTS, "orders").select("o_orderkey", T.is_valid_snapshot(c("slice_id"), c("commit_hash"), c("date_text")).alias("valid")))
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
register("javadoc_clean", f"SELECT doc_id, {STRIP.format('array_to_string(list_transform(string_split(regexp_replace(comment, ' + chr(39) + '^/[*][*]|[*]/$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), chr(10)), lambda x: regexp_replace(x, ' + chr(39) + '^' + chr(92) + 's*[*]' + chr(92) + 's*' + chr(39) + ', ' + chr(39) * 2 + ')), chr(10))')} AS body FROM ({COMMENTS}) x")(lambda s, d: A.sql_over(s, d, COMMENTS, "documents").select("doc_id", D.javadoc(c("comment")).alias("body")))
register("java_import", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'x.y.Z' WHEN 2 THEN 'one' ELSE concat('p', doc_id) END AS module, CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 3 THEN 'Q' ELSE '' END AS names, doc_id % 4 = 1 AS is_wildcard FROM documents")(
    lambda s, d: A.sql_over(s, d, COMMENTS, "documents").select("doc_id", D.java_import(c("line")).alias("i")).select("doc_id", "i.module", F.array_join("i.names", ",").alias("names"), "i.is_wildcard"))
register("fence_language", f"SELECT c_custkey, CASE WHEN path LIKE '%.py' THEN 'python' ELSE '' END AS fence FROM ({SYMBOLS}) x")(lambda s, d: symbols(s, d).select("c_custkey", P.fence(c("path")).alias("fence")))
