"""Queries on samples. Labelled documents are the pool of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as O
from . import adaptors as A

QUERIES, ORACLES = {}, {}
SUBTYPES = {
    "intrinsic": ("function_signature", "symbol_existence", "class_methods", "class_existence", "function_parameters"),
    "temporal": ("function_introduced", "class_removed", "function_signature_changed", "class_inheritance_unchanged", "function_not_removed"),
    "extrinsic": ("wh_object", "yesno", "wh_manner", "wh_subject", "wh_temporal"),
}
CASES = " ".join(f"WHEN qa_type = '{t}' AND k = {i} THEN '{s}'" for t, ss in SUBTYPES.items() for i, s in enumerate(ss))
POOL = f"""SELECT repo, qa_type, CASE {CASES} END AS qa_subtype, answer, file_path, ord, substr(sha1(CAST(ord AS VARCHAR(20))), 1, 16) AS qa_id FROM (
 SELECT concat('r', CAST(d.doc_id % 3 AS VARCHAR(9))) AS repo, CASE d.lang WHEN 'en' THEN 'intrinsic' WHEN 'de' THEN 'temporal' ELSE 'extrinsic' END AS qa_type, CAST(d.n_chars % 5 AS INT) AS k, d.doc_id AS ord,
  CASE WHEN d.doc_id % 13 = 0 THEN ' None ' WHEN d.doc_id % 17 = 0 THEN '()' WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN ' no' WHEN d.n_chars % 3 = 0 THEN 'No' ELSE 'YES' END AS answer,
  CASE WHEN d.doc_id % 29 = 0 THEN 'tests/a.py' ELSE concat('src/', CAST(d.n_chars % 9 AS VARCHAR(9)), '.py') END AS file_path
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"""
GROUP = ["repo", "qa_type", "qa_subtype"]
KEEP = (*GROUP, "answer", "file_path", "qa_id")


def pool(spark, sf_dir):
    return A.sql_over(spark, sf_dir, POOL, "documents", "labels")


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


W = "CAST(COALESCE(CASE " + " ".join(f"WHEN qa_type = '{t}' AND qa_subtype = '{s}' THEN {w}" for t, own in O.SUBTYPE_WEIGHTS.items() for s, w in own.items() if s != "__all__") + " END, 1.0) AS DOUBLE)"
NOT_TEST = A.NOT_TEST
TRIVIAL = "NOT (qa_subtype IN (" + ", ".join(f"'{s}'" for s in O.TRIVIAL_SUBTYPES) + ") AND lower(trim(answer)) IN (" + ", ".join(f"'{s}'" for s in O.TRIVIAL_ANSWERS) + "))"
BINARY = "qa_subtype IN (" + ", ".join(f"'{s}'" for s in O.BINARY) + ")"
GROUPS = "repo, qa_type, qa_subtype"


def balance(source):
    return f"(SELECT * FROM (SELECT *, lower(trim(answer)) AS low, least(COUNT(*) FILTER (WHERE lower(trim(answer)) = 'yes') OVER (PARTITION BY {GROUPS}), COUNT(*) FILTER (WHERE lower(trim(answer)) = 'no') OVER (PARTITION BY {GROUPS})) AS each_n, row_number() OVER (PARTITION BY {GROUPS}, lower(trim(answer)) ORDER BY ord) AS place FROM {source} s) b WHERE NOT {BINARY} OR each_n = 0 OR (low IN ('yes', 'no') AND place <= each_n))"


def cap(source):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {GROUPS}, file_path ORDER BY md5(concat('42:', qa_id)), qa_id) AS fplace FROM {source} c) d WHERE fplace <= 8)"


P = f"(SELECT *, {W} AS weight FROM ({POOL}) p)"
DRAWABLE = cap(balance(f"(SELECT * FROM {P} q WHERE {NOT_TEST} AND {TRIVIAL})"))
OUT = ", ".join(KEEP)
register("trivial_answer_filter", f"SELECT {OUT} FROM ({POOL}) p WHERE {TRIVIAL}")(lambda s, d: O.telling(pool(s, d)).select(*KEEP))
register("test_path_filter", f"SELECT {OUT} FROM ({POOL}) p WHERE {NOT_TEST}")(lambda s, d: O.production(pool(s, d)).select(*KEEP))
register("subtype_weights", f"SELECT qa_id, {W} AS weight FROM ({POOL}) p")(lambda s, d: O.weighted(pool(s, d), O.weight_table(s)).select("qa_id", "weight"))
register("balance_binary", f"SELECT {OUT} FROM {balance(f'({POOL})')} p")(lambda s, d: O.balanced(pool(s, d), GROUP, ["ord"]).select(*KEEP))
register("cap_per_file", f"SELECT {OUT} FROM {cap(f'({POOL})')} p")(lambda s, d: O.capped(pool(s, d), GROUP, O.draw_key(42)).select(*KEEP))
register("drawable_counts", f"SELECT {GROUPS}, COUNT(*) AS n FROM {DRAWABLE} x GROUP BY {GROUPS}")(lambda s, d: O.drawable(pool(s, d), O.weight_table(s), GROUP, ["ord"]).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")))
SIZES = f"(SELECT {GROUPS}, weight, COUNT(*) AS n FROM {DRAWABLE} x GROUP BY {GROUPS}, weight)"


def shares(source, budget):
    """The allocation: a rounded share, then the drift spread by weight and name."""
    one = "(PARTITION BY repo, qa_type)"
    a = f"(SELECT *, {budget} AS budget, least(CAST(round_even({budget} * (weight * least(n, 2000)) / SUM(weight * least(n, 2000)) OVER {one}, 0) AS BIGINT), n) AS share FROM {source} s)"
    b = f"(SELECT *, CAST(least(budget, SUM(n) OVER {one}) - SUM(share) OVER {one} AS BIGINT) AS drift FROM {a} a)"
    c = f"(SELECT *, CASE WHEN drift >= 0 THEN n - share ELSE share END AS room FROM {b} b)"
    d = f"(SELECT *, CAST(COALESCE(SUM(room) OVER (PARTITION BY repo, qa_type ORDER BY weight DESC, qa_subtype ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier FROM {c} c)"
    return f"(SELECT *, share + sign(drift) * greatest(0, least(room, abs(drift) - earlier)) AS alloc FROM {d} d)"


def sizes(spark, sf_dir):
    return O.drawable(pool(spark, sf_dir), O.weight_table(spark), GROUP, ["ord"]).groupBy(*GROUP, "weight").agg(F.count(F.lit(1)).alias("n"))


register("subtype_allocation", f"SELECT {GROUPS}, n, share FROM {shares(SIZES, '37')} a")(lambda s, d: O.allocation(sizes(s, d), ["repo", "qa_type"], F.lit(37)).select(*GROUP, "n", "share"))
register("drift_repair", f"SELECT {GROUPS}, n, CAST(alloc AS BIGINT) AS alloc FROM {shares(SIZES, '37')} a")(lambda s, d: O.allocation(sizes(s, d), ["repo", "qa_type"], F.lit(37)).select(*GROUP, "n", "alloc"))
BUDGETS = f"""(SELECT repo, unnest(['extrinsic', 'temporal', 'intrinsic']) AS qa_type, CAST(unnest([least(e, ne), least(t + greatest(0, e - ne), nt), least(i + greatest(0, t + greatest(0, e - ne) - nt), ni)]) AS BIGINT) AS budget
 FROM (SELECT repo, 10 AS e, 42 AS t, 48 AS i, COUNT(*) FILTER (WHERE qa_type = 'extrinsic') AS ne, COUNT(*) FILTER (WHERE qa_type = 'temporal') AS nt, COUNT(*) FILTER (WHERE qa_type = 'intrinsic') AS ni FROM {DRAWABLE} x GROUP BY repo) y)"""
register("type_budget_cascade", f"SELECT * FROM {BUDGETS} b")(lambda s, d: O.type_budgets(sizes(s, d).groupBy("repo", "qa_type").agg(F.sum("n").alias("n")), 100))
ALLOC = shares(f"(SELECT z.*, y.budget AS tb FROM {SIZES} z JOIN {BUDGETS} y ON y.repo = z.repo AND y.qa_type = z.qa_type)", "tb")
SAMPLE = f"(SELECT x.* FROM (SELECT *, row_number() OVER (PARTITION BY {GROUPS} ORDER BY md5(concat('42:', qa_id)), qa_id) AS drawn FROM {DRAWABLE} x) x JOIN {ALLOC} a ON a.repo = x.repo AND a.qa_type = x.qa_type AND a.qa_subtype = x.qa_subtype WHERE x.drawn <= a.alloc)"


def sampled(spark, sf_dir):
    return O.sample(pool(spark, sf_dir), O.weight_table(spark), 100, ["ord"])


register("stratified_sample", f"SELECT {OUT} FROM {SAMPLE} s")(lambda s, d: sampled(s, d).select(*KEEP))
register("sampling_summary", f"SELECT {GROUPS}, COUNT(*) AS n FROM {SAMPLE} s GROUP BY {GROUPS}")(lambda s, d: sampled(s, d).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")))
register("uniform_sample", f"SELECT qa_id FROM ({POOL}) p ORDER BY md5(concat('42:', qa_id)), qa_id LIMIT 50")(lambda s, d: O.uniform(pool(s, d), 50).select("qa_id"))
register("stride_sample", f"SELECT repo, ord FROM (SELECT repo, ord, row_number() OVER (PARTITION BY repo ORDER BY ord) - 1 AS place, COUNT(*) OVER (PARTITION BY repo) AS total FROM ({POOL}) p) t WHERE total <= 20 OR list_contains(list_transform(range(20), lambda i: CAST(floor(i * (CAST(total AS DOUBLE) / 20)) AS BIGINT)), place)")(
    lambda s, d: strided(pool(s, d)))


def strided(rows):
    from ..operators.snapshots import stride

    return stride(rows, ["repo"], "ord", 20).select("repo", "ord")
