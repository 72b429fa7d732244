"""Queries on source text for questions. Customers' notes by year stand for files by snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import context as O
from ..operators import summaries as M
from . import adaptors as A

QUERIES, ORACLES = {}, {}
#: A file for each customer, at the snapshots (quarters) in which they ordered; a text with a definition. All orders count.
FILES = """SELECT repo, slice_idx, file_path, concat('# ', file_path, chr(10), repeat('x = 1;', CAST(n % 40 AS INT)), ' def f', CAST(n % 3 AS VARCHAR(9)), '(a): pass ', repeat('y;', CAST(n % 50 AS INT))) AS content FROM (
 SELECT c.c_mktsegment AS repo, CAST((year(o.o_orderdate) - 1995) * 4 + floor((month(o.o_orderdate) - 1) / 3) AS INT) AS slice_idx, concat('src/n', CAST(c.c_custkey AS VARCHAR(20)), CASE WHEN c.c_custkey % 2 = 0 THEN '.py' ELSE '.java' END) AS file_path, MAX(o.o_orderkey) AS n
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3) f"""
#: Every supplier asks once, of the file of the customer with its key; those without such a customer ask in a repo without files.
QUESTIONS = """SELECT s_suppkey AS q, COALESCE(c.c_mktsegment, 'NONE') AS repo, concat('src/n', CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.java' END) AS file_path, concat('C.f', CAST(s_suppkey % 4 AS VARCHAR(9))) AS symbol,
 CAST(s_suppkey % 28 AS INT) AS slice_idx, CAST(s_suppkey % 20 AS INT) AS from_idx, CAST(s_suppkey % 20 + s_suppkey % 7 AS INT) AS to_idx FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey"""
WINDOW = 100


def files(spark, sf_dir):
    return A.sql_over(spark, sf_dir, FILES.replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3"), "orders", "customer")


def questions(spark, sf_dir):
    return A.sql_over(spark, sf_dir, QUESTIONS, "supplier", "customer")


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


KEY = ["q", "repo"]
IDX = "instr({0}, concat('def ', split_part(symbol, '.', -1), '(')) - 1"
AROUND = f"CASE WHEN {{0}} IS NULL THEN NULL WHEN length({{0}}) <= {WINDOW} THEN {{0}} WHEN {IDX} < 0 THEN concat(substr({{0}}, 1, {WINDOW}), chr(10), '# [truncated]') ELSE concat(CASE WHEN greatest(0, {IDX} - {WINDOW // 4}) > 0 THEN concat('# [...leading content omitted...]', chr(10)) ELSE '' END, substr({{0}}, greatest(0, {IDX} - {WINDOW // 4}) + 1, least(length({{0}}), {IDX} + {WINDOW * 3 // 4}) - greatest(0, {IDX} - {WINDOW // 4})), CASE WHEN least(length({{0}}), {IDX} + {WINDOW * 3 // 4}) < length({{0}}) THEN concat(chr(10), '# [truncated]') ELSE '' END) END"
at = lambda alias, idx: f"LEFT JOIN ({FILES}) {alias} ON {alias}.repo = q.repo AND {alias}.file_path = q.file_path AND {alias}.slice_idx = q.{idx}"
register("context_point_lookup", f"SELECT q.q, q.repo, {AROUND.format('f.content')} AS content FROM ({QUESTIONS}) q {at('f', 'slice_idx')}")(lambda s, d: O.point(questions(s, d), files(s, d), window=WINDOW).select(*KEY, "content"))
register("context_pair_lookup", f"SELECT q.q, q.repo, {AROUND.format('f.content')} AS from_content, {AROUND.format('t.content')} AS to_content FROM ({QUESTIONS}) q {at('f', 'from_idx')} {at('t', 'to_idx')}")(lambda s, d: O.pair(questions(s, d), files(s, d), WINDOW).select(*KEY, "from_content", "to_content"))
near = lambda low, high, best: f"SELECT q.q, q.repo, x.found_idx, x.text FROM ({QUESTIONS}) q LEFT JOIN (SELECT q.q, q.repo, {best}(f.slice_idx, f.slice_idx) AS found_idx, {best}(f.content, f.slice_idx) AS text FROM ({QUESTIONS}) q JOIN ({FILES}) f ON f.repo = q.repo AND f.file_path = q.file_path AND f.slice_idx BETWEEN {low} AND {high} GROUP BY q.q, q.repo) x ON x.q = q.q AND x.repo = q.repo"
register("version_boundary_asof", f"SELECT *, 'first' AS side FROM ({near('q.from_idx', 'q.to_idx', 'arg_min')}) a UNION ALL SELECT *, 'last' FROM ({near('q.from_idx', 'q.to_idx', 'arg_max')}) b")(
    lambda s, d: (lambda q, f: O.boundary(q, f, KEY, True).select(*KEY, "found_idx", "text", F.lit("first").alias("side")).unionByName(O.boundary(q, f, KEY, False).select(*KEY, "found_idx", "text", F.lit("last").alias("side"))))(questions(s, d), files(s, d)))
register("nearest_snapshot_fallback", f"SELECT *, 'forward' AS side FROM ({near('q.from_idx', 'q.from_idx + 7', 'arg_min')}) a UNION ALL SELECT *, 'backward' FROM ({near('q.to_idx - 7', 'q.to_idx', 'arg_max')}) b")(
    lambda s, d: (lambda q, f: O.fallback(q, f, KEY, "from_idx", True).select(*KEY, "found_idx", "text", F.lit("forward").alias("side")).unionByName(O.fallback(q, f, KEY, "to_idx", False).select(*KEY, "found_idx", "text", F.lit("backward").alias("side"))))(questions(s, d), files(s, d)))


def class_questions(spark, sf_dir):
    raw = A.public(A.classes(spark, sf_dir))
    return raw, raw.select("repo", "slice_idx", "file_path", "name", F.col("ord").alias("q"))


RELATED = A.symbols_cte("class", False) + ", hits AS (SELECT q.repo, q.slice_idx, q.ord AS q, f.file_path AS path, MIN(f.ord) AS o FROM sym q JOIN (SELECT repo, slice_idx, ord, file_path, unnest(base_classes) AS name FROM sym) f ON f.repo = q.repo AND f.slice_idx = q.slice_idx AND f.name = q.name WHERE f.file_path <> q.file_path GROUP BY ALL) SELECT s.repo, s.slice_idx, s.ord AS q, COALESCE(h.n, 0) AS n_related, COALESCE(h.paths, '') AS related FROM sym s LEFT JOIN (SELECT repo, slice_idx, q, COUNT(*) AS n, array_to_string(list(path ORDER BY o)[1:6], ',') AS paths FROM hits GROUP BY repo, slice_idx, q) h ON h.repo = s.repo AND h.slice_idx = s.slice_idx AND h.q = s.ord"


@register("related_files", RELATED)
def related_files(spark, sf_dir):
    raw, q = class_questions(spark, sf_dir)
    found = O.related_paths(q, raw, "base_classes", ["repo", "slice_idx", "q"])
    return found.select("repo", "slice_idx", "q", F.col("n_related").cast("long").alias("n_related"), F.array_join("related", ",").alias("related"))


@register("symbol_window", f"SELECT repo, slice_idx, file_path, {AROUND.format('content')} AS part FROM (SELECT *, 'K.f1' AS symbol FROM ({FILES}) f) g")
def symbol_window(spark, sf_dir):
    return files(spark, sf_dir).select("repo", "slice_idx", "file_path", O.around(F.col("content"), F.lit("K.f1"), WINDOW).alias("part"))


@register("question_only_prompt", "SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'")
def question_only_prompt(spark, sf_dir):
    return A.views(spark, sf_dir, "conversations")["conversations"].filter("role = 'user'").select("conv_id", "turn", P.question_only(F.col("text")).alias("prompt"))


TYPES = "CASE s_suppkey % 3 WHEN 0 THEN 'intrinsic' WHEN 1 THEN 'temporal' ELSE 'extrinsic' END"
KINDS = "CASE s_suppkey % 15 WHEN 0 THEN 'function_signature' WHEN 3 THEN 'class_fields' WHEN 6 THEN 'other' WHEN 9 THEN 'symbol_callers' WHEN 12 THEN 'class_inheritance' WHEN 1 THEN 'function_introduced' WHEN 4 THEN 'function_calls_changed' WHEN 7 THEN 'function_return_type_changed' WHEN 10 THEN 'function_signature_changed' WHEN 13 THEN 'class_last_present' WHEN 2 THEN 'yesno' ELSE 'wh_object' END"


@register("build_prompt")
def build_prompt(spark, sf_dir):
    q = questions(spark, sf_dir)
    kind = F.expr(KINDS.replace("s_suppkey", "q"))
    q = O.pair(O.point(q, files(spark, sf_dir), window=WINDOW), files(spark, sf_dir), WINDOW).withColumn("qa_type", F.expr(TYPES.replace("s_suppkey", "q"))).withColumn("qa_subtype", kind)
    q = q.withColumn("question", F.concat(F.lit("What of "), "symbol", F.lit("?"))).withColumn("from_version", F.concat(F.lit("v"), F.col("from_idx"))).withColumn("to_version", F.concat(F.lit("v"), F.col("to_idx"))).withColumn("related_contents", F.array().cast("array<struct<file_path:string,content:string>>"))
    return q.select(*KEY, "qa_type", "qa_subtype", P.prompt().alias("prompt"))


DOCS = "SELECT concat('r', CAST(doc_id % 5 AS VARCHAR(9))) AS repo, CAST(doc_id % 3 AS INT) AS slice_idx, concat(CASE WHEN doc_id % 8 = 0 THEN '.git/' ELSE 'src/' END, CAST(doc_id AS VARCHAR(20))) AS path, COALESCE(text, '') AS content, CASE WHEN lang = 'es' THEN NULL ELSE lang END AS language, n_chars, source FROM documents"
LINES = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END"
docs = lambda s, d: A.sql_over(s, d, DOCS, "documents")
register("repo_totals", f"SELECT repo, COUNT(*) AS total_files, CAST(SUM({LINES}) AS BIGINT) AS total_lines FROM ({DOCS}) x WHERE path NOT LIKE '.git/%' GROUP BY repo")(lambda s, d: M.repository_totals(docs(s, d)))
as_text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
register("slice_statistics", f"SELECT repo, slice_idx, CAST(SUM(n) AS BIGINT) AS total_files, string_agg(concat(language, '=', n), ',' ORDER BY language) AS languages FROM (SELECT repo, slice_idx, COALESCE(language, 'unknown') AS language, COUNT(*) AS n FROM ({DOCS}) x GROUP BY ALL) y GROUP BY repo, slice_idx")(lambda s, d: M.slice_statistics(docs(s, d)).withColumn("languages", as_text("languages")))
SLICE_ROWS = "SELECT repo, source AS slice_type, n_chars AS files, n_chars * 2 AS lines, n_chars % 7 AS functions, n_chars % 3 AS classes FROM (" + DOCS + ") x"
register("dataset_summary", f"SELECT repo, CAST(SUM(c) AS BIGINT) AS n_slices, CAST(SUM(f) AS BIGINT) AS total_files, CAST(SUM(l) AS BIGINT) AS total_lines, CAST(SUM(u) AS BIGINT) AS total_functions, CAST(SUM(k) AS BIGINT) AS total_classes, string_agg(concat(slice_type, '=', c), ',' ORDER BY slice_type) AS slice_types FROM (SELECT repo, slice_type, COUNT(*) AS c, SUM(files) AS f, SUM(lines) AS l, SUM(functions) AS u, SUM(classes) AS k FROM ({SLICE_ROWS}) y GROUP BY repo, slice_type) z GROUP BY repo")(lambda s, d: M.dataset_summary(A.sql_over(s, d, SLICE_ROWS, "documents")).withColumn("slice_types", as_text("slice_types")))
