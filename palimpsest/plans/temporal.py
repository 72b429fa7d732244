"""Temporal queries: the 16 of adjacent snapshots and the 7 of whole chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as S
from ..operators import snapshots as O
from ..operators.qa import flat
from . import adaptors as A

QUERIES, ORACLES = {}, {}
FUNCTION_CHANGES = ("introduced", "not_introduced", "removed", "not_removed", "signature_changed", "signature_unchanged", "return_type_changed", "return_type_unchanged", "calls_changed", "instantiations_changed")
CLASS_CHANGES = ("introduced", "not_introduced", "removed", "not_removed", "inheritance_changed", "inheritance_unchanged")
LOADS = {"function": A.functions, "class": A.classes}


def symbol_tables(spark, sf_dir, kind):
    raw = LOADS[kind](spark, sf_dir)
    return A.public(raw, production=True), A.slices(raw)


def change(kind, name):
    def query(spark, sf_dir):
        return flat(O.change_questions(O.transitions(*symbol_tables(spark, sf_dir, kind)), kind, f"{kind}_{name}"))

    return query


def presence(kind, which):
    def query(spark, sf_dir):
        return flat(O.presence_questions(*symbol_tables(spark, sf_dir, kind), kind, which))

    return query


VALUES = {
    "return_type_evolution": lambda: S.blank(F.col("return_type"), F.lit("unknown")),
    "signature_evolution": lambda: S.blank(F.col("signature"), F.col("params")),
    "inheritance_evolution": lambda: S.list_text(F.array_sort("base_classes")),
}


def trajectory(kind, which):
    def query(spark, sf_dir):
        return flat(O.trajectory_questions(*symbol_tables(spark, sf_dir, kind), kind, which, VALUES[which]()))

    return query


# --- the checking SQL: a full outer join of each snapshot with the next ----------------------------------------
LIST = "concat('[', array_to_string(list_transform({0}, lambda v: concat('''', v, '''')), ', '), ']')"
SIGNATURE = "COALESCE(NULLIF({0}.signature, ''), {0}.params)"
RETURNS = "COALESCE(NULLIF({0}.return_type, ''), 'unknown')"


def pairs_cte(kind):
    return A.symbols_cte(kind, True) + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, slice_idx, key ORDER BY ord DESC) AS rn FROM sym) t WHERE rn = 1),
steps AS (SELECT a.repo, a.slice_idx AS from_idx, a.slice_id AS from_id, a.label AS prev_v, b.slice_id AS to_id, b.label AS curr_v FROM slices a JOIN slices b ON a.repo = b.repo AND b.slice_idx = a.slice_idx + 1),
prevs AS (SELECT s.*, o AS p, o.key AS k FROM steps s JOIN one o ON o.repo = s.repo AND o.slice_idx = s.from_idx),
currs AS (SELECT s.*, o AS c, o.key AS k FROM steps s JOIN one o ON o.repo = s.repo AND o.slice_idx = s.from_idx + 1),
moves AS (SELECT COALESCE(x.repo, y.repo) AS repo, COALESCE(x.from_idx, y.from_idx) AS from_idx, COALESCE(x.from_id, y.from_id) AS from_id, COALESCE(x.to_id, y.to_id) AS to_id, COALESCE(x.prev_v, y.prev_v) AS prev_v, COALESCE(x.curr_v, y.curr_v) AS curr_v, COALESCE(x.k, y.k) AS k, x.p AS p, y.c AS c,
   CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' ELSE 'stable' END AS status FROM prevs x FULL OUTER JOIN currs y ON x.repo = y.repo AND x.from_idx = y.from_idx AND x.k = y.k)"""


def strided(where, n):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, from_idx ORDER BY k) - 1 AS place, COUNT(*) OVER (PARTITION BY repo, from_idx) AS total FROM moves WHERE {where}) t WHERE total <= {n} OR list_contains(list_transform(range({n}), lambda i: CAST(floor(i * (CAST(total AS DOUBLE) / {n})) AS BIGINT)), place)"


def change_sql(kind, name):
    what = "function/method" if kind == "function" else "class"
    side = "p" if name in ("removed", "not_removed") else "c"
    q = lambda head, tail: f"concat('{head}', {side}.ref, '{tail}between ', prev_v, ' and ', curr_v, '?')"
    both = lambda e: f"concat('from: ', {e.format('p')}, ' ; to: ', {e.format('c')})"
    stable = "status = 'stable'"
    if name in ("introduced", "removed"):
        rows, question, answer = f"SELECT * FROM moves WHERE status = '{'added' if name == 'introduced' else 'removed'}'", q(f"Was {what} ", f" {name} "), "'Yes'"
    elif name.startswith("not_"):
        rows, question, answer = strided(stable, 20), q(f"Was {what} ", f" {name[4:]} "), "'No'"
    elif name in ("signature_changed", "return_type_changed"):
        e = SIGNATURE if name == "signature_changed" else RETURNS
        head = "How did the signature" if name == "signature_changed" else "Did the return type"
        rows, question, answer = f"SELECT * FROM moves WHERE {stable} AND {e.format('p')} <> {e.format('c')}", q(f"{head} of {what} ", " change "), both(e)
    elif name in ("signature_unchanged", "return_type_unchanged"):
        e = SIGNATURE if name == "signature_unchanged" else RETURNS
        rows, question, answer = strided(f"{stable} AND {e.format('p')} = {e.format('c')}", 10), q(f"Did the {'signature' if name == 'signature_unchanged' else 'return type'} of {what} ", " change "), "'No'"
    elif name in ("calls_changed", "instantiations_changed"):
        col = name.split("_")[0]
        less = lambda a, b: f"list_sort(list_filter({a}.{col}, lambda v: NOT list_contains({b}.{col}, v)))"
        part = lambda word, x: f"CASE WHEN len({x}) > 0 THEN concat('{word}: ', array_to_string({x}, ', ')) END"
        answer = f"concat_ws('; ', {part('added', less('c', 'p'))}, {part('removed', less('p', 'c'))})"
        rows, question = f"SELECT * FROM moves WHERE {stable} AND p.{col} <> c.{col}", q(f"Did the set of {'functions called' if col == 'calls' else 'classes instantiated'} within ", " change ")
    elif name == "inheritance_changed":
        rows, question, answer = f"SELECT * FROM moves WHERE {stable} AND p.base_classes <> c.base_classes", q("How did the inheritance of class ", " change "), f"concat('from: ', {LIST.format('p.base_classes')}, ' ; to: ', {LIST.format('c.base_classes')})"
    else:
        rows, question, answer = strided(f"{stable} AND p.base_classes = c.base_classes", 10), q("Did the inheritance of class ", " change "), "'No'"
    return f"{pairs_cte(kind)} SELECT {A.qa_sql('temporal', f'{kind}_{name}', question, answer, f'{side}.ref', f'{side}.file_path', kind, from_id='from_id', to_id='to_id', keyed=True)} FROM ({rows}) r"


ENDS = ", ends AS (SELECT repo, arg_min(slice_id, slice_idx) AS from_id, arg_max(slice_id, slice_idx) AS to_id, arg_min(label, slice_idx) AS first_v, arg_max(label, slice_idx) AS last_v, MIN(slice_idx) AS low, MAX(slice_idx) AS high, COUNT(*) AS n FROM slices GROUP BY repo)"


def presence_sql(kind, which):
    what = "function/method" if kind == "function" else "class"
    first = which == "first_introduced"
    return (
        A.symbols_cte(kind, True) + ENDS + f""", span AS (SELECT repo, key, {'MIN' if first else 'MAX'}(slice_idx) AS at, arg_min(ref, CAST(slice_idx AS BIGINT) * 1000000000 + ord) AS ref, arg_min(file_path, CAST(slice_idx AS BIGINT) * 1000000000 + ord) AS file_path FROM sym GROUP BY repo, key),
found AS (SELECT s.*, e.from_id, e.to_id, l.label FROM span s JOIN ends e ON s.repo = e.repo JOIN slices l ON l.repo = s.repo AND l.slice_idx = s.at WHERE e.n >= 2 AND s.at <> e.{'low' if first else 'high'})
SELECT """ + A.qa_sql("temporal", f"{kind}_{which}", f"concat('In which version was {what} ', ref, '{' first introduced?' if first else ' last present?'}')", "label", "ref", "file_path", kind, from_id="from_id", to_id="to_id", keyed=True) + " FROM found")


def trajectory_sql(kind, which):
    what = "function/method" if kind == "function" else "class"
    value = {"return_type_evolution": RETURNS.format("sym"), "signature_evolution": SIGNATURE.format("sym"), "inheritance_evolution": LIST.format("list_sort(sym.base_classes)")}[which]
    topic = {"return_type_evolution": "return type", "signature_evolution": "signature", "inheritance_evolution": "inheritance"}[which]
    return (
        A.symbols_cte(kind, True) + ENDS + f""", one AS (SELECT repo, key, slice_idx, arg_min({value}, ord) AS val, arg_min(ref, ord) AS ref, arg_min(file_path, ord) AS file_path FROM sym GROUP BY repo, key, slice_idx),
lagged AS (SELECT *, lag(val) OVER (PARTITION BY repo, key ORDER BY slice_idx) AS b4 FROM one),
traj AS (SELECT g.repo, g.key, string_agg(concat(l.label, ': ', g.val), ' -> ' ORDER BY g.slice_idx) FILTER (WHERE g.b4 IS NULL OR g.b4 <> g.val) AS answer, COUNT(*) FILTER (WHERE g.b4 IS NULL OR g.b4 <> g.val) AS runs, arg_min(g.ref, g.slice_idx) AS ref, arg_min(g.file_path, g.slice_idx) AS file_path FROM lagged g JOIN slices l ON l.repo = g.repo AND l.slice_idx = g.slice_idx GROUP BY g.repo, g.key),
found AS (SELECT t.*, e.from_id, e.to_id, e.first_v, e.last_v FROM traj t JOIN ends e ON t.repo = e.repo WHERE t.runs >= 2 AND e.n >= 3)
SELECT """ + A.qa_sql("temporal", f"{kind}_{which}", f"concat('How did the {topic} of {what} ', ref, ' evolve from ', first_v, ' to ', last_v, '?')", "answer", "ref", "file_path", kind, from_id="from_id", to_id="to_id", keyed=True) + " FROM found")


for _kind, _names in (("function", FUNCTION_CHANGES), ("class", CLASS_CHANGES)):
    for _n in _names:
        QUERIES[f"{_kind}_{_n}"], ORACLES[f"{_kind}_{_n}"] = change(_kind, _n), change_sql(_kind, _n)
    for _n in ("first_introduced", "last_present"):
        QUERIES[f"{_kind}_{_n}"], ORACLES[f"{_kind}_{_n}"] = presence(_kind, _n), presence_sql(_kind, _n)
for _kind, _n in (("function", "return_type_evolution"), ("function", "signature_evolution"), ("class", "inheritance_evolution")):
    QUERIES[f"{_kind}_{_n}"], ORACLES[f"{_kind}_{_n}"] = trajectory(_kind, _n), trajectory_sql(_kind, _n)
