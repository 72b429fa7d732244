"""Queries over answers: conversations are the questions, the next assistant turn the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as V
from ..operators import scoring as O
from . import adaptors as A

QUERIES, ORACLES = {}, {}
#: A prediction and what it is held against: the same text in capitals with a stop, the question, or the text's list form.
QA = """SELECT conv_id, turn, question, prediction,
 CASE WHEN turn % 3 = 0 THEN concat('The ', prediction, '!') WHEN turn % 3 = 1 THEN question ELSE concat(prediction, ' ', question) END AS ground_truth,
 CASE WHEN conv_id % 5 = 0 THEN 'extrinsic' WHEN conv_id % 2 = 0 THEN 'temporal' ELSE 'intrinsic' END AS qa_type,
 CASE WHEN conv_id % 10 = 0 THEN 'yesno' WHEN conv_id % 5 = 0 THEN 'wh_object' WHEN conv_id % 4 = 0 THEN 'function_calls_changed' WHEN conv_id % 2 = 0 THEN 'function_first_introduced' WHEN conv_id % 3 = 0 THEN 'field_accesses' ELSE 'symbol_callers' END AS qa_subtype
FROM (SELECT conv_id, turn, role, text AS question, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations) c
WHERE role = 'user'"""
#: The same as item lists, changes and versions: words joined by commas, with marks that normal forms take away.
LISTS = """SELECT conv_id, turn, concat('`this.', replace(text, ' ', ', '), '`;new Foo(1).bar(),', replace(text, ' ', '(), A.')) AS items,
 concat('Added: ', text, '; removed: None ;other v', CAST(turn AS VARCHAR(9)), ' ; REMOVED : v', CAST(conv_id AS VARCHAR(9)), '.1') AS change,
 concat(' ```py', chr(10), text, chr(10), '``` ', text) AS fenced, concat(text, '<|im_end|> rest') AS marked, concat('`', CAST(conv_id AS VARCHAR(9)), '`') AS ticked FROM conversations"""
WS = "\\s"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NORM = "trim(regexp_replace(regexp_replace(translate(lower({0}), '" + V.PUNCTUATION.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', '" + " " * len(V.PUNCTUATION) + "'), '(^|[^0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}])(a|an|the)(([^0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+)(a|an|the))*([^0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]|$)', ' ', 'g'), '\\s+', ' ', 'g'))"
TOK = "list_filter(string_split(" + NORM + ", ' '), lambda t: t <> '')"


def qa(spark, sf_dir):
    return A.sql_over(spark, sf_dir, QA, "conversations")


def lists(spark, sf_dir):
    return A.sql_over(spark, sf_dir, LISTS, "conversations")


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


ID = ("conv_id", "turn")
PAIR = f"(SELECT * FROM ({QA}) q WHERE prediction IS NOT NULL) q"


def answered(spark, sf_dir):
    return qa(spark, sf_dir).filter("prediction IS NOT NULL")


P, G = F.col, None
register("normalize_text", f"SELECT conv_id, turn, {NORM.format('question')} AS normal FROM ({QA}) q")(lambda s, d: qa(s, d).select(*ID, V.normalized(F.col("question")).alias("normal")))
register("exact_match", f"SELECT conv_id, turn, CAST({NORM.format('prediction')} = {NORM.format('ground_truth')} AS DOUBLE) AS em FROM {PAIR}")(lambda s, d: answered(s, d).select(*ID, V.exact_match(F.col("prediction"), F.col("ground_truth")).alias("em")))
F1 = """CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) WHEN same = 0 THEN 0.0e0
 ELSE 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END"""
SAME = "CAST(COALESCE(list_sum(list_transform(list_distinct(list_filter(p, lambda t: list_contains(g, t))), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS DOUBLE)"
register("token_f1", f"SELECT conv_id, turn, round({F1}, 9) AS f1 FROM (SELECT *, {SAME} AS same FROM (SELECT conv_id, turn, {TOK.format('prediction')} AS p, {TOK.format('ground_truth')} AS g FROM {PAIR}) a) b")(lambda s, d: answered(s, d).select(*ID, F.round(V.token_f1(F.col("prediction"), F.col("ground_truth")), 9).alias("f1")))
register("rouge_l")(lambda s, d: answered(s, d).select(*ID, F.round(V.rouge_l(F.col("prediction"), F.col("ground_truth")), 9).alias("rouge_l")))
YESNO = "CASE WHEN regexp_extract({0}, '^\\s*(\\S+)', 1) = '' THEN 0.0e0 ELSE CAST(regexp_replace(lower(regexp_extract({0}, '^\\s*(\\S+)', 1)), '[.,!?:;]+$', '') = lower(" + STRIP.format("{1}") + ") AS DOUBLE) END"
register("yesno_em", f"SELECT conv_id, turn, {YESNO.format('prediction', 'split_part(lower(prediction), chr(32), 1)')} AS yesno_em FROM {PAIR}")(lambda s, d: answered(s, d).select(*ID, V.yesno_match(F.col("prediction"), F.split_part(F.lower("prediction"), F.lit(" "), F.lit(1))).alias("yesno_em")))
VERSION = "regexp_replace({0}, '\\bv([0-9])', '\\1', 'g')"
register("normalize_version", f"SELECT conv_id, turn, {VERSION.format('change')} AS normal FROM ({LISTS}) q")(lambda s, d: lists(s, d).select(*ID, V.plain_version(F.col("change")).alias("normal")))
CHANGE = "array_to_string(list_filter(list_transform(list_filter(list_transform(string_split({0}, ';'), lambda a: " + STRIP.format("a") + "), lambda a: a <> ''), lambda a: CASE WHEN regexp_matches(a, '(?i)^(added|removed)\\s*:\\s*(.+)$') THEN CASE WHEN lower(" + STRIP.format("regexp_extract(a, '(?i)^(added|removed)\\s*:\\s*(.+)$', 2)") + ") IN ('null', 'none', 'n/a', '') THEN NULL ELSE concat(lower(regexp_extract(a, '(?i)^(added|removed)\\s*:\\s*(.+)$', 1)), ': ', " + STRIP.format("regexp_extract(a, '(?i)^(added|removed)\\s*:\\s*(.+)$', 2)") + ") END ELSE a END), lambda a: a IS NOT NULL), '; ')"
register("normalize_change", f"SELECT conv_id, turn, {CHANGE.format('change')} AS normal FROM ({LISTS}) q")(lambda s, d: lists(s, d).select(*ID, V.plain_change(F.col("change")).alias("normal")))
ITEMS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({0}, '[,;]'), lambda a: " + STRIP.format("a") + "), lambda a: a <> ''), lambda a: {1}), lambda a: a <> ''))), ', ')"
BARE = STRIP.format("trim(a, '`')")
register("normalize_item_list", f"SELECT conv_id, turn, {ITEMS.format('items', f'regexp_replace({BARE}, {chr(39)}^this[.]{chr(39)}, {chr(39)}{chr(39)})')} AS normal FROM ({LISTS}) q")(lambda s, d: lists(s, d).select(*ID, V.item_list(F.col("items")).alias("normal")))
CALLER = STRIP.format(f"regexp_replace(regexp_replace(regexp_replace({BARE}, '^new\\s+[A-Za-z0-9_]+\\([^)]*\\)\\.', ''), '^[\\p{{L}}\\p{{N}}_]+\\.', ''), '\\(.*\\)$', '')")
register("normalize_caller_list", f"SELECT conv_id, turn, {ITEMS.format('items', CALLER)} AS normal FROM ({LISTS}) q")(lambda s, d: lists(s, d).select(*ID, V.caller_list(F.col("items")).alias("normal")))
register("strip_code_fence", f"SELECT conv_id, turn, {STRIP.format('text')} AS body, CAST(conv_id AS VARCHAR) AS single FROM conversations")(lambda s, d: lists(s, d).select(*ID, V.without_fence(F.col("fenced")).alias("body"), V.without_fence(F.col("ticked")).alias("single")))
register("strip_special_tokens", f"SELECT conv_id, turn, {STRIP.format('text')} AS cut FROM conversations")(lambda s, d: lists(s, d).select(*ID, V.without_markers(F.col("marked")).alias("cut")))


@register("compute_metrics")
def compute_metrics(spark, sf_dir):
    m = O.scored(qa(spark, sf_dir))
    return m.select(*ID, "qa_type", "qa_subtype", *(F.round(F.col("metrics")[k], 9).alias(k) for k in ("em", "f1", "rouge_l", "yesno_em")))


@register("aggregate_metrics", f"""SELECT qa_type, qa_subtype, metric, round(SUM(v) / MAX(n), 9) AS mean FROM (
 SELECT qa_type, qa_subtype, unnest(['a', 'b']) AS metric, unnest([CAST(turn AS DOUBLE), CASE WHEN turn % 3 = 0 THEN CAST(conv_id AS DOUBLE) END]) AS v, COUNT(*) OVER (PARTITION BY qa_type, qa_subtype) AS n FROM {PAIR}) x WHERE v IS NOT NULL GROUP BY qa_type, qa_subtype, metric""")
def aggregate_metrics(spark, sf_dir):
    rows = answered(spark, sf_dir)
    both = F.create_map(F.lit("a"), F.col("turn").cast("double"), F.lit("b"), F.col("conv_id").cast("double"))
    one = F.create_map(F.lit("a"), F.col("turn").cast("double"))
    rows = rows.withColumn("metrics", F.when(F.col("turn") % 3 == 0, both).otherwise(one))
    rows = rows.unionByName(qa(spark, sf_dir).filter("prediction IS NULL").withColumn("metrics", F.create_map().cast("map<string,double>")))
    return O.means(rows).withColumn("mean", F.round("mean", 9))


@register("eval_summary_counts", f"SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE prediction IS NULL) AS no_prediction, COUNT(*) FILTER (WHERE turn % 7 = 0) AS context_missing FROM ({QA}) q")
def eval_summary_counts(spark, sf_dir):
    return O.counts(qa(spark, sf_dir).withColumn("context_retrieved", F.col("turn") % 7 != 0))
