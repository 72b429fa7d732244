"""Queries on documentation text; documents and turns are the docstrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import docs as D
from ..functions.symbols import first_sentence
from . import adaptors as A

QUERIES, ORACLES = {}, {}
TEXTS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat('\"\"\"', text) WHEN 1 THEN concat(text, chr(10), ' ', chr(10), 'more') WHEN 2 THEN concat('  >>> f(x)', chr(10), text) WHEN 3 THEN concat(text, '<b>') WHEN 4 THEN concat('f\"', text) WHEN 5 THEN concat('{a} {b}', text, '{c}') ELSE text END AS doc FROM documents"""
PARTS = """SELECT conv_id, turn, text AS head, CASE turn % 4 WHEN 0 THEN 'will be' WHEN 1 THEN '' WHEN 2 THEN ' is ' ELSE 'has  been  so' END AS aux, CASE WHEN conv_id % 6 = 0 THEN 'the function returns a value' WHEN conv_id % 6 = 1 THEN text ELSE concat('What does This  Method of ', CAST(conv_id AS VARCHAR(9)), ' do?') END AS question,
 CASE WHEN turn % 5 = 0 THEN 'one two' WHEN turn % 5 = 1 THEN 'a {b} c d' WHEN turn % 5 = 2 THEN 'see <a href' ELSE 'three words here' END AS answer, CASE WHEN conv_id % 4 = 0 THEN 'yesno' ELSE 'wh_object' END AS subtype FROM conversations"""


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


T = "regexp_replace(regexp_replace(regexp_replace(COALESCE(doc, ''), '^[\\s\"'' ]+|[\\s\"'' ]+$', '', 'g'), '(?m)^\\s*>>>.*$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
register("docstring_clean", f"SELECT doc_id, CASE WHEN regexp_matches(t, '<[a-zA-Z][^>]*>') OR len(regexp_extract_all(t, '\\{{[a-zA-Z_]\\w*\\}}')) >= 3 OR regexp_matches(t, '^f[\"'']') THEN '' ELSE {S.format('regexp_split_to_array(t, chr(10) || ' + chr(39) + chr(92) + 's*' + chr(39) + ' || chr(10))[1]')} END AS body FROM (SELECT doc_id, {T} AS t FROM ({TEXTS}) d) x")(lambda s, d: A.sql_over(s, d, TEXTS, "documents").select("doc_id", D.clean(F.col("doc")).alias("body")))
parts = lambda s, d: A.sql_over(s, d, PARTS, "conversations")
Q = f"regexp_replace(array_to_string(list_filter([{S.format('aux')}, {S.format('head')}, ''], lambda v: v <> ''), ' '), '\\s{{2,}}', ' ', 'g')"
register("question_assembly", f"SELECT conv_id, turn, concat(upper(substr(q, 1, 1)), substr(q, 2), '?') AS question, CASE WHEN {S.format('aux')} = '' THEN 'does' ELSE regexp_extract({S.format('aux')}, '^\\S+', 0) END AS aux_first, regexp_extract({S.format('aux')}, '^\\S+\\s+(.*)$', 1) AS aux_rest FROM (SELECT *, {Q} AS q FROM ({PARTS}) p) x")(
    lambda s, d: parts(s, d).select("conv_id", "turn", D.assemble(F.col("aux"), F.col("head"), F.lit(" ")).alias("question"), D.split_auxiliary(F.col("aux"))["first"].alias("aux_first"), D.split_auxiliary(F.col("aux"))["rest"].alias("aux_rest")))
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda v: v <> ''))"
register("qa_row_gates", f"SELECT conv_id, turn, CASE WHEN q <> '' AND answer <> '' AND NOT regexp_matches(q, '\\n|<[a-zA-Z/]') AND NOT regexp_matches(answer, '\\n|<[a-zA-Z/]') AND q NOT LIKE '%{{%' AND answer NOT LIKE '%{{%' AND {WORDS.format('q')} >= 4 AND (subtype = 'yesno' OR {WORDS.format('answer')} >= 3) THEN q END AS question FROM (SELECT *, regexp_replace(question, '(?i)\\b(?:the|this)\\s+(?:function|method|class|code)\\b', 'K.f', 'g') AS q FROM ({PARTS}) p) x")(
    lambda s, d: parts(s, d).select("conv_id", "turn", D.gated(F.col("subtype"), F.col("question"), F.col("answer"), F.lit("K.f")).alias("question")))
register("preposition_role", "SELECT event_id, CASE WHEN p IN ('" + "', '".join(D.TEMPORAL) + "') THEN 'temporal' WHEN p IN ('" + "', '".join(D.LOCATIVE) + "') THEN 'locative' WHEN p IN ('" + "', '".join(D.MANNER) + "') THEN 'manner' END AS role FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'after' WHEN 1 THEN 'within' WHEN 2 THEN 'by' WHEN 3 THEN 'of' ELSE 'until' END AS p FROM events) e")(
    lambda s, d: A.sql_over(s, d, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'After' WHEN 1 THEN 'WITHIN' WHEN 2 THEN 'by' WHEN 3 THEN 'of' ELSE 'until' END AS p FROM events", "events").select("event_id", D.role(F.col("p")).alias("role")))
register("first_sentence", "SELECT doc_id, trim(CASE WHEN contains(trim(text), '. ') THEN split_part(trim(text), '. ', 1) ELSE split_part(trim(text), chr(10), 1) END) AS sentence FROM documents")(lambda s, d: A.views(s, d, "documents")["documents"].select("doc_id", first_sentence(F.col("text")).alias("sentence")))
