"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ngram_jaccard import op5_ngram_jaccard
from .one_bit_search import op7_one_bit_search
from .pii_crf import op4_pii_crf
from .quality_gam import op6_quality_gam
from .risk_rules import op8_risk_rules
from .source_mix import op2_source_mix
from .token_files import op1_token_files
from .toxicity import op9_toxicity
from .trie_bpe import op3_trie_bpe
from .url_reputation import ORACLE as URL_SQL
from .url_reputation import op10_url_reputation

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_source_mix": op2_source_mix,
    "op3_trie_bpe": op3_trie_bpe,
    "op4_pii_crf": op4_pii_crf,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_gam": op6_quality_gam,
    "op7_one_bit_search": op7_one_bit_search,
    "op8_risk_rules": op8_risk_rules,
    "op9_toxicity": op9_toxicity,
    "op10_url_reputation": op10_url_reputation,
}
#: Components by counting common shingles of all pairs that have one: for small tables only.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.k >= 85 * (a.n + b.n - p.k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.y, r.c FROM reach r JOIN both_ways l ON r.d = l.x)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, MIN(c) AS c FROM reach GROUP BY d) m ON m.d = w.doc_id
"""
ORACLES = {"op5_ngram_jaccard": JACCARD_SQL, "op10_url_reputation": URL_SQL}
