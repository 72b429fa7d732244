"""Queries on tags, distances and segments. Orders give tags, months of lines the changes between neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.symbols import language
from ..operators import slicing as O
from . import adaptors as A

QUERIES, ORACLES = {}, {}
TAGS = """SELECT c.c_mktsegment AS repo, o.o_orderkey AS tag_ord, sha1(concat(c.c_mktsegment, CAST(o.o_custkey AS VARCHAR(20)))) AS commit_hash, o.o_orderdate AS commit_date,
 CASE o.o_orderkey % 9 WHEN 0 THEN concat('v', CAST(year(o.o_orderdate) - 1990 AS VARCHAR(9)), '.', CAST(month(o.o_orderdate) AS VARCHAR(9)), '.', CAST(o.o_orderkey % 4 AS VARCHAR(9)))
  WHEN 1 THEN concat('release-', CAST(year(o.o_orderdate) - 1990 AS VARCHAR(9)), '.', CAST(month(o.o_orderdate) % 3 AS VARCHAR(9))) WHEN 2 THEN concat(CAST(month(o.o_orderdate) AS VARCHAR(9)), '.2-release')
  WHEN 3 THEN concat('v1.2.', CAST(month(o.o_orderdate) AS VARCHAR(9)), 'rc1') WHEN 4 THEN concat('Release_', CAST(month(o.o_orderdate) AS VARCHAR(9)), '.1') WHEN 5 THEN '1.2.3.4'
  WHEN 6 THEN concat('V', CAST(month(o.o_orderdate) AS VARCHAR(9))) WHEN 7 THEN 'nightly' ELSE concat('10.', CAST(o.o_orderkey % 20 AS VARCHAR(9))) END AS tag_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
#: Changes between neighbouring months of a market segment.
PAIRS = """SELECT repo, CAST(dense_rank() OVER (PARTITION BY repo ORDER BY ym) - 1 AS INT) AS idx, delta_lines, delta_files, api_break FROM (
 SELECT c.c_mktsegment AS repo, year(l.l_shipdate) * 12 + month(l.l_shipdate) AS ym, CAST(SUM(l.l_quantity) AS BIGINT) AS delta_lines, COUNT(DISTINCT l.l_partkey) AS delta_files,
  CAST(MAX(CASE WHEN l.l_returnflag = 'R' AND l.l_discount >= 0.1 AND l.l_quantity >= 48 THEN 1 ELSE 0 END) AS INT) AS api_break
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, year(l.l_shipdate) * 12 + month(l.l_shipdate)) m"""
NUMSTAT = """SELECT l_orderkey, CASE WHEN l_partkey % 17 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS added, CASE WHEN l_partkey % 17 = 0 THEN '-' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS deleted,
 CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE concat('p', CAST(l_partkey AS VARCHAR(20))) END AS path FROM lineitem"""
SLICES = """SELECT c_mktsegment AS repo, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INT) AS slice_idx, sha1(CASE WHEN c_mktsegment LIKE 'B%' THEN 'x' ELSE c_name END) AS commit_hash, c_custkey AS commit_date FROM customer"""
FILES = """SELECT concat('repo', CAST(doc_id % 7 AS VARCHAR(9))) AS repo, CAST(doc_id % 5 AS INT) AS slice_idx, concat('src/d', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.md' ELSE '' END) AS path, text, lang, source, n_chars, (n_chars % 10 > 0 OR doc_id % 7 > 3) AS parsed FROM documents"""


def tags(spark, sf_dir):
    return A.sql_over(spark, sf_dir, TAGS, "orders", "customer")


def pairs(spark, sf_dir):
    return A.sql_over(spark, sf_dir, PAIRS, "lineitem", "orders", "customer")


def files(spark, sf_dir):
    return A.sql_over(spark, sf_dir, FILES, "documents")


def register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


CLEAN = "regexp_replace(regexp_replace(regexp_replace(tag_name, '^[vV]', ''), '(?i)^release[-_.]?', ''), '(?i)[-_.]?release$', '')"
PART = "CAST(COALESCE(NULLIF(regexp_extract(c, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?$', {0}), ''), '0') AS INTEGER)"
PARSED = f"(SELECT *, {PART.format(1)} AS major, {PART.format(2)} AS minor, {PART.format(3)} AS patch FROM (SELECT *, {CLEAN} AS c FROM ({TAGS}) t) u WHERE regexp_matches(c, '^(\\d+)(\\.(\\d+))?(\\.(\\d+))?$'))"
KIND = "CASE WHEN minor = 0 AND patch = 0 THEN 'major' WHEN patch = 0 THEN 'minor' ELSE 'patch' END"


def versions(df):
    return df.select("repo", "tag_ord", "tag_name", T.release_version(F.col("tag_name")).alias("v"))


register("parse_release_tag", f"SELECT t.tag_ord, t.tag_name, p.major, p.minor, p.patch FROM ({TAGS}) t LEFT JOIN {PARSED} p ON t.tag_ord = p.tag_ord")(lambda s, d: versions(tags(s, d)).select("tag_ord", "tag_name", "v.major", "v.minor", "v.patch"))
register("tag_version_type", f"SELECT repo, {KIND} AS kind, COUNT(*) AS n FROM {PARSED} p GROUP BY repo, {KIND}")(lambda s, d: versions(tags(s, d)).filter("v IS NOT NULL").groupBy("repo", T.version_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
DEDUP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY major DESC, minor DESC, patch DESC, tag_ord) AS rn FROM {PARSED} p) x WHERE rn = 1)"
register("tag_anchor_dedup", f"SELECT repo, commit_hash, tag_name, {KIND} AS kind FROM {DEDUP} a")(lambda s, d: O.anchors(tags(s, d)).select("repo", "commit_hash", "tag_name", "kind"))
register("tag_anchor_order", f"SELECT repo, commit_hash, tag_name, CAST(row_number() OVER (PARTITION BY repo ORDER BY major, minor, patch, commit_date, commit_hash) - 1 AS INTEGER) AS idx FROM {DEDUP} a")(lambda s, d: O.ordered(O.anchors(tags(s, d))).select("repo", "commit_hash", "tag_name", "idx"))
register("adjacent_anchor_pairs", f"SELECT * FROM (SELECT repo, commit_hash, lead(commit_hash) OVER (PARTITION BY repo ORDER BY major, minor, patch, commit_date, commit_hash) AS next_hash FROM {DEDUP} a) n WHERE next_hash IS NOT NULL")(lambda s, d: O.neighbours(O.ordered(O.anchors(tags(s, d)))).select("repo", "commit_hash", "next_hash"))
register("numstat_totals", f"SELECT l_orderkey, CAST(SUM(CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) + CAST(deleted AS BIGINT) END) AS BIGINT) AS delta_lines, COUNT(*) AS delta_files FROM ({NUMSTAT}) n WHERE path IS NOT NULL GROUP BY l_orderkey")(lambda s, d: O.numstat(A.sql_over(s, d, NUMSTAT, "lineitem"), ["l_orderkey"]))
register("adjacent_pair_metrics", f"SELECT * FROM ({PAIRS}) p")(pairs)
RANKS = f"(SELECT *, cume_dist() OVER (PARTITION BY repo ORDER BY delta_lines) AS norm_lines, cume_dist() OVER (PARTITION BY repo ORDER BY delta_files) AS norm_files FROM ({PAIRS}) p)"
DIST = f"(SELECT *, 0.45e0 * norm_lines + 0.45e0 * norm_files + 0.1e0 * api_break AS distance FROM {RANKS} r)"
rounded = lambda df, *cols: df.select(*(c for c in df.columns if c not in cols), *(F.round(c, 9).alias(c) for c in cols))
register("percentile_rank", f"SELECT repo, idx, round(norm_lines, 9) AS norm_lines, round(norm_files, 9) AS norm_files FROM {RANKS} r")(lambda s, d: rounded(O.distances(pairs(s, d)).select("repo", "idx", "norm_lines", "norm_files"), "norm_lines", "norm_files"))
register("weighted_distance", f"SELECT repo, idx, round(distance, 9) AS distance FROM {DIST} r")(lambda s, d: rounded(O.distances(pairs(s, d)).select("repo", "idx", "distance"), "distance"))
register("distance_prefix_sum", f"SELECT repo, idx, round(COALESCE(SUM(distance) OVER (PARTITION BY repo ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM {DIST} r")(lambda s, d: O.running(O.distances(pairs(s, d))).select("repo", "idx", F.round("before", 6).alias("before")))


def selection_sql(n: int) -> str:
    """The best n anchors by n - 1 joins: each step keeps the best predecessor of every anchor."""
    out = f"WITH dist AS (SELECT repo, idx, distance FROM {DIST} r), place AS (SELECT repo, idx, SUM(distance) OVER (PARTITION BY repo ORDER BY idx) - distance AS at FROM dist UNION ALL SELECT repo, MAX(idx) + 1, SUM(distance) FROM dist GROUP BY repo), s1 AS (SELECT repo, idx, 0.0e0 AS best, [idx] AS way FROM place WHERE idx = 0)"
    for k in range(2, n + 1):
        out += f", s{k} AS (SELECT repo, idx, best, way FROM (SELECT p.repo, p.idx, s.best + ln(1 + p.at - q.at) AS best, list_append(s.way, p.idx) AS way, row_number() OVER (PARTITION BY p.repo, p.idx ORDER BY s.best + ln(1 + p.at - q.at) DESC, s.idx) AS rn FROM s{k - 1} s JOIN place q ON q.repo = s.repo AND q.idx = s.idx JOIN place p ON p.repo = s.repo AND p.idx > s.idx) x WHERE rn = 1)"
    return out + f", top AS (SELECT repo, way FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY best DESC, idx) AS rn FROM s{n}) x WHERE rn = 1) "


N = 6
register("dp_slice_selection", selection_sql(N) + "SELECT repo, CAST(unnest(range(len(way))) AS INTEGER) AS position, CAST(unnest(way) AS INTEGER) AS idx FROM top")(lambda s, d: O.selected(O.distances(pairs(s, d)), N))
CHOSEN = ", chosen AS (SELECT repo, CAST(unnest(range(len(way))) AS INTEGER) AS position, CAST(unnest(way) AS INTEGER) AS idx FROM top), spans AS (SELECT *, lag(idx) OVER (PARTITION BY repo ORDER BY position) AS prev_idx FROM chosen), seg AS (SELECT s.repo, s.position, s.idx, s.prev_idx, COALESCE(SUM(p.distance), 0) AS distance, CAST(COALESCE(SUM(p.delta_lines), 0) AS BIGINT) AS delta_lines, CAST(COALESCE(SUM(p.delta_files), 0) AS BIGINT) AS delta_files, COALESCE(MAX(p.api_break), 0) AS api_break, s.prev_idx IS NULL AS is_first FROM spans s LEFT JOIN " + DIST + " p ON p.repo = s.repo AND p.idx >= s.prev_idx AND p.idx < s.idx GROUP BY ALL) "


def cut(spark, sf_dir, weights=O.WEIGHTS):
    weighed = O.distances(pairs(spark, sf_dir), weights)
    return O.segments(O.selected(weighed, N), weighed)


register("segment_lookup", selection_sql(N).rstrip() + CHOSEN + "SELECT repo, position, idx, prev_idx, round(distance, 6) AS distance, delta_lines, delta_files, api_break, is_first FROM seg")(lambda s, d: cut(s, d).withColumn("distance", F.round("distance", 6)))
register("segment_cv", selection_sql(N).rstrip() + CHOSEN + "SELECT repo, round(CASE WHEN COUNT(*) < 2 OR AVG(distance) = 0 THEN 0 ELSE stddev_samp(distance) / AVG(distance) END, 6) AS cv FROM seg WHERE NOT is_first GROUP BY repo")(lambda s, d: O.variation(cut(s, d)).withColumn("cv", F.round("cv", 6)))
register("mean_index_shift", selection_sql(N) + "SELECT repo, round(list_avg(list_transform(range(1, len(way) + 1), lambda i: abs(way[i] - (i - 1) * 10))), 6) AS shift FROM top")(
    lambda s, d: O.mean_shift(*(lambda c: (c, c.withColumn("idx", F.col("position") * 10)))(O.selected(O.distances(pairs(s, d)), N))).withColumn("shift", F.round("shift", 6)))
register("weight_ablation")(lambda s, d: O.ablation(pairs(s, d), {"default": O.WEIGHTS, "lines": (1.0, 0.0, 0.0), "files": (0.0, 1.0, 0.0), "api": (0.3, 0.3, 0.4)}, N))
API = "SELECT c_custkey % 50 AS change, c_name AS symbol, CASE WHEN c_custkey % 97 = 0 THEN {0} ELSE c_mktsegment END AS signature FROM customer WHERE c_custkey % {1} > 0"
OLD, NEW = API.format("NULL", 211), API.format("'changed'", 401)
register("api_symbol_diff", f"SELECT change, MAX(CASE WHEN a.symbol IS NULL OR b.symbol IS NULL OR a.signature IS DISTINCT FROM b.signature THEN 1 ELSE 0 END) AS api_break FROM ({OLD}) a FULL OUTER JOIN ({NEW}) b USING (change, symbol) GROUP BY change")(lambda s, d: O.api_breaks(A.sql_over(s, d, OLD, "customer"), A.sql_over(s, d, NEW, "customer"), ["change"]))
register("slice_id_format", f"SELECT tag_ord, concat_ws('_', repo, substr(commit_hash, 1, 8), strftime(commit_date, '%Y%m%d')) AS slice_id FROM ({TAGS}) t")(lambda s, d: tags(s, d).select("tag_ord", T.snapshot_id(F.col("repo"), F.col("commit_hash"), F.col("commit_date")).alias("slice_id")))
register("temporal_consistency_check", f"SELECT repo, COUNT(*) = COUNT(DISTINCT commit_hash) AND bool_and(later) AS consistent FROM (SELECT *, COALESCE(commit_date >= lag(commit_date) OVER (PARTITION BY repo ORDER BY slice_idx), true) AS later FROM ({SLICES}) s) t GROUP BY repo")(lambda s, d: O.consistent(A.sql_over(s, d, SLICES, "customer")))
LANG = "CASE lower(regexp_extract(path, '\\.[^./]+$', 0)) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' END"
QUALITY = f"SELECT repo, slice_idx, COUNT(*) AS total_files, COUNT(*) FILTER (WHERE language IS NOT NULL) AS code_files, COUNT(*) FILTER (WHERE language IS NOT NULL AND parsed) AS parsed_files FROM (SELECT *, {LANG} AS language FROM ({FILES}) f) g GROUP BY repo, slice_idx"
RATE = "CASE WHEN code_files > 0 THEN parsed_files / code_files ELSE 0 END"


def checked(spark, sf_dir):
    return O.quality(files(spark, sf_dir).withColumn("language", language(F.col("path"))))


register("slice_quality", f"SELECT *, round({RATE}, 9) AS success_rate, concat_ws('|', CASE WHEN code_files < 1 THEN concat('Too few code files: ', code_files, ' < 1') END, CASE WHEN code_files > 0 AND {RATE} < 0.9 THEN format('Low symbol parsing success rate: {{:.2f}}% < 90.00%', 100 * {RATE}) END) AS issues, NOT (code_files < 1 OR (code_files > 0 AND {RATE} < 0.9)) AS valid FROM ({QUALITY}) q")(lambda s, d: checked(s, d).withColumn("issues", F.array_join("issues", "|")).withColumn("success_rate", F.round("success_rate", 9)))
register("validate_slices", f"SELECT COUNT(*) FILTER (WHERE ok) AS valid, COUNT(*) FILTER (WHERE NOT ok) AS invalid FROM (SELECT NOT (code_files < 1 OR (code_files > 0 AND {RATE} < 0.9)) AS ok FROM ({QUALITY}) q) v")(lambda s, d: checked(s, d).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")))
register("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda s, d: A.views(s, d, "documents")["documents"].select("doc_id", F.sha2(F.col("text"), 256).alias("hash")))
register("language_detect", f"SELECT path, {LANG} AS language FROM ({FILES}) f")(lambda s, d: files(s, d).select("path", language(F.col("path")).alias("language")))
