"""URL filter: rules by host and path, and an empirical-Bayes reputation of hosts.

Labelled pages count good and bad outcomes for each host. A beta-binomial prior shrinks a host's bad rate to that of
its registered domain, the domain's to that of its suffix and the suffix's to the overall rate. How strong each prior
is follows from the spread of the rates below it (method of moments), so nothing is set by hand but the quantile.
A host is blocked if the lower bound of its posterior bad rate lies above the limit.

Everything is Spark SQL: no Python runs on executors. Counts by host are written once and read by all levels; page rows
meet their host's verdict in an equi-join whose hot keys Spark's adaptive execution splits. Ports count for no level.

Cases: a null url, or one without "://", has an empty host and path, fits no rule and gets the verdict of the empty
host. Hosts without labelled pages take their domain's posterior, unknown domains their suffix's. Labels of pages that
are not there, null labels and null ids count nothing; an id labelled several times counts each label. No labels at
all: every bad rate is 0.5 with the widest bound, nothing is blocked. Repeated pages are judged each. Extra columns of
the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

#: The contract's rules, as (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked above this bad rate; Z is the one-sided 95 % normal quantile.
LIMIT, Z = 0.5, 1.6448536269514722
BACK = chr(92)
A_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), A_Z, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched_rule(rules, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: len(x[1])):
        own, _, rest = text.partition("/")
        fits = ((F.col(host) == own) | F.col(host).endswith("." + own)) & F.col(path).startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


#: Outcomes by host, from views page_host(page_id, host) and outcome(page_id, bad); and the posterior by host, from
#: host_sum. Spark and other engines share this SQL. {domain} and {suffix} are expressions over host.
HOST_SUM = """
  SELECT h.host, COUNT(o.bad) AS n, COALESCE(SUM(o.bad), 0) AS k
  FROM page_host h LEFT JOIN outcome o ON h.page_id = o.page_id GROUP BY h.host"""
POSTERIOR = """
host_level AS (SELECT host, n, k, {domain} AS domain, {suffix} AS suffix FROM host_sum),
domain_level AS (SELECT domain, MIN(suffix) AS suffix, SUM(n) AS n, SUM(k) AS k FROM host_level GROUP BY domain),
suffix_level AS (SELECT suffix, SUM(n) AS n, SUM(k) AS k FROM domain_level GROUP BY suffix),
overall AS (SELECT (COALESCE(SUM(k), 0) + 0.5e0) / (COALESCE(SUM(n), 0) + 1e0) AS p FROM suffix_level),
weight AS (
  SELECT level, CASE WHEN g < 2 OR total <= 0 OR spread <= 0 THEN 1000e0
                     ELSE LEAST(1000e0, GREATEST(1e0, p * (1 - p) / spread - 1)) END AS m
  FROM (SELECT level, g, total, p,
               CASE WHEN total - squares / total > 0
                    THEN (dev - (g - 1) * p * (1 - p)) / (total - squares / total) ELSE 0e0 END AS spread
        FROM (SELECT level, COUNT(*) AS g, CAST(SUM(n) AS DOUBLE) AS total, SUM(CAST(n AS DOUBLE) * n) AS squares,
                     MAX(p) AS p, SUM(n * (CAST(k AS DOUBLE) / n - p) * (CAST(k AS DOUBLE) / n - p)) AS dev
              FROM (SELECT level, n, k, (SELECT MAX(p) FROM overall) AS p
                    FROM (SELECT 'host' AS level, n, k FROM host_level UNION ALL SELECT 'domain', n, k FROM domain_level
                          UNION ALL SELECT 'suffix', n, k FROM suffix_level) u WHERE n > 0) x
              GROUP BY level) s) t),
suffix_post AS (
  SELECT suffix, (k + p * COALESCE((SELECT MAX(m) FROM weight WHERE level = 'suffix'), 1000e0))
                 / (n + COALESCE((SELECT MAX(m) FROM weight WHERE level = 'suffix'), 1000e0)) AS p
  FROM (SELECT suffix, n, k, (SELECT MAX(p) FROM overall) AS p FROM suffix_level) s),
domain_post AS (
  SELECT d.domain, (d.k + s.p * COALESCE((SELECT MAX(m) FROM weight WHERE level = 'domain'), 1000e0))
                   / (d.n + COALESCE((SELECT MAX(m) FROM weight WHERE level = 'domain'), 1000e0)) AS p
  FROM domain_level d JOIN suffix_post s ON d.suffix = s.suffix),
host_post AS (
  SELECT h.host, h.n, h.k + d.p * w AS a, (h.n - h.k) + (1 - d.p) * w AS b
  FROM (SELECT host, domain, n, k,
               COALESCE((SELECT MAX(m) FROM weight WHERE level = 'host'), 1000e0) AS w FROM host_level) h
  JOIN domain_post d ON h.domain = d.domain),
reputation AS (
  SELECT host, n, a / (a + b) AS bad_rate,
         a / (a + b) - {z} * SQRT(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM host_post)
"""
#: Second labels under which countries register names, as in co.uk, com.au or ac.jp (fixed values).
SECOND = ("ac", "co", "com", "edu", "go", "gov", "gob", "ne", "net", "nom", "or", "org", "sch")


def level(domain: bool, slash: str, end: str) -> str:
    """SQL for a host's registered domain or suffix, without its port. A suffix is the last label, or two of which the
    first is one of SECOND and the last has two letters; a domain is a suffix with the label before."""
    suffix = f"(({'|'.join(SECOND)}){slash}.[a-z][a-z]|[^.]*)"
    what = f"([^.]+{slash}.)?{suffix}" if domain else suffix
    return f"regexp_extract(regexp_replace(host, ':[0-9]*{end}', ''), '(^|{slash}.)({what}){end}', 2)"


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad_rate, lower_bound of every host of pages (page_id, host); outcomes: (page_id, bad 0/1)."""
    spark = pages.sparkSession
    body = POSTERIOR.format(domain=level(True, BACK + BACK, BACK + BACK + "z"), suffix=level(False, BACK + BACK, BACK + BACK + "z"), z=Z)
    sums = spark.sql(
        "WITH page_host AS (SELECT page_id, host FROM {pages}), "
        "outcome AS (SELECT page_id, CAST(bad AS BIGINT) AS bad FROM {outcomes} WHERE bad IS NOT NULL AND page_id IS NOT NULL) " + HOST_SUM,
        pages=pages.select("page_id", "host"), outcomes=outcomes.select("page_id", "bad"),
    )
    return spark.sql("WITH " + body.replace("FROM host_sum", "FROM {host_sum}") + " SELECT host, n, bad_rate, lower_bound FROM reputation", host_sum=written(sums, "hosts"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, lower_bound of each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(split, outcomes)
    rule, verdict = matched_rule(rules)
    own = F.when(F.col("lower_bound") > limit, "block").otherwise("allow")
    return split.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "lower_bound")


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages. The outcome of a page is the label of quality with its id: 0 is bad."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = lambda rule: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*rule.split("/", 1))
    longest = sorted(RULES, key=lambda x: -len(x[1]))
    body = f"host_sum AS ({HOST_SUM}), " + POSTERIOR.format(domain=level(True, BACK, "$"), suffix=level(False, BACK, "$"), z=Z)
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return (
        f"WITH cut AS (SELECT page_id, COALESCE({rest}, '') AS rest FROM pages), "
        f"split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{A_Z}', '{LOWER}') AS host, "
        "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut), page_host AS (SELECT page_id, host FROM split), "
        "outcome AS (SELECT doc_id AS page_id, CAST(1 - quality AS BIGINT) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL), "
        + body
        + " SELECT s.page_id, s.host, s.path, CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest).replace("host", "s.host").replace("path", "s.path")
        + " END AS rule, CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest).replace("host", "s.host").replace("path", "s.path")
        + f" WHEN r.lower_bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM split s JOIN reputation r ON s.host = r.host"
    )


ORACLE = _oracle()
