"""op8 filters languages with few labels too."""

from __future__ import annotations

from palimpsest.llm import risk_rules as R


def test_small_strata_get_the_pooled_cutoff(spark):
    sizes = {"en": 2013, "fr": 490, "de": 488, "es": 311}
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    row = lambda i, lang, x: (i, lang, i, 100, 500, 0, 0, 0, x, 0.0, 0.0, 0.0, 0.0)
    good = [row(i, lang, 0.01 * (i % 5)) for i, lang in enumerate(langs)]
    bad = [row(10_000 + i, lang, 0.9) for i, lang in enumerate([*sizes, None, "xx"])]
    found = spark.createDataFrame([*good, *bad], R.FOUND)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    cut = R.thresholds(found, labels)
    assert cut["en", "symbol_rate"] == cut[R.POOLED, "symbol_rate"] == 0.05 and ("fr", "symbol_rate") not in cut
    got = {r.doc_id: (r.kept, r.rule) for r in R.judged(found, cut).collect()}
    assert all(got[i] == (True, None) for i in range(len(good)))
    assert all(got[r[0]] == (False, "symbol_rate") for r in bad)


def test_a_stratum_of_its_own_never_takes_the_pooled_cutoff(spark):
    rows = [(i, "en" if i < 2000 else "de", i, 100, 500, 0, 0, 0, 0.5 if i < 20 else 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(20_000)]
    found = spark.createDataFrame(rows, R.FOUND)
    cut = R.thresholds(found, spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality"))
    assert cut[R.POOLED, "symbol_rate"] < 0.5 <= cut["en", "symbol_rate"]
    assert R.judged(found, cut).filter("NOT kept").count() == 0


def test_enough_labels():
    assert R.own_strata({"en": 1321, "de": 5}) == ([], R.DELTA / 5) and R.own_strata({"en": 1323, "de": 5})[0] == ["en"]
    assert R.own_strata({}) == ([], R.DELTA / 5)
