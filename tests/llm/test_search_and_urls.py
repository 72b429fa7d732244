from __future__ import annotations

import numpy as np
import pytest

from palimpsest.llm import one_bit_search as O
from palimpsest.llm import url_reputation as U


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16)).round(2)
    x[50:90] = x[49]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(400)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (1010, [1.0, 2.0], 1), (1020, [3.0, 4.0], 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int").repartition(5)
    got = {}
    for g in O.nearest(df, every=10).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    exact = x.astype(np.float32).astype(float)
    for q in range(0, 400, 10):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(k + 1, i) for k, i in enumerate(order)]
        assert [c for *_, c in sorted(got[q])] == pytest.approx([d[i] for i in order], rel=1e-12)
    assert [(a, b) for a, b, _ in got[1010]] == [(1, 1020)] and 1002 not in got


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [(g.query_id, g["rank"], g.vec_id, g.score) for g in O.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert O.nearest(df.limit(0)).collect() == []


def test_query_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(v) for v in r.normal(size=4)]) for i in range(60)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, O.nearest(df, every=4).collect()))
    monkeypatch.setattr(O, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, O.nearest(df, every=4).collect())) == whole


def test_urls(spark):
    urls = ["https://Blog.Example.org/es/x?y#z", "http://example.org/en/17", "http://a.org", "http://a.org/", "ftp://b.com/fr/", "http://b.com/de/#f", "no scheme", None, "http://notorg/es/", "://x.COM/fr/a", "http://h\nost.com/p", "http://spam.net/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(11, urls[11], "again")], "page_id long, url string, host string")
    bad = spark.createDataFrame([(11, 1)] * 200 + [(3, 0)] * 500 + [(4, 0), (5, None), (None, 1), (777, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, bad).collect()}
    assert got[0] == ("blog.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[2] == ("a.org", "", None, "allow") and got[3] == ("a.org", "/", "org/", "allow")
    assert got[4] == ("b.com", "/fr/", "com/fr/", "allow") and got[5] == ("b.com", "/de/", "com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("notorg", "/es/", None, "allow")
    assert got[9] == ("x.com", "/fr/a", "com/fr/", "allow") and got[10] == ("h\nost.com", "/p", None, "allow")
    assert got[11][3] == "block" and got[12][:2] == ("b:", "//c/d")
    assert U.filter_urls(pages.limit(0), bad).collect() == [] and {r.verdict for r in U.filter_urls(pages, bad.limit(0)).filter("rule IS NULL").collect()} == {"allow"}
