"""Number-rich texts, long words, many blocks of queries, suffixes of two labels, and folders on clusters."""

from __future__ import annotations

import time

import numpy as np
import pytest

from palimpsest.llm import _shared, one_bit_search, pii_crf, url_reputation


def test_scores_of_words_are_sums_of_features():
    own = pii_crf.field()
    words = ["(771)", "555-1655", "a@b.c", "1" * 100, "x" * 70 + "9", "", "call", "10.0.0.1"]
    for k in range(1, len(words) - 1):
        run = words[k - 1], [words[k]], words[k + 1]
        x = own.scores([run[0], *run[1], run[2]])
        want = own.weights[[own.index.get(f, own.empty) for f in own.features(run)[0]]].sum(0)
        assert np.allclose(x[1, 0] + x[0, 1] + x[2, 2], want)


def test_many_numbers_cost_little():
    r = np.random.default_rng(0)
    texts = [" ".join(map(str, r.integers(0, 10**6, 6000))) for _ in range(20)]
    own = pii_crf.field()
    began = time.process_time()
    pii_crf.spans_of(texts, own)
    assert (time.process_time() - began) / (20 * 6000) < 40e-6


def test_the_word_before_is_whole():
    long = "y" * 1000
    assert [r[0] for r in pii_crf.runs_of(f"call {long}   12 and z 34 b")] == [long, "z"]
    assert [(r[0], r[2]) for r in pii_crf.runs_of(f"12 {long}")] == [("", long)]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(one_bit_search, "QUERY_BLOCK", 7)
    r = np.random.default_rng(1)
    vectors = r.normal(size=(200, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = one_bit_search.nearest(rows, every=4, k=3).collect()
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    assert {(g.query_id, g.rank): g.vec_id for g in got} == {(q, k + 1): int(np.argsort(far[q])[k]) for q in range(0, 200, 4) for k in range(3)}


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk:8080", "b.co.uk", "co.uk"), ("xco.uk", "xco.uk", "uk"), ("www.a.com", "a.com", "com"), ("a.com:80", "a.com", "com"), ("localhost", "localhost", "localhost"), ("", "", ""), ("co.uk", "co.uk", "co.uk")])
def test_registered_domains(spark, host, domain, suffix):
    import duckdb

    b = url_reputation.BACK
    own = [url_reputation.level(x, b + b, b + b + "z") for x in (True, False)]
    assert tuple(spark.sql(f"SELECT {own[0]}, {own[1]} FROM VALUES ('{host}') AS t(host)").first()) == (domain, suffix)
    other = [url_reputation.level(x, b, "$") for x in (True, False)]
    assert duckdb.sql(f"SELECT {other[0]}, {other[1]} FROM (SELECT '{host}' AS host)").fetchall()[0] == (domain, suffix)


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        _shared.shared_dir(Session())
