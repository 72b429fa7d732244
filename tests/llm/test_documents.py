from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_jaccard as J
from palimpsest.llm import pii_crf as P
from palimpsest.llm import quality_gam as G
from palimpsest.llm import risk_rules as R
from palimpsest.llm import source_mix as M
from palimpsest.llm import toxicity as X
from palimpsest.llm._boost import Additive, Isotonic, Trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op2 -------------------------------------------------------------------------------------------------------
def test_mix(docs, rows):
    got = M.mixed(M.sized(docs), block=8).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([sizes[s] for s in order], [1, 2, 3, 1][: len(order)])))
    taken = Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source]) and 0 <= g.taken <= 3 * g["size"]
        assert g.taken == g.passes * g["size"] + sum(x["to"] - x["from"] for x in g.extra)
        taken[g.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 24 for s in want)
    plan = {r[1]: r for r in M.source_plan([(s, sizes[s], 1) for s in sizes], block=8)}
    words = defaultdict(int)
    for g in got:
        assert sum(x["to"] - x["from"] for x in g.picks) == g.taken
        for x in g.picks:
            words[g.source, x["shard"]] += x["to"] - x["from"]
    for s, row in plan.items():  # each shard takes its quota of blocks; the source's last block may be short, once a pass
        quotas = np.diff([0, *row[-1]])
        short = [row[4] * int(q) - words[s, k] for k, q in enumerate(quotas)]
        assert min(short) >= 0 and sum(short) < row[4] * (row[6] + 1) and sum(x > 0 for x in short) <= row[6] + 1
    again = M.mixed(M.sized(docs.repartition(7)), block=8).select("doc_id", "size", "taken").collect()
    assert Counter((a.doc_id, a["size"], a.taken) for a in again) == Counter((g.doc_id, g["size"], g.taken) for g in got)


def test_mix_writes_what_it_takes(docs):
    own = docs
    mix = M.mixed(M.sized(own), block=8)
    words = M.materialised(mix, own.columns).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == mix.agg(F.sum("taken")).first()[0]


def test_mix_of_nothing(no_docs, spark):
    assert M.mixed(M.sized(no_docs)).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in M.mixed(M.sized(empty)).collect()] == [(0.0, 0), (0.0, 0)]


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 50, "big") for i in range(400)] + [(500 + i, "w " * n, f"s{n}") for i, n in enumerate((1, 2, 3, 5, 9, 20, 63, 64, 65, 300))]
    got = M.mixed(M.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= (1 if r.target < 32 * 64 else 128) for r in got)


def test_targets_and_seats():
    assert M.targets([10, 10, 1000], [1, 2, 3]) == [30.0, 30.0, 960.0]
    w = np.array([5.3, 2.1, 0.0, 9.9, 9.9])
    most = np.array([100, 3, 5, 100, 100])
    slow = np.zeros(5, int)
    for n in range(60):
        assert M.seats(w, n, most).tolist() == slow.tolist()
        slow[int(np.argmax(np.where((slow < most) & (w > 0), w / (2 * slow + 1), -1)))] += 1
    q = M.shard_quotas(w, 57, most, 9)
    assert (q >= 0).all() and q.sum(0).tolist() == M.seats(w, 57, most).tolist() and set(q.sum(1)) <= {6, 7}


# --- op4 -------------------------------------------------------------------------------------------------------
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text: str) -> list:
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and P.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    import random

    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice("0123456789.-+@ ()ab_") for _ in range(r.randint(0, 200)))
        assert P.base_spans(text) == plain_spans(text)
    assert P.base_spans("9" * 100_000 + "@" * 1000) == []


def test_field_finds_more_and_leaves_clean_text_alone():
    own = P.field()
    texts = ["call (771) 555-1655 now", "mail bob(at)host.com .", "on 2020-01-02 order 1234567890 cost 12.50", "", "version 3.4.5 of 1,000 rows in 1999"]
    got = [P.written_out(s) for _, s in P.spans_of(texts, own)]
    assert got == ["phone:5:19", "email:5:20", "", "", ""]
    words = hit = 0
    for sentence, labels in P.labelled_table(3, seed=77):
        for before, run, after, starts in P.runs_of(" ".join(sentence)):
            at = len(" ".join(sentence)[: starts[0]].split())
            found = own.decode([(before, run, after)])[0]
            words += len(run)
            hit += sum(P.LABELS[y] == labels[at + k] for k, y in enumerate(found))
    assert hit / words > 0.97


def test_viterbi_is_best():
    own, runs = P.field(), [("call", ["555-123-4567", "12", "a@b.c"], "x"), ("", ["1.2.3.4"], "")]
    for run, found in zip(runs, own.decode(runs)):
        e = np.array([own.weights[[own.index.get(f, own.empty) for f in fs]].sum(0) for fs in own.features(run)])
        trans, best = own.step + own.barred, (-np.inf, None)
        for path in np.ndindex(*[len(P.LABELS)] * len(e)):
            s = own.start[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            best = max(best, (s, path))
        assert best[1] == tuple(found)


def test_found_and_redacted(docs, no_docs, rows):
    got = P.found(docs).collect()
    assert len(got) == len(rows) and P.found(no_docs).collect() == []
    assert [len(r.base) for r in got if r.doc_id == 0] == [0]
    out = P.redacted(docs.withColumn("text", F.when(F.col("doc_id") == 3, "to a.b@c.de or +1 (659) 555-3949.").otherwise(F.col("text"))))
    assert out.columns == docs.columns and out.filter("doc_id = 3").first().text == "to <EMAIL> or <PHONE>." and out.filter("doc_id = 0").first().text is None


# --- op5 -------------------------------------------------------------------------------------------------------
def slow_components(rows, width, percent):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [a if x == b else x for x in of]
    least = {}
    for k, r in zip(of, rows):
        least[k] = min([x for x in (least.get(k), r[0]) if x is not None], default=None)
    return Counter((r[0], len(s), least[k] if s else r[0]) for r, s, k in zip(rows, sets, of))


@pytest.mark.parametrize(("width", "percent", "small", "rounds"), [(4, 85, 50_000, (1, 16)), (5, 80, 50_000, ()), (2, 60, 0, (1,)), (1, 50, 50_000, (1,)), (3, 100, 50_000, ())])
def test_components(docs, rows, monkeypatch, width, percent, small, rounds):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "PIVOT_GROUPS", rounds)
    got = J.joined(docs, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_components(rows, width, percent)


def test_both_branches_link(spark, monkeypatch):
    """Short texts meet in subsets, long ones in lists; the cost finds the boundary between them."""
    import random

    r, rows, seen = random.Random(4), [], {}
    for g in range(60):
        base = [f"w{g}_{i}" for i in range(r.randint(4, 14) if g % 2 else r.randint(40, 90))]
        for _ in range(5):
            own = list(base)
            if r.random() < 0.7:
                own[-1] = "x" + str(r.randint(0, 2))
            if r.random() < 0.3:
                own.append("tail")
            rows.append((len(rows), " ".join(own)))
    for name in ("light_links", "compared", "boundary"):
        def own(*args, f=getattr(J, name), name=name):
            found = f(*args)
            seen[name] = seen.get(name, 0) + (found if name == "boundary" else found.count())
            return found

        monkeypatch.setattr(J, name, own)
    got = J.joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == slow_components(rows, 2, 80)
    assert 5 <= seen["boundary"] < J.LARGEST_LIGHT and seen["light_links"] > 10 and seen["compared"] > 10


def test_a_crowd_costs_few_comparisons(spark, monkeypatch):
    """A chain of drifting copies whose ends aren't linked themselves, and 2000 near copies of one text."""
    rows, own = [], [f"c{i}" for i in range(120)]
    for k in range(40):
        own = [*own[:k], f"n{k}", *own[k + 1 :]]
        rows.append((k, " ".join(own)))
    base, tried = [f"b{i}" for i in range(90)], []
    rows += [(100 + k, " ".join([*base[: k % 90], f"q{k}", *base[k % 90 + 1 :]])) for k in range(2000)]
    compared = J.compared
    monkeypatch.setattr(J, "compared", lambda pairs, *rest: tried.append(pairs.count()) or compared(pairs, *rest))
    got = J.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {x.component_id for x in got if x.doc_id >= 100} == {100} and {x.component_id for x in got if x.doc_id < 100} == {0}
    assert sum(tried) < 10 * len(rows)


def test_classes_that_share_a_name(docs, rows, monkeypatch):
    """Digests whose first half says next to nothing: the other half tells classes apart."""
    whole = J.digest
    monkeypatch.setattr(J, "digest", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    got = J.joined(docs, 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_components(rows, 4, 85)


def test_shingles_of_words_that_hashes_confuse(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = J.joined(spark.createDataFrame([(1, f"x y z {word}"), (2, f"x y z {other}"), (3, f"X y z {word}")], "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_linked_sets_share_enough_cells():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 1 << 63, int(r.integers(0, n // 12 + 1)), np.uint64)]))
        for p in (60, 80, 85):
            if len(b) and 100 * len(np.intersect1d(a, b)) >= p * len(np.union1d(a, b)):
                x, y = J.cells(a, p), J.cells(b, p)
                met = np.intersect1d(np.concatenate([k for _, k in x]), np.concatenate([k for _, k in y]))
                assert all(any(np.isin(k, met).sum() >= need for need, k in own) for own in (x, y))


def test_parity_never_rules_out_links():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, int(r.integers(0, 40)), np.uint64)]))
        if len(b):
            assert np.bitwise_count((J.parity(a) ^ J.parity(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_columns_keep_their_names(docs):
    own = docs.withColumn("own_id", F.lit(7)).withColumn("own_hash", F.lit("h")).withColumn("stay_id", F.lit(None)).withColumn("component", F.lit(1.5)).withColumn("cells", F.lit("c"))
    got = J.deduplicated(own, 5, 80)
    assert got.columns == own.columns and got.select("own_id", "own_hash", "component", "cells").distinct().collect() == [(7, "h", 1.5, "c")]


def test_one_of_each_group_stays(docs, no_docs, rows):
    got = J.deduplicated(docs, 5, 80)
    groups = slow_components(rows, 5, 80)
    with_words = {c for (_, n, c), _ in groups.items() if n}
    assert got.columns == docs.columns and got.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == len(with_words)
    assert got.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count() == sum(not WORD.search(r[1] or "") for r in rows)
    assert J.joined(no_docs, 4, 85).collect() == [] and J.deduplicated(no_docs, 5, 80).collect() == []


# --- op6, op8, op9 ---------------------------------------------------------------------------------------------
def test_counts_of_rules(docs, no_docs, rows):
    want = {}
    for r in rows:
        x = r[1] or ""
        w, seen, dup = WORD.findall(x), set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r[0], x] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover))
    got = R.signals(docs).collect()
    assert Counter((g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == Counter(want[r[0], r[1] or ""] for r in rows)
    assert R.signals(no_docs).collect() == []


def test_exact_bounds():
    assert R.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-6)
    assert R.upper_bound(5, 5, 0.05) == 1.0 and R.upper_bound(0, 0, 0.05) == 1.0
    assert R.binomial_tail(3, 10, 0.5) == pytest.approx(176 / 1024)


def test_thresholds_hold_their_promise(spark):
    r = np.random.default_rng(1)
    rows = [(i, ("en", None)[i % 2], i, 100, 500, 0, 0, 0, float(r.beta(1, 30)), 0.0, 0.0, 0.0, 0.0) for i in range(6000)]
    found = spark.createDataFrame(rows, R.FOUND)
    good = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    cut = R.thresholds(found, good)
    assert ("en", "symbol_rate") in cut and (None, "symbol_rate") in cut
    lost = R.judged(found, cut).filter("NOT kept").count()
    assert 0 <= lost <= 6000 * R.ALPHA
    alike = found.withColumn("text_hash", F.lit(7))  # copies are one trial, whatever their number
    assert R.thresholds(alike, good) == {} and R.thresholds(found, good.union(good)) == cut
    assert R.thresholds(found, good.limit(0)) == {} and R.thresholds(found.limit(0), good) == {}


def test_learners():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.5) | (x[:, 1] * x[:, 2] > 1)).astype(float)
    w = np.ones(len(y))
    for score in (Trees().fit(x[:2000], y[:2000], w[:2000]).margin, Additive().fit(x[:2000], y[:2000], w[:2000]).score):
        s = score(x[2000:])
        good = s > (0.5 if s.min() >= 0 else 0)
        assert (good == y[2000:]).mean() > 0.85
    curve = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(curve.rates(np.array([0.0, 1, 2, 3, 4, 9]))) >= 0).all()


@pytest.mark.parametrize(("fit", "score", "name"), [(G.fitted, G.scored, "score"), (X.fitted, X.without_text, "toxicity")])
def test_classifiers_take_anything(docs, no_docs, labels, rows, fit, score, name):
    for own in (labels, labels.limit(0)):
        model = fit(docs, own)
        got = score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= g[name] <= 1 for g in got)
    assert score(no_docs, fit(no_docs, labels)).collect() == []


def test_held_out_labels_are_not_learnt(docs, labels):
    from palimpsest.llm._shared import held_out

    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    for fit, score in ((G.fitted, G.scored), (X.fitted, X.without_text)):
        assert sorted(map(str, score(docs, fit(docs, labels)).collect())) == sorted(map(str, score(docs, fit(docs, flipped)).collect()))


@pytest.mark.parametrize(("query", "column", "cut"), [("op6_quality_gam", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, query, column, cut):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.1"
    got = entry.queries()[query](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[column] for r in got]) >= cut


def test_toxic_words_in_disguise():
    own = X.Features({"idiot ": 4.0})
    plain, hidden, clean = own.rows([b"you idiot !", b"you 1d1ot !", b"you are fine"])
    at = {n: k for k, n in enumerate(X.FEATURES)}
    assert plain[at["hits"]] == hidden[at["hits"]] == 1 and clean[at["hits"]] == 0 and hidden[at["hidden"]] == 1 and plain[at["near_second"]] == 1
