from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import answers as V
from palimpsest.functions import docs as D
from palimpsest.functions import symbols as S
from palimpsest.functions import tags as T
from palimpsest.operators import context as C
from palimpsest.operators import evaluation as E
from palimpsest.operators import extrinsic as X
from palimpsest.operators import intrinsic as I
from palimpsest.operators import sampling as M
from palimpsest.operators import scoring as R
from palimpsest.operators import slicing as L
from palimpsest.operators import snapshots as N


def one(spark, column, **values):
    """The value of an expression over one row."""
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


# --- tags and segments -----------------------------------------------------------------------------------------
@pytest.mark.parametrize(("tag", "version"), [("v1.2.3", (1, 2, 3)), ("release-1.2", (1, 2, 0)), ("1.2-release", (1, 2, 0)), ("V2", (2, 0, 0)), ("Release_3.1", (3, 1, 0)), ("v1.2.3rc1", None), ("1.2.3.4", None), ("nightly", None)])
def test_release_tags(spark, tag, version):
    got = one(spark, T.release_version(F.lit(tag)))
    assert (tuple(got) if got else None) == version


def test_distances(spark):
    rows = [("r", i, line, f, a) for i, (line, f, a) in enumerate(zip([100, 10, 100, 50], [3, 1, 9, 2], [0, 0, 1, 0]))]
    got = L.distances(spark.createDataFrame(rows, "repo string, idx int, delta_lines long, delta_files long, api_break int")).orderBy("idx").collect()
    assert [r.norm_lines for r in got] == [1, 0.25, 1, 0.5] and [r.norm_files for r in got] == [0.75, 0.25, 1, 0.5]
    assert [r.distance for r in got] == pytest.approx([0.7875, 0.225, 1.0, 0.45])


@given(st.lists(st.floats(0, 3), min_size=1, max_size=8), st.integers(0, 9), st.sampled_from(["log1p", "sqrt"]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_best_segments(distance, n, gain, first):
    g = math.sqrt if gain == "sqrt" else math.log1p
    m, got = len(distance) + 1, L.best_segments(np.array(distance), n, gain, first)
    at = [0.0, *itertools.accumulate(distance)]
    worth = lambda way: sum(g(max(at[b] - at[a], 0)) for a, b in zip(way, way[1:]))
    if n >= m:
        assert got == list(range(m))
    elif n <= 0:
        assert got == []
    elif n == 1:
        assert got == ([0] if first else [m - 1])
    else:
        ways = [w for w in itertools.combinations(range(m), n) if not first or w[0] == 0]
        assert len(got) == n and worth(got) == pytest.approx(max(map(worth, ways)))


def test_segment_fixture():
    assert L.best_segments(np.array([0.2, 0.9, 0.1, 0.5]), 3) == [0, 2, 4] == L.best_segments(np.array([0.2, 0.9, 0.1, 0.5]), 3, "sqrt")


def test_variation_and_shift(spark):
    seg = spark.createDataFrame([("a", 0, True, 0.0), ("a", 1, False, 1.0), ("a", 2, False, 3.0), ("b", 0, True, 0.0), ("b", 1, False, 2.0)], "repo string, position int, is_first boolean, distance double")
    assert {r.repo: round(r.cv, 6) for r in L.variation(seg).collect()} == {"a": 0.707107, "b": 0.0}
    idx = lambda *v: spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "repo string, position int, idx int")
    assert L.mean_shift(idx(0, 4, 9), idx(0, 5, 7)).first().shift == 1.0 and L.mean_shift(idx(0, 4), idx(0, 5, 7)).first().shift == 0.0


def test_numstat(spark):
    df = spark.createDataFrame([("x", "3", "2", "a.py"), ("x", "-", "-", "b.png"), ("x", "1", None, None)], "k string, added string, deleted string, path string")
    r = L.numstat(df, ["k"]).first()
    assert (r.delta_lines, r.delta_files) == (5, 2)


# --- symbols ---------------------------------------------------------------------------------------------------
def test_paths_and_visibility(spark):
    for path, test in [("src/test/java/A.java", True), ("a/tests/x.py", True), ("FooTest.java", True), ("latest/x.py", False), (None, False)]:
        assert one(spark, S.is_test_path(F.lit(path).cast("string"))) == test
    assert one(spark, S.walked(F.lit("latest/x.py"))) is False and one(spark, S.walked(F.lit("src/.x/a.py"))) is False and one(spark, S.walked(F.lit("src/a.py"))) is True
    null = F.lit(None).cast("string")
    assert one(spark, S.public_class(null)) and not one(spark, S.public_function(F.lit("package"), F.lit("f"))) and not one(spark, S.public_function(null, F.lit("_f"))) and one(spark, S.public_function(F.lit("PUBLIC"), F.lit("_f")))
    assert one(spark, S.public_api(F.lit("java"), F.lit(True), F.lit("private"), null, F.lit("K"))) and not one(spark, S.public_api(F.lit("python"), F.lit(False), null, F.lit("_K"), F.lit("f")))


def test_texts_of_symbols(spark):
    p = F.array(F.struct(F.lit("x").alias("name"), F.lit("int").alias("type_annotation"), F.lit(None).cast("string").alias("default_value")), F.struct(F.lit("y").alias("name"), F.lit(None).cast("string").alias("type_annotation"), F.lit("None").alias("default_value")))
    assert one(spark, S.format_params(p)) == "(x: int, y = None)" and one(spark, S.format_params(F.slice(p, 1, 0))) == "()"
    assert one(spark, S.complete_signature(F.lit("public void f(int a)"), F.lit("(a: int)"), F.lit("void"))) == "public void f(a: int) -> void:"
    assert one(spark, S.complete_signature(F.lit("def f(x): "), F.lit("()"), F.lit(None).cast("string"))) == "def f(x): "
    for xs in (["A", "B"], ["it's"], ['q"', "'"], ["a\\b"], []):
        assert one(spark, S.list_text(F.array(*map(F.lit, xs)).cast("array<string>"))) == str(xs)


def test_identifier(spark):
    got = one(spark, S.evidence_text(F.lit("function"), F.lit("Foo.bar"), F.lit("src/foo.py")))
    assert got == '{"file_path": "src/foo.py", "kind": "function", "name": "Foo.bar"}'
    parts = ["demo", "temporal", "function_introduced", "Was function/method Foo.bar introduced between v1.0 and v1.1?", "Yes", None, "demo_aaaaaaaa_20200101", "demo_bbbbbbbb_20200601", got]
    assert one(spark, S.stable_id(*(F.lit(x).cast("string") for x in parts))) == "5dd2d0d577b22476"
    import json

    for text in ('a"b\\c\n\t\x01é\x7f', ""):
        assert one(spark, S.json_text(F.lit(text))) == json.dumps(text, ensure_ascii=False)


# --- snapshots -------------------------------------------------------------------------------------------------
def snapshot(spark, rows):
    df = spark.createDataFrame(rows, "repo string, slice_idx int, ord long, key string, signature string, return_type string, calls array<string>")
    return df.withColumn("ref", F.col("key")).withColumn("file_path", F.lit("f.py")).withColumn("params", F.lit("()")).withColumn("instantiations", F.col("calls"))


def test_adjacent_differences(spark):
    rows = [("r", 0, i, k, "s0", "int", ["f", "g"]) for i, k in enumerate("abc")] + [("r", 1, 0, "b", "s1", "int", []), ("r", 1, 1, "b", "s2", "int", ["g", "h", "e"]), ("r", 1, 2, "c", "s0", "str", ["f", "g"]), ("r", 1, 3, "d", "s", "", None), ("r", 2, 0, "a", "x", "int", None)]
    slices = spark.createDataFrame([("r", i, f"id{i}", f"v{i}" if i else "") for i in range(3)], "repo string, slice_idx int, slice_id string, version_tag string")
    moves = N.transitions(snapshot(spark, rows), slices)
    got = {(r.from_idx, r.key): (r.status, r.prev_v, r.curr_v) for r in moves.collect()}
    assert got == {(0, "a"): ("removed", "id0", "v1"), (0, "b"): ("stable", "id0", "v1"), (0, "c"): ("stable", "id0", "v1"), (0, "d"): ("added", "id0", "v1"), (1, "a"): ("added", "v1", "v2"), (1, "b"): ("removed", "v1", "v2"), (1, "c"): ("removed", "v1", "v2"), (1, "d"): ("removed", "v1", "v2")}
    answers = lambda s: {r.evidence.name: r.answer for r in N.change_questions(moves, "function", s).collect()}
    assert answers("function_signature_changed") == {"b": "from: s0 ; to: s2"} and answers("function_calls_changed") == {"b": "added: e, h; removed: f"}
    assert answers("function_return_type_changed") == {"c": "from: int ; to: str"} and answers("function_return_type_unchanged") == {"b": "No"}
    first = {r.evidence.name: r.answer for r in N.presence_questions(snapshot(spark, rows), slices, "function", "first_introduced").collect()}
    last = {r.evidence.name: r.answer for r in N.presence_questions(snapshot(spark, rows), slices, "function", "last_present").collect()}
    assert first == {"d": "v1"} and last == {"b": "v1", "c": "v1", "d": "v1"}
    runs = {r.evidence.name: r.answer for r in N.trajectory_questions(snapshot(spark, rows), slices, "function", "signature_evolution", F.col("signature")).collect()}
    assert runs == {"a": "id0: s0 -> v2: x", "b": "id0: s0 -> v1: s1"}


@given(st.integers(1, 400), st.sampled_from([10, 20]))
@settings(max_examples=15, deadline=None)
def test_stride(spark, n, most):
    rows = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("k"))
    want = list(range(n)) if n <= most else [int(i * (n / most)) for i in range(most)]
    assert sorted(r.k for r in N.stride(rows, ["repo"], "k", most).collect()) == want


def test_absent_references(spark):
    rows = [("r", 0, f"f{i:02}") for i in range(35)] + [("r", 1, f"g{i}") for i in range(9)] + [("r", 1, "f00")]
    got = Counter((r.slice_idx, r.ref) for r in I.absent(spark.createDataFrame(rows, "repo string, slice_idx int, ref string")).collect())
    assert got == Counter([(0, "g0"), (0, "g1"), (0, "g2"), (1, "f01")])


# --- sampling --------------------------------------------------------------------------------------------------
def allocate(spark, rows, budget):
    df = spark.createDataFrame([("r", "t", *r) for r in rows], "repo string, qa_type string, qa_subtype string, weight double, n long")
    return {r.qa_subtype: r.alloc for r in M.allocation(df, ["repo", "qa_type"], F.lit(budget)).collect()}


def slow_allocation(rows, budget):
    total = sum(w * min(n, 2000) for _, w, n in rows)
    rows = sorted(rows)
    out = {s: min(round(budget * w * min(n, 2000) / total), n) for s, w, n in rows}
    weight, size = {s: w for s, w, _ in rows}, {s: n for s, _, n in rows}
    target = min(budget, sum(size.values()))
    while sum(out.values()) != target:
        up = sum(out.values()) < target
        can = [s for s in sorted(out) if (out[s] < size[s] if up else out[s] > 0)]
        out[max(can, key=lambda s: weight[s])] += 1 if up else -1
    return out


def test_allocation_fixtures(spark):
    assert allocate(spark, [("a", 5.0, 10), ("b", 1.0, 100)], 20) == {"a": 7, "b": 13}
    assert allocate(spark, [("a", 5.0, 3), ("b", 1.0, 10)], 10) == {"a": 3, "b": 7}
    assert allocate(spark, [("a", 1.0, 10), ("b", 1.0, 10)], 5) == {"a": 3, "b": 2}


@given(st.lists(st.tuples(st.sampled_from([0.2, 0.5, 1.0, 5.0]), st.integers(1, 60)), min_size=1, max_size=6), st.integers(1, 200))
@settings(max_examples=15, deadline=None)
def test_allocation(spark, parts, budget):
    rows = [(f"s{k}", w, n) for k, (w, n) in enumerate(parts)]
    assert allocate(spark, rows, budget) == slow_allocation(rows, budget)


def test_type_budgets(spark):
    many = spark.createDataFrame([("r", t, 10_000) for t in M.TYPE_SHARES], "repo string, qa_type string, n long")
    assert {r.qa_type: r.budget for r in M.type_budgets(many, 500).collect()} == {"intrinsic": 240, "extrinsic": 50, "temporal": 210}
    few = spark.createDataFrame([("r", "extrinsic", 3), ("r", "temporal", 20), ("r", "intrinsic", 1000)], "repo string, qa_type string, n long")
    assert {r.qa_type: r.budget for r in M.type_budgets(few, 100).collect()} == {"extrinsic": 3, "temporal": 20, "intrinsic": 77}


# --- answers ---------------------------------------------------------------------------------------------------
def test_scores(spark):
    lit = lambda a, b: (F.lit(a), F.lit(b))
    assert one(spark, V.exact_match(*lit("The Foo.", "foo"))) == 1.0
    assert one(spark, V.token_f1(*lit("foo bar bar", "bar foo"))) == pytest.approx(0.8) and one(spark, V.token_f1(*lit("", ""))) == 1.0 and one(spark, V.token_f1(*lit("x", ""))) == 0.0
    df = spark.createDataFrame([("x y z w", "y x z"), ("", ""), ("a b", "c")], "p string, g string")
    assert [round(r.v, 6) for r in df.select(V.rouge_l(F.col("p"), F.col("g")).alias("v")).collect()] == [0.571429, 0.0, 0.0]
    assert one(spark, V.yesno_match(*lit("Yes, it does.", "Yes"))) == 1.0 and one(spark, V.yesno_match(*lit("", "No"))) == 0.0
    assert one(spark, V.plain_version(F.lit("v2.2.15: int"))) == "2.2.15: int" and one(spark, V.plain_change(F.lit("Added: release; removed: None"))) == "added: release"
    assert one(spark, V.item_list(F.lit("`self.x`, this.y; self.x"))) == "self.x, y" and one(spark, V.caller_list(F.lit("new Foo(1).bar(), Baz.qux(a), qux"))) == "bar, qux"
    assert one(spark, V.without_fence(F.lit("```py\nx = 1\n```"))) == "x = 1" and one(spark, V.without_fence(F.lit("`foo`"))) == "foo" and one(spark, V.without_fence(F.lit("```from```"))) == "```from```"
    assert one(spark, V.without_markers(F.lit("yes <|im_end|> more\nlines"))) == "yes"


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert V.common_subsequence(x, y) == table[-1][-1]


def test_means_and_summary(spark):
    df = spark.createDataFrame([("intrinsic", "a", {"em": 1.0}, "p", True), ("intrinsic", "a", {"em": 0.0}, "p", True), ("intrinsic", "a", {}, None, False)], "qa_type string, qa_subtype string, metrics map<string,double>, prediction string, context_retrieved boolean")
    assert R.means(df).first()["mean"] == 0.5
    lines = R.summary_lines(df, "r", "t", "m", "slice_context")
    assert lines[3:6] == ["  Total evaluated : 3", "  No prediction   : 1", "  Context missing: 1"] and lines[-1] == "    intrinsic/a: em=0.5000"
    assert R.safe_name("org/model x") == "org__model__x" and R.safe_name("///") == "unknown_model"


# --- context, documentation, evaluation ------------------------------------------------------------------------
def test_around(spark):
    long = "x" * 20_000
    assert one(spark, C.around(F.lit(long), F.lit("A.b"))) == long[:16_000] + "\n# [truncated]" and one(spark, C.around(F.lit("short"), F.lit("A.b"))) == "short"
    text = "y" * 12_000 + "def b(" + "z" * 12_000
    got = one(spark, C.around(F.lit(text), F.lit("A.b")))
    assert got == "# [...leading content omitted...]\n" + text[8000:24_000] + "\n# [truncated]"


def test_nearby_snapshots(spark):
    files = spark.createDataFrame([("r", 8, "a", "t8"), ("r", 2, "a", "t2"), ("r", 3, "a", "t3")], "repo string, slice_idx int, file_path string, content string")
    q = spark.createDataFrame([(1, "r", "a", 1, 4), (2, "r", "a", 4, 9), (3, "r", "b", 0, 9)], "q int, repo string, file_path string, from_idx int, to_idx int")
    at = lambda df: {r.q: r.found_idx for r in df.collect()}
    assert at(C.boundary(q, files, ["q"], True)) == {1: 2, 2: 8, 3: None} and at(C.boundary(q, files, ["q"], False)) == {1: 3, 2: 8, 3: None}
    only = files.filter("slice_idx = 8")
    far = spark.createDataFrame([(1, "r", "a", 0), (2, "r", "a", 1)], "q int, repo string, file_path string, from_idx int")
    assert at(C.fallback(far, only, ["q"], "from_idx", True)) == {1: None, 2: 8}


def test_related_texts(spark):
    symbols = spark.createDataFrame([("r", 0, i, f"p{i}.py", ["K"]) for i in range(9)], "repo string, slice_idx int, ord int, file_path string, bases array<string>")
    q = spark.createDataFrame([(1, "r", 0, "K", "own.py")], "q int, repo string, slice_idx int, name string, file_path string")
    files = spark.createDataFrame([("r", 0, f"p{i}.py", "x" * 5000) for i in range(9)], "repo string, slice_idx int, file_path string, content string")
    got = C.related_texts(C.related_paths(q, symbols, "bases", ["q"]), files, ["q"]).first()
    assert got.n_related == 9 and [x.file_path for x in got.related_contents] == [f"p{i}.py" for i in range(6)] and {len(x.content) for x in got.related_contents} == {2000}


def test_documentation(spark):
    assert one(spark, D.clean(F.lit('"""Says hi.\n\nMore."""'))) == "Says hi." and one(spark, D.clean(F.lit("see <b>"))) == "" and one(spark, D.clean(F.lit("{a}{b}{c}"))) == ""
    assert one(spark, D.javadoc(F.lit("/** One\n * two\n */"))) == "One\ntwo" and one(spark, D.quoted(F.lit("'''x'''"))) == "x"
    assert tuple(one(spark, D.java_import(F.lit("import static a.b.C;")))) == ("a.b", ["C"], False) and tuple(one(spark, D.java_import(F.lit("import a.*;")))) == ("a", [], True)
    rows = spark.createDataFrame([("r", "s", "K.f", "a.py", "Returns the value of it all."), ("r", "s", "K.g", "a.py", "short")], "repo string, slice_id string, ref string, file_path string, doc string")
    parser = lambda text, kind: [("wh_object", "What does the function return here?", "the value of it all"), ("wh_manner", "How?", "no")]
    assert [(r.question, r.qa_subtype) for r in X.questions(rows, "function", parser).collect()] == [("What does K.f return here?", "wh_object")] and X.questions(rows, "function", None).count() == 0


def test_evaluation(spark):
    rows = [(1, "intrinsic", "function_parameters", "What?", "you are a code analysis assistant given source code of file answer question precisely and concisely", "a.py", "x = 1"), (2, "intrinsic", "other", "What?", "x", "a.py", None)]
    q = spark.createDataFrame(rows, "q int, qa_type string, qa_subtype string, question string, answer string, file_path string, content string")
    for c in ("from_content", "to_content", "from_version", "to_version"):
        q = q.withColumn(c, F.lit(None).cast("string"))
    q = q.withColumn("related_contents", F.array().cast("array<struct<file_path:string,content:string>>"))
    got = {r.q: r for r in E.evaluated(q, E.echo).collect()}
    assert got[1].metrics["f1"] > 0.8 and got[1].context_retrieved and got[2].prediction is None and got[2].metrics == {} and not got[2].context_retrieved
    only = {r.q: r.prediction for r in E.evaluated(q, E.echo, mode="question_only").collect()}
    assert only == {1: "What?", 2: "What?"}
    calls, waits = [], []

    def shaky(prompts):
        calls.append(prompts)
        if len(calls) < 3:
            raise OSError
        return ["ok"] * len(prompts)

    assert E.retrying(shaky, wait=waits.append)(["a", "b"]) == ["ok", "ok"] and waits == [1.0, 2.0]
    missing = E.predicted(q.select("q", F.lit("p").alias("prompt")), lambda: lambda p: [None] * len(p), again=lambda: lambda p: ["second"] * len(p))
    assert {r.prediction for r in missing.collect()} == {"second"}


def test_streamed_changes(spark, tmp_path):
    from palimpsest.streaming import snapshots as W

    rows = [("r", "k", 0, "a"), ("r", "k", 1, "a"), ("r", "k", 2, "b"), ("r", "k", 4, "b"), ("r", "j", 1, "x")]
    spark.createDataFrame(rows, "repo string, key string, slice_idx int, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, key string, slice_idx int, value string").parquet(str(tmp_path / "in"))
    q = W.changes(stream).writeStream.format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.slice_idx, r.status) for r in spark.table("moved").collect())
    assert got == [("j", 1, "added"), ("k", 0, "added"), ("k", 1, "stable"), ("k", 2, "changed"), ("k", 4, "added")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert W.activity(events).agg(F.sum("n")).first()[0] == events.count()
