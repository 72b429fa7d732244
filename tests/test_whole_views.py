"""The views that registered queries start from hold all rows of their tables."""

from __future__ import annotations

import pytest

from palimpsest.plans import adaptors as A
from palimpsest.plans import context, docs, intrinsic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("lineitem", "supplier", "orders", "customer")}


def test_classes_come_from_all_lines(spark, frames):
    nation = dict(zip(frames["supplier"].s_suppkey, frames["supplier"].s_nationkey))
    want: dict = {}
    for x in frames["lineitem"].itertuples():
        bases, interfaces, methods, fields = want.setdefault((f"R{nation[x.l_suppkey] % 3}", x.l_shipdate.year - 1995, f"K{x.l_partkey}"), (set(), set(), set(), set()))
        if x.l_quantity <= 3:
            bases.add(f"K{x.l_suppkey % 4 + 1}")
        if x.l_quantity >= 50:
            interfaces.add(f"I{x.l_linenumber}")
        if x.l_discount == 0:
            methods.add(f"m{x.l_suppkey % 50}")
        if x.l_tax == 0:
            fields.add(f"x{x.l_suppkey % 20}")
    got = A.classes(spark, SF).collect()
    assert {(r.repo, r.slice_idx, r.name): tuple(map(set, (r.base_classes, r.implemented_interfaces, r.methods, r.fields))) for r in got} == want and len(got) == len(want)
    assert len({k[1] for k in want}) * len({(k[0], k[2]) for k in want}) > len(want)  # some classes are absent from some snapshots


def test_files_come_from_all_orders_and_every_supplier_asks(spark, frames):
    own = {c.c_custkey: (c.c_mktsegment, f"src/n{c.c_custkey}.{'java' if c.c_custkey % 2 else 'py'}") for c in frames["customer"].itertuples()}
    last: dict = {}
    for o in frames["orders"].itertuples():
        repo, path = own[o.o_custkey]
        k = repo, (o.o_orderdate.year - 1995) * 4 + (o.o_orderdate.month - 1) // 3, path
        last[k] = max(last.get(k, 0), o.o_orderkey)
    text = lambda path, n: f"# {path}\n{'x = 1;' * (n % 40)} def f{n % 3}(a): pass {'y;' * (n % 50)}"
    got = {(r.repo, r.slice_idx, r.file_path): r.content for r in context.files(spark, SF).collect()}
    assert got == {k: text(k[2], n) for k, n in last.items()}
    assert len({k[1] for k in last}) * len({(k[0], k[2]) for k in last}) > len(last)  # some files are absent from some snapshots
    asked = context.questions(spark, SF).collect()
    assert sorted(r.q for r in asked) == sorted(frames["supplier"].s_suppkey)
    assert any((r.repo, i, r.file_path) in got for r in asked for i in range(28))


def test_texts_are_whole(spark):
    turns = {(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn, r["head"]) for r in docs.parts(spark, SF).collect()} == turns
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 9 = 4").collect()}
    got = {r.doc_id: r.doc for r in A.sql_over(spark, SF, docs.TEXTS, "documents").filter("doc_id % 9 = 4").collect()}
    assert got == {k: None if t is None else 'f"' + t for k, t in texts.items()} and any(len(t or "") > 30 for t in texts.values())


def test_extrinsic_questions_come_from_all_functions(spark):
    n = A.public(A.functions(spark, SF)).count()
    got = {r.qa_type: r.n for r in intrinsic.qa_union_all(spark, SF).filter("qa_type = 'extrinsic'").groupBy("qa_type").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {"extrinsic": n}
