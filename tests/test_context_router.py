from __future__ import annotations

from palimpsest.operators import context as O
from palimpsest.sources import tables

IDS = [f"r_x{9 - k}_202001{k:02d}" for k in range(12)]  # identifiers sort by their date, not by what comes before it
SLICES = [("r", i, f"v{k}" if k % 2 == 0 else None) for k, i in enumerate(IDS)]
FILES = [("r", IDS[k], "a.py", f"a at {k}") for k in (3, 4, 5, 6)] + [("r", IDS[2], p, f"text of {p}") for p in ("b.py", "c.py")]
ASKED = [  # key, type, subtype, file, symbol, at, from, to
    (1, "intrinsic", "function_signature", "a.py", "f", 3, None, None), (2, "intrinsic", "function_signature", "a.py", "f", 7, None, None),
    (3, "temporal", "function_signature_changed", "a.py", "f", None, 4, 7), (4, "temporal", "function_signature_evolution", "a.py", "f", None, 0, 11),
    (5, "temporal", "class_first_introduced", "a.py", "f", None, 0, 11), (6, "temporal", "function_last_present", "a.py", "f", None, 0, 11),
    (7, "intrinsic", "class_subclasses", "k.py", "K", 2, None, None), (8, "extrinsic", "yesno", "a.py", None, 3, None, None),
    (9, "temporal", "function_last_present", "none.py", "f", None, 0, 11), (10, "intrinsic", "class_instantiation_sites", "b.py", "K", 2, None, None), (11, None, None, None, None, None, None, None),
]


def asked(spark):
    name = lambda k: None if k is None else IDS[k]
    rows = [(q, "r", t, s, f, y, name(a), name(b), name(c)) for q, t, s, f, y, a, b, c in ASKED] + [(12, "r", "temporal", "function_signature_changed", "a.py", "f", None, "unknown", IDS[3])]
    return spark.createDataFrame(rows, "qa_id int, repo string, qa_type string, qa_subtype string, file_path string, symbol string, slice_id string, from_slice_id string, to_slice_id string")


def test_contexts_by_subtype(spark):
    files = spark.createDataFrame(FILES, "repo string, slice_id string, file_path string, content string")
    slices = spark.createDataFrame(SLICES, "repo string, slice_id string, version_tag string")
    names = [("r", IDS[2], 0, "c.py", ["K"], ["L"]), ("r", IDS[2], 1, "k.py", ["K"], ["K"]), ("r", IDS[2], 2, "b.py", ["K", "M"], ["K"]), ("r", IDS[3], 3, "d.py", ["K"], ["K"])]
    symbols = spark.createDataFrame(names, "repo string, slice_id string, ord long, file_path string, base_classes array<string>, instantiations array<string>")
    out = O.routed(asked(spark), files, slices, symbols, symbols)
    got = {r.qa_id: r for r in out.collect()}
    assert len(got) == out.count() == len(ASKED) + 1
    pick = lambda k: (got[k].content, got[k].version, got[k].from_content, got[k].from_version, got[k].to_content, got[k].to_version)
    assert pick(1) == ("a at 3", IDS[3], None, None, None, None) and pick(8) == pick(1)
    assert pick(2) == (None, IDS[7], None, None, None, None) and not got[2].context_retrieved and got[1].context_retrieved
    assert pick(3) == (None, None, "a at 4", "v4", None, IDS[7])
    assert pick(4) == (None, None, "a at 3", IDS[3], "a at 6", "v6")
    assert pick(5) == (None, None, "a at 3", IDS[3], None, None) and pick(6) == (None, None, "a at 6", "v6", None, None)
    assert pick(9) == pick(11) == (None,) * 6
    assert pick(12) == (None, None, None, "unknown", "a at 3", IDS[3])
    assert [(x.file_path, x.content) for x in got[7].related_contents] == [("c.py", "text of c.py"), ("b.py", "text of b.py")]
    assert got[10].related_contents == [] and got[1].related_contents == []  # k.py has no text there


def test_pools(spark, tmp_path):
    rows = [("1", "r", "intrinsic", "s", "q?"), ("2", "r", "temporal", "t", "p?")]
    qa = spark.createDataFrame(rows, "qa_id string, repo string, qa_type string, qa_subtype string, question string")
    tables.write_pools(qa, str(tmp_path))
    ids = lambda t: sorted(r.qa_id for r in tables.read_pool(spark, str(tmp_path), t).collect())
    assert (ids("intrinsic"), ids("temporal"), ids("extrinsic"), ids("all")) == (["1"], ["2"], [], ["1", "2"])
    assert tables.read_pool(spark, str(tmp_path / "none"), "all").count() == 0
