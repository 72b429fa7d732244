from __future__ import annotations

import json
import subprocess

import pytest

from palimpsest.operators import slicing as O
from palimpsest.sources import config, git, java_symbols, python_symbols, tables

PY = '''"""Module text."""
import os.path as p, sys
from .a import b as c, d
from x import *

@dec(1)
class K(ABC, m.B, metaclass=M):
    """Doc."""
    one: int = 1
    two = other = "s"

    def __init__(self, a, /, b: int = 2, *rest, k=None, **more) -> None:
        self.three = a
        self.one = 5

    @staticmethod
    async def _go(x):
        y = Thing(x)
        return await self.run(y.z, "text")

def __hidden():
    def inner():
        return None

if True:
    def skipped(): pass
'''
JAVA = '''package a.b;
import java.util.*;
import static java.lang.Math.max;
import single;
/** Doc
 * more. */
public abstract class K<T> extends Base<T> implements I<T>, J {
    private static final int N = max(1, 2);
    String name; // int fake;
    /** Makes. */
    public K(final String name, int... more) { this.name = name; }
    @Override public static <X> List<X> get(Map<String, X> m) throws E {
        if (m.isEmpty()) { return new ArrayList<>(); }
        String s = "class Fake {";
        return helper(m, new Foo(s));
    }
    abstract void none();
}
interface I { void go(int a); }
'''


def test_python_symbols():
    got = python_symbols.parse(PY, "a.py")
    by = {f["name"]: f for f in got["functions"]}
    assert list(by) == ["__init__", "_go", "__hidden", "inner"]
    assert by["__init__"]["parameters"][2] == {"name": "b", "type_annotation": "int", "default_value": "2"} and [p["name"] for p in by["__init__"]["parameters"]] == ["self", "a", "b", "*rest", "k", "**more"]
    assert by["__init__"]["signature"] == "def __init__(self, a, /, b: int = 2, *rest, k=None, **more) -> None:" and by["__init__"]["kind"] == "method"
    go = by["_go"]
    assert (go["container"], go["visibility"], go["is_static"], go["calls"], go["instantiations"], go["string_literals"]) == ("K", "protected", True, ["self.run"], ["Thing"], ['"text"'])
    assert by["__hidden"]["visibility"] == "private" and by["inner"]["kind"] == "function"
    k = got["classes"][0]
    assert (k["base_classes"], k["kind"], k["decorators"], [f["name"] for f in k["fields"]], k["methods"], k["doc"]) == (["ABC", "m.B"], "abstract_class", ["dec"], ["one", "two", "three"], ["__init__", "_go"], "Doc.")
    assert [(i["module"], i["names"], i["alias"], i["is_wildcard"]) for i in got["imports"]] == [("os.path", [], "p", False), ("sys", [], None, False), (".a", ["b", "d"], None, False), ("x", [], None, True)]
    assert got["module_doc"] == "Module text." and python_symbols.parse("def (", "x.py") is None


WRITTEN = '''def f(a="s", b=0x10, c: "X" = 'y', d: Dict[str,int] = {}, e=(1), *r: int,
      k = lambda x, y: 1) -> "Y" :
    """ Doc 'q'
    more """
    models.User(1); get()(2); (g)(3)
    U = User("w")
    return f"a{u.b('n')}" r's'
class A(abc.ABC, metaclass=ABCMeta):
    q: int
    z = y = "\u00e9"; v = \u00e9(1)
    def __init__(self): self.a.b = [1,
       2]
'''


def test_python_texts_are_as_written():
    got = python_symbols.parse(WRITTEN, "a.py")
    f = got["functions"][0]
    assert f["signature"] == """def f(a="s", b=0x10, c: "X" = 'y', d: Dict[str,int] = {}, e=(1), *r: int, k = lambda x, y: 1) -> "Y":""" and f["return_type"] == '"Y"'
    assert [(p["type_annotation"], p["default_value"]) for p in f["parameters"]] == [(None, '"s"'), (None, "0x10"), ('"X"', "'y'"), ("Dict[str,int]", "{}"), (None, "(1)"), ("int", None), (None, "lambda x, y: 1")]
    assert (f["calls"], f["instantiations"], f["field_accesses"]) == (["get", "models.User", "u.b"], ["User"], ["models.User", "u.b"])
    assert f["string_literals"] == ['""" Doc \'q\'\n    more """', '"w"', "'n'", "f\"a{u.b('n')}\"", "r's'"] and f["doc"] == "Doc 'q'\n    more"
    k = got["classes"][0]
    assert [(x["name"], x["default_value"]) for x in k["fields"]] == [("q", "int"), ("z", 'y = "\u00e9"'), ("v", "\u00e9(1)"), ("a.b", "[1,\n       2]")] and k["kind"] == "class"


def test_python_files_with_errors():
    text = "import os\ndef a():\n    print 'x'\n    return b()\ndef c(:\n    pass\nclass D:\n    def e(self): return 1\n    def f(self) return 2\n    def g(self): return 3\nx = (1,\n"
    got = python_symbols.parse(text, "a.py")
    assert [(f["container"], f["name"], f["calls"], f["start_line"]) for f in got["functions"]] == [(None, "a", ["b"], 2), ("D", "e", [], 8), ("D", "g", [], 10)]
    assert [c["name"] for c in got["classes"]] == ["D"] and [i["module"] for i in got["imports"]] == ["os"]
    assert python_symbols.parse("", "a.py")["functions"] == [] and python_symbols.parse("x = '\x00'", "a.py") is None


def test_java_symbols():
    got = java_symbols.parse(JAVA, "K.java")
    by = {(f["container"], f["name"]): f for f in got["functions"]}
    assert set(by) == {("K", "K"), ("K", "get"), ("K", "none"), ("I", "go")}
    get = by["K", "get"]
    assert (get["return_type"], get["visibility"], get["is_static"], get["decorators"], get["calls"], get["instantiations"]) == ("List<X>", "public", True, ["Override"], ["helper", "isEmpty"], ["ArrayList", "Foo"])
    assert by["K", "K"]["kind"] == "constructor" and by["K", "K"]["doc"] == "Makes." and [p["type_annotation"] for p in by["K", "K"]["parameters"]] == ["String", "int..."]
    assert by["I", "go"]["visibility"] == "package" and by["K", "none"]["is_abstract"]
    k, i = got["classes"]
    assert (k["base_classes"], k["implemented_interfaces"], k["kind"], [f["name"] for f in k["fields"]], k["methods"]) == (["Base"], ["I", "J"], "abstract_class", ["N", "name"], ["get", "none"])
    assert i["kind"] == "interface" and i["visibility"] is None and k["doc"] == "Doc\nmore."
    assert [(x["module"], x["names"], x["is_wildcard"]) for x in got["imports"]] == [("java.util", [], True), ("java.lang.Math", ["max"], False), ("single", [], False)]


def test_parsed_files(spark, tmp_path):
    rows = [("r", 0, "a.py", PY.encode()), ("r", 0, "K.JAVA", JAVA.encode()), ("r", 0, "x.md", b"text"), ("r", 0, "bad.py", b"def ("), ("r", 1, "none.py", None)]
    out = python_symbols.parsed(spark.createDataFrame(rows, "repo string, slice_idx int, path string, content binary"))
    got = {r.path: r for r in out.collect()}
    assert len(got["a.py"].functions) == 4 and len(got["K.JAVA"].classes) == 2 and got["x.md"].functions is None and got["bad.py"].classes is None
    tables.write_symbols(out, str(tmp_path / "symbols"))
    back = spark.read.parquet(str(tmp_path / "symbols/functions"))
    assert back.count() == 8 and set(back.select("file_path").distinct().toPandas().file_path) == {"a.py", "K.JAVA"}


def test_json_layout(spark, tmp_path):
    home = tmp_path / "demo/slices/slice_0003/symbols"
    home.mkdir(parents=True)
    (home / "functions.json").write_text(json.dumps([{"name": "f", "kind": "function", "calls": ["g"]}, {"name": "h"}]))
    (home.parent / "metadata.json").write_text(json.dumps({"commit_hash": "abc", "version_tag": "v1"}))
    got = tables.read_symbols(spark, str(tmp_path), "functions").collect()
    assert [(r.repo, r.slice_idx, r.name, r.calls) for r in got] == [("demo", 3, "f", ["g"]), ("demo", 3, "h", None)]
    assert tables.read_slices(spark, str(tmp_path)).first().slice_id == "slice_0003"
    (tmp_path / "q.jsonl").write_text('{"qa_id": "1", "repo": "r", "qa_type": "t", "question": "q?"}\n\n')
    qa = tables.read_qa(spark, str(tmp_path / "q.jsonl"))
    assert qa.count() == 1
    tables.write_qa(qa, str(tmp_path / "out"))
    assert (tmp_path / "out/repo_=r/type_=t").exists() and tables.pool_path("d", "all") == "d/all_qa_pairs.jsonl"


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    home = tmp_path_factory.mktemp("git")
    run = lambda *a, **k: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(home), *a], check=True, capture_output=True, **k)
    run("init", "-q")
    for k, (tag, text) in enumerate([("v1.0.0", "def f(): pass\n"), ("v1.1.0", "def f(): pass\ndef g(): pass\n"), ("v2.0.0", "def g(): return 1\n")]):
        (home / "a.py").write_text(text)
        (home / "same.txt").write_text("same\n")
        run("add", ".")
        run("commit", "-q", "-m", f"c{k}")
        run("tag", *(["-a", "-m", "x"] if k else []), tag)
    run("tag", "nightly")
    return str(home)


def test_git_history(spark, repository, tmp_path):
    assert git.has_commits(repository) and not git.has_commits(str(tmp_path))
    found = git.tags(spark, "demo", repository)
    anchors = O.ordered(O.anchors(found)).orderBy("idx").collect()
    assert [a.tag_name for a in anchors] == ["v1.0.0", "v1.1.0", "v2.0.0"]
    hashes = [a.commit_hash for a in anchors]
    stat = O.numstat(git.numstat(spark, "demo", repository, list(zip(hashes, hashes[1:]))), ["from_commit"])
    assert {r.from_commit: (r.delta_lines, r.delta_files) for r in stat.collect()} == {hashes[0]: (1, 1), hashes[1]: (3, 1)}
    tree = git.trees(spark, "demo", repository, hashes)
    content = git.blobs(tree, repository)
    assert content.count() == 4
    texts = {(r.commit_hash, r.path): r.text for r in git.files_at(tree, content).collect()}
    assert texts[hashes[2], "a.py"] == "def g(): return 1\n" and len(texts) == 6
    assert git.changed_paths(repository, hashes[0], hashes[1]) == ["a.py"]
    copy = git.clone(repository, str(tmp_path / "copy"))
    assert git.has_commits(copy) and git.clone("nowhere", copy) == copy
    with pytest.raises(FileExistsError):
        (tmp_path / "full").mkdir()
        (tmp_path / "full/x").write_text("x")
        git.clone(repository, str(tmp_path / "full"))


def test_settings(tmp_path):
    assert config.load(None).slicing.target_slices == 20 and config.load(str(tmp_path / "none.yaml")).validation.min_code_files_per_slice == 1
    own = config._filled(config.Config, {"slicing": {"target_slices": 5, "distance_weights": {"lines": 1.0}, "unknown": 1}})
    assert own.slicing.target_slices == 5 and own.slicing.distance_weights.lines == 1.0 and own.slicing.distance_weights.files == 0.45
    with pytest.raises(ValueError):
        config._filled(config.Config, {"slicing": {"segment_gain": "cube"}})


def test_repository_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("  https://a/b \n\n c\n")
    assert [r.url for r in git.repository_urls(spark, str(tmp_path / "list.txt")).collect()] == ["https://a/b", "c"]
