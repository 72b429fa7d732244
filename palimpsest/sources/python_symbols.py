"""Symbols of Python source: functions, classes, imports and documentation, by the interpreter's own parser.

Only what stands at the top of a module or of a class counts as such; functions within a method belong to the method's
class. Annotations, defaults, names and strings are the text as written; names that a body uses are sorted, without
repeats. Where a file doesn't parse, the offending lines are left out, then the blocks around them; a file of which
nothing is left has no symbols. A default that is a bare name stays with its parameter.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import java_symbols
from .tables import CLASSES, FUNCTIONS, IMPORTS


def struct_type(columns: str) -> str:
    """The columns of a table, without file_path, as a struct."""
    out, depth, part = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            if name != "file_path":
                out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return f"struct<{','.join(out)}>"


PARSED = f"functions array<{struct_type(FUNCTIONS)}>, classes array<{struct_type(CLASSES)}>, imports array<{struct_type(IMPORTS)}>, module_doc string, content_hash string"
HEADER = re.compile(r"(\s*)(?:async\s+def|def|class)\b")
SKIPPED = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT)


class Source:
    """A text with its tokens by place: brackets with their partners, and string literals."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.begin = [0]
        for line in self.lines:
            self.begin.append(self.begin[-1] + len(line) + 1)
        self.start: list[int] = []
        self.stop: list[int] = []
        self.word: list[str] = []
        self.partner: dict[int, int] = {}
        self.strings: list[tuple[int, int]] = []
        open_, formatted = [], []
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in SKIPPED:
                continue
            a, z = self.begin[t.start[0] - 1] + t.start[1], self.begin[t.end[0] - 1] + t.end[1]
            if t.type == tokenize.STRING:
                self.strings.append((a, z))
            elif t.type == tokenize.FSTRING_START:
                formatted.append(a)
            elif t.type == tokenize.FSTRING_END:
                self.strings.append((formatted.pop(), z))
            elif t.type == tokenize.OP and t.string in "([{":
                open_.append(len(self.start))
            elif t.type == tokenize.OP and t.string in ")]}" and open_:
                i = open_.pop()
                self.partner[i], self.partner[len(self.start)] = len(self.start), i
            self.start.append(a)
            self.stop.append(z)
            self.word.append(t.string)
        self.strings.sort()

    def place(self, line: int, column: int) -> int:
        """Where a node's line and column (in bytes) lie in the text."""
        own = self.lines[line - 1]
        return self.begin[line - 1] + (column if own.isascii() else len(own.encode()[:column].decode("utf-8", "ignore")))

    def span(self, node) -> tuple[int, int]:
        return self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def written(self, node) -> str | None:
        """A node's text."""
        if node is None:
            return None
        a, z = self.span(node)
        return self.text[a:z]

    def whole(self, node) -> str | None:
        """A node's text with the brackets right around it."""
        if node is None:
            return None
        a, z = self.span(node)
        i, j = bisect_left(self.start, a), bisect_left(self.stop, z)
        while i and j + 1 < len(self.word) and self.word[i - 1] == "(" and self.partner.get(i - 1) == j + 1:
            i, j = i - 1, j + 1
        return self.text[self.start[i] : self.stop[j]]

    def head(self, node) -> tuple[int, int]:
        """Where a function's header begins, at async or def, and where its parameters or return type end."""
        a = self.span(node)[0]
        i = bisect_left(self.start, a)
        while self.word[i] != "(":
            i = self.partner[i] + 1 if self.word[i] == "[" else i + 1
        end = self.stop[self.partner[i]]
        if node.returns is not None:
            j = bisect_left(self.stop, self.span(node.returns)[1])
            while self.word[j + 1] != ":":
                j += 1
            end = self.stop[j]
        return a, end

    def strings_within(self, a: int, z: int) -> list[tuple[int, int]]:
        return [s for s in self.strings[bisect_left(self.strings, (a, a)) : bisect_left(self.strings, (z, z))] if s[1] <= z]

    def first_string(self, statement) -> str | None:
        """The first string of an expression or assignment, with those that follow it at once, without triple quotes."""
        if not isinstance(statement, (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign)):
            return None
        found = self.strings_within(*self.span(statement))
        if not found:
            return None
        a, z = found[0]
        for b, y in found[1:]:
            if b >= z:
                if bisect_left(self.start, b) != bisect_left(self.stop, z) + 1:
                    break
                z = y
        text = self.text[a:z].strip()
        text = text[3:] if text.startswith(('"""', "'''")) else text
        return (text[:-3] if text.endswith(('"""', "'''")) else text).strip()

    def doc(self, body: list) -> str | None:
        return next((s for x in body if (s := self.first_string(x)) is not None), None)


def visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def parameters(args: ast.arguments, source: Source) -> list[dict]:
    def one(a: ast.arg, default: ast.expr | None = None, stars: str = "") -> dict:
        return {"name": stars + a.arg, "type_annotation": source.whole(a.annotation), "default_value": source.whole(default)}

    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    out = [one(a, d) for a, d in zip(plain, defaults)]
    out += [one(args.vararg, stars="*")] if args.vararg else []
    out += [one(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    return out + ([one(args.kwarg, stars="**")] if args.kwarg else [])


def decorators(node, source: Source) -> list[str]:
    """Each up to its first bracket."""
    return [source.whole(d).split("(", 1)[0].strip() for d in node.decorator_list]


def uses(node, source: Source, begin: int) -> tuple[list[str], list[str], list[str], list[str]]:
    """Calls, instantiations (a dotted name with a capital first letter and no underscore), attributes and strings of a body.

    Only what is called by a plain or dotted name counts as called.
    """
    calls, made, fields = set(), set(), set()
    for part in node.body:
        for x in ast.walk(part):
            if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)) and (x.func.lineno, x.func.col_offset) == (x.lineno, x.col_offset):
                name = source.written(x.func)
                (made if name[0].isupper() and name != name.lower() and "_" not in name else calls).add(name)
            elif isinstance(x, ast.Attribute):
                fields.add(source.written(x))
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute):
                fields.add(source.written(x.func))
    strings = {source.text[a:z] for a, z in source.strings_within(begin, source.span(node)[1])}
    return sorted(calls), sorted(made), sorted(fields), sorted(strings)


def function(node, container: str | None, path: str, source: Source) -> dict:
    a, z = source.head(node)
    calls, made, fields, strings = uses(node, source, z)
    deco = decorators(node, source)
    return {
        "name": node.name, "kind": "method" if container else "function", "container": container, "signature": " ".join(source.text[a:z].split()) + ":", "parameters": parameters(node.args, source), "return_type": source.whole(node.returns),
        "decorators": deco, "visibility": visibility(node.name), "is_static": "staticmethod" in deco, "is_abstract": "abstractmethod" in deco, "start_line": node.lineno, "end_line": node.end_lineno,
        "doc": source.doc(node.body), "file": path, "calls": calls, "instantiations": made, "field_accesses": fields, "string_literals": strings,
    }


def own_fields(node: ast.ClassDef, source: Source) -> list[dict]:
    """Assignments of the class and of self in __init__, by their first target; the first of equal names.

    The value is all that stands after the first target, so a chain keeps its other targets; without a value, the
    annotation.
    """
    found: dict[str, dict] = {}

    def value(x) -> str:
        if isinstance(x, ast.AnnAssign):
            return source.whole(x.value if x.value is not None else x.annotation)
        if len(x.targets) == 1:
            return source.whole(x.value)
        return source.text[source.span(x.targets[1])[0] : source.span(x)[1]]

    def add(name: str, x, static: bool) -> None:
        found.setdefault(name, {"name": name, "type_annotation": None, "default_value": value(x), "visibility": visibility(name), "is_static": static})

    def assigned(body):
        return [(x.targets[0] if isinstance(x, ast.Assign) else x.target, x) for x in body if isinstance(x, (ast.Assign, ast.AnnAssign))]

    for x in node.body:
        for t, statement in assigned([x]):
            if isinstance(t, ast.Name):
                add(t.id, statement, True)
        if isinstance(x, ast.FunctionDef) and x.name == "__init__" and not x.decorator_list:
            for t, statement in assigned(x.body):
                if isinstance(t, ast.Attribute) and (name := source.written(t)).startswith("self."):
                    add(name[5:], statement, False)
    return list(found.values())


def class_(node: ast.ClassDef, path: str, source: Source) -> dict:
    bases = [source.written(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
    abstract = "ABC" in bases or "ABCMeta" in bases
    return {
        "name": node.name, "kind": "abstract_class" if abstract else "class", "base_classes": bases, "implemented_interfaces": [], "decorators": decorators(node, source), "fields": own_fields(node, source),
        "methods": [f.name for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))], "visibility": None, "is_abstract": abstract, "start_line": node.lineno, "end_line": node.end_lineno, "doc": source.doc(node.body), "file": path,
    }


def imports(tree: ast.Module) -> list[dict]:
    out = []
    for x in tree.body:
        if isinstance(x, ast.Import):
            out += [{"module": a.name, "names": [], "alias": a.asname, "is_wildcard": False} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            names = [a.name for a in x.names]
            out.append({"module": "." * x.level + (x.module or ""), "names": [n for n in names if n != "*"], "alias": None, "is_wildcard": "*" in names})
    return out


def without(lines: list[str], at: int, tried: set[int]) -> list[str]:
    """lines without what doesn't parse at line `at` (from 0): a statement becomes pass; if that was tried, the function
    or class around it goes, and what is left at last is the line itself. Lines keep their numbers."""
    out = list(lines)
    own = out[at]
    if at not in tried and own.strip() and not HEADER.match(own):
        tried.add(at)
        out[at] = own[: len(own) - len(own.lstrip())] + "pass"
        return out
    depth = len(own) - len(own.lstrip())
    top = at
    while top > 0 and not ((m := HEADER.match(out[top])) and (top == at or len(m[1]) < depth)):
        top -= 1
    m = HEADER.match(out[top])
    if m is None:
        out[at] = ""
        return out
    end = top + 1
    while end < len(out) and (end <= at or not out[end].strip() or len(out[end]) - len(out[end].lstrip()) > len(m[1])):
        end += 1
    while top > 0 and out[top - 1].lstrip().startswith("@"):
        top -= 1
    out[top:end] = [""] * (end - top)
    return out


def tolerant(text: str) -> tuple[ast.Module, Source] | None:
    """The tree and tokens of a text, without the parts that don't parse. Each step takes something away, so it ends."""
    lines, tried = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), set()
    while True:
        own = "\n".join(lines)
        try:
            return ast.parse(own), Source(own)
        except (SyntaxError, tokenize.TokenError) as e:
            at = min(max((e.lineno if isinstance(e, SyntaxError) else e.args[1][0]) or 1, 1), len(lines)) - 1
        except (ValueError, RecursionError, MemoryError):
            return None
        while at > 0 and not lines[at].strip():
            at -= 1
        before, lines = lines, without(lines, at, tried)
        if lines == before:
            lines = [*lines[:at], "", *lines[at + 1 :]]
        if lines == before or not any(x.strip() not in ("", "pass") for x in lines):
            return None


def parse(text: str, path: str) -> dict | None:
    """The symbols of one file, or None."""
    found = tolerant(text)
    if found is None:
        return None
    tree, source = found
    functions, classes = [], []

    def walk(node, container: str | None) -> None:
        for x in node.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.append(function(x, container, path, source))
                walk(x, container)
            elif isinstance(x, ast.ClassDef):
                classes.append(class_(x, path, source))
                walk(x, x.name)

    walk(tree, None)
    first = next((x for x in tree.body if not isinstance(x, (ast.Import, ast.ImportFrom))), None)
    return {"functions": functions, "classes": classes, "imports": imports(tree), "module_doc": source.first_string(first) if first else None}


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content as bytes, others) with their symbols; by the suffix of the path, null for other languages."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content") + ", " + PARSED
    names = [c for c in files.columns if c != "content"]

    def work(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"]):
                text = bytes(content or b"").decode("utf-8", "ignore")
                own = parse(text, path) if path.lower().endswith(".py") else java_symbols.parse(text, path) if path.lower().endswith(".java") else None
                found.append({**(own or dict.fromkeys(("functions", "classes", "imports", "module_doc"))), "content_hash": hashlib.sha256(bytes(content or b"")).hexdigest()})
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(found, columns=["functions", "classes", "imports", "module_doc", "content_hash"])], axis=1)

    return files.select(*names, "content").mapInPandas(work, schema)
