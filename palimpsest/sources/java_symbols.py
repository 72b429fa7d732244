"""Symbols of Java source by a scanner of its own: no grammar, only braces, modifiers and names.

Comments and strings are blanked first, their places kept. Types are found by their keyword, members at the depth below
by their shape: a name before parentheses and a block or semicolon is a method, other statements are fields. Bodies of
enums and records are not looked into.
"""

from __future__ import annotations

import re

MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "synchronized", "native", "default", "strictfp", "transient", "volatile")
BLANK = re.compile(r'/\*.*?\*/|//[^\n]*|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
TYPE = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+|(?:" + "|".join(MODIFIERS) + r")\s+)*)\b(class|interface)\s+(\w+)([^{;]*)\{")
METHOD = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s*|(?:" + "|".join(MODIFIERS) + r")\s+)*)(?:<[^>]*>\s*)?(?:([\w.$]+(?:<[^;={}]*>)?(?:\[\])*)\s+)?(\w+)\s*\(([^;{}]*)\)\s*(?:throws[^{;]*)?([{;])")
FIELD = re.compile(r"((?:@[\w.]+(?:\([^)]*\))?\s*|(?:" + "|".join(MODIFIERS) + r")\s+)*)([\w.$]+(?:<[^;={}()]*>)?(?:\[\])*)\s+(\w+)\s*(?:=\s*([^;]*))?;")
CALL, NEW = re.compile(r"(?<![\w.])(?:\w+\s*\.\s*)*(\w+)\s*\("), re.compile(r"\bnew\s+([\w.]+)")
WORDS = frozenset("if for while switch catch return new synchronized super this throw else do try assert".split())


def blanked(text: str) -> str:
    return BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def comment_before(text: str, at: int) -> str | None:
    """The documentation comment that ends right before a place."""
    head = re.sub(r"(?:@\w+(?:\([^)]*\))?\s*)+\Z", "", text[:at].rstrip()).rstrip()
    if not head.endswith("*/") or (start := head.rfind("/*")) < 0 or not head.startswith("/**", start):
        return None
    lines = head[start + 3 : -2].split("\n")
    return "\n".join(re.sub(r"\A\s*\*\s*", "", x) for x in lines).strip()


def split_types(text: str) -> list[str]:
    """Names between commas, generics left out."""
    while (plain := re.sub(r"<[^<>]*>", "", text)) != text:
        text = plain
    return [x.strip() for x in text.split(",") if x.strip()]


def parameter(text: str) -> dict | None:
    text = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", text).strip()
    m = re.fullmatch(r"(.+?)\s*(\.\.\.)?\s*\b(\w+)", text, re.S)
    return {"name": m[3], "type_annotation": m[1].strip() + (m[2] or ""), "default_value": None} if m else None


def parameters(text: str) -> list[dict]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth <= 0:
            if p := parameter(part):
                out.append(p)
            part = ""
        else:
            part += c
    return out


def modifiers(text: str) -> tuple[str, list[str], list[str]]:
    words = re.sub(r"@[\w.]+(?:\([^)]*\))?", " ", text).split()
    return next((w for w in words if w in MODIFIERS[:3]), "package"), words, re.findall(r"@([\w.]+)", text)


def members(text: str, clean: str, start: int, end: int, owner: str, path: str) -> tuple[list[dict], list[dict]]:
    """Methods and fields that stand directly in a type's block."""
    flat, at = list(clean), start
    while (brace := clean.find("{", at, end)) >= 0:  # inner blocks are blanked, their braces stay
        close = closing(clean, brace)
        flat[brace + 1 : close] = re.sub(r"[^\n]", " ", clean[brace + 1 : close])
        at = close + 1
    level, functions, fields = "".join(flat), [], []
    taken = []
    for m in METHOD.finditer(level, start, end):
        mods, kind, name, args, last = m.groups()
        if name in WORDS or kind in ("new", "return", "throw", "else") or (kind is None and name != owner):
            continue
        see, words, notes = modifiers(mods)
        body = text[m.end() : closing(clean, m.end() - 1)] if last == "{" else ""
        bare = blanked(body)
        made = sorted({x.rsplit(".", 1)[-1] for x in NEW.findall(bare)})
        calls = sorted({x for x in CALL.findall(re.sub(r"\bnew\s+[\w.]+\s*\(", "(", bare)) if x not in WORDS})
        head = " ".join(re.sub(r"\A(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", text[m.start() : m.end() - 1].strip()).split())
        functions.append({
            "name": name, "kind": "constructor" if name == owner else "method", "container": owner, "signature": head, "parameters": parameters(args), "return_type": kind, "decorators": notes, "visibility": see, "is_static": "static" in words, "is_abstract": "abstract" in words,
            "start_line": text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, "end_line": text.count("\n", 0, m.end() + len(body)) + 1, "doc": comment_before(text, m.start()), "file": path, "calls": calls, "instantiations": made,
            "field_accesses": sorted(set(re.findall(r"\b(\w+(?:\.\w+)+)(?!\s*\()", bare))), "string_literals": sorted(set(re.findall(r'"((?:\\.|[^"\\\n])*)"', body))),
        })
        taken.append((m.start(), m.end()))
    for m in FIELD.finditer(level, start, end):
        if m[2] in WORDS or any(a < m.end() and m.start() < z for a, z in taken):
            continue
        see, words, _ = modifiers(m[1])
        fields.append({"name": m[3], "type_annotation": m[2], "default_value": m[4].strip() if m[4] else None, "visibility": see, "is_static": "static" in words})
    return functions, fields


def parse(text: str, path: str) -> dict | None:
    clean = blanked(text)
    functions, classes = [], []
    for m in TYPE.finditer(clean):
        see, words, notes = modifiers(m[1])
        tail = m[4]
        extends, implements = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\Z)", tail, re.S), re.search(r"\bimplements\s+(.*)", tail, re.S)
        found, fields = members(text, clean, m.end(), closing(clean, m.end() - 1), m[3], path)
        functions += found
        interface, abstract = m[2] == "interface", "abstract" in words
        classes.append({
            "name": m[3], "kind": "interface" if interface else "abstract_class" if abstract else "class", "base_classes": split_types(extends[1]) if extends and not interface else [], "implemented_interfaces": split_types(implements[1]) if implements else [],
            "decorators": notes, "fields": fields, "methods": [f["name"] for f in found if f["kind"] == "method"], "visibility": None if see == "package" else see, "is_abstract": abstract, "start_line": text.count("\n", 0, m.start()) + 1, "end_line": text.count("\n", 0, closing(clean, m.end() - 1)) + 1,
            "doc": comment_before(text, m.start()), "file": path,
        })
    imports = []
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", clean, re.M):
        head, _, last = m[1].rpartition(".")
        imports.append({"module": head or last, "names": [last] if head and last != "*" else [], "alias": None, "is_wildcard": last == "*"})
    return {"functions": functions, "classes": classes, "imports": imports, "module_doc": None} if functions or classes or imports else None
