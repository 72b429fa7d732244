"""Prompts for a model: templates, hints on the form of an answer, and the choice among them as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import LANGUAGES, text

# --- fixed values: templates and hints -------------------------------------------------------------------------
INTRINSIC = """\
You are a code analysis assistant. Given the source code of a file, answer the \
question precisely and concisely.

File: {file_path}
```{lang}
{content}
```

Question: {question}

{format_hint}"""
MULTIFILE = """\
You are a code analysis assistant. Given the source code of several files from \
the same codebase, answer the question precisely.

Primary file:
File: {file_path}
```{lang}
{content}
```
{related_sections}
Question: {question}

{format_hint}"""
RELATED = """\
Related file:
File: {file_path}
```{lang}
{content}
```
"""
HINTS = {
    "function_parameters": (
        "Answer with only the parameter list in parentheses exactly as it appears in the "
        "function definition, e.g. `(x, y)` or `(x: int, y: str = 'default')`. "
        "Do NOT include `def`, the function name, `->`, or the return type."
    ),
    "symbol_callers": (
        "Answer with only the bare method/function names this function calls internally, "
        "comma-separated. Use the unqualified name only — do NOT include the class or "
        "object prefix (e.g. write `sort` not `Collections.sort`, write `run` not "
        "`SpringApplication.run`). "
        "If the function calls nothing, answer `none`. No extra explanation."
    ),
    "object_instantiations": (
        "Answer with only the class name(s) instantiated inside this function, "
        "comma-separated (e.g. `Foo, Bar`). Include classes raised as exceptions "
        "(e.g. `raise HTTPException(...)` counts as `HTTPException`). "
        "If none, answer `none`. No extra explanation."
    ),
    "field_accesses": (
        "Answer with only the dotted-access expressions this function uses, comma-separated. "
        "Include all patterns of the form `obj.attr` or `obj.method` (e.g. `self.x`, `results.update`, `commons.q`). "
        "Do NOT include the call parentheses. If none, answer `none`. No extra explanation."
    ),
    "symbol_location": "Answer with only the file path where the symbol is defined. No explanation.",
    "class_inheritance": (
        "Answer with only the base class name(s), comma-separated (use the full name as written "
        "in the class definition, e.g. `routing.WebSocketRoute`). "
        "If none, answer `none`. Do not leave blank."
    ),
    "class_fields": "Answer with only the field/attribute names, comma-separated. No explanation.",
    "class_subclasses": (
        "Answer with only the subclass name(s) visible in the provided files, "
        "comma-separated (e.g. `Foo, Bar`). "
        "If no subclass is shown in the provided source files, answer `none`. No explanation."
    ),
    "class_instantiation_sites": (
        "Answer with only the methods that instantiate this class, in `ClassName.methodName` "
        "format, comma-separated (e.g. `MyFactory.create, Builder.build`). "
        "If none are visible in the provided source files, answer `none`. No explanation."
    ),
}
SIGNATURE_HINTS = {
    "java": (
        "Answer with the full method signature in this exact format: "
        "`<modifiers> <ReturnType> <MethodName>(<paramName: ParamType, ...>) -> <ReturnType>:` "
        "(e.g. `public void doThing(input: String) -> void:` or "
        "`public static List<Foo> getAll(id: int) -> List<Foo>:`). "
        "Use the exact Java modifiers, return type, and type names from the source. "
        "Parameters use `name: Type` order (name first, colon, then type). "
        "For constructors, use `<modifiers> <ClassName>(<params>):` with no `->` section. "
        "Do NOT use Python `def` syntax. Do NOT wrap in code blocks."
    ),
    "python": (
        "Answer with only the `def` or `async def` line itself (include `async` if the "
        "function is async). Do NOT include decorators. Do not wrap in code blocks. "
        "You MUST provide the full signature line — do not leave blank."
    ),
    "": (
        "Answer with the full method/function signature line as it appears in the source. "
        "Do NOT include the body, decorators, or annotations. Do not wrap in code blocks. "
        "You MUST provide the full signature line — do not leave blank."
    ),
}
DEFAULT_HINT = (
    "Answer with the exact text only. No explanation, no markdown formatting. "
    "Do not wrap the answer in code blocks."
)
EXTRINSIC_HEAD = """\
You are a code documentation assistant. Answer the question based solely on \
the docstrings and comments found in the source code below.

File: {file_path}
```python
{content}
```

Question: {question}

"""
EXTRINSIC = EXTRINSIC_HEAD + "Answer concisely based on what the documentation says. Do not elaborate beyond what the docs state. If no relevant docstring or comment is found, answer `[no documentation]`."
EXTRINSIC_YESNO = EXTRINSIC_HEAD + 'Answer with only "Yes" or "No". No explanation.'
VERSIONS = """\

=== Version A ({from_version}) ===
File: {file_path}
```python
{from_content}
```

=== Version B ({to_version}) ===
File: {file_path}
```python
{to_content}
```

Question: {question}

"""
TWO = "You are a code evolution analyst. Two versions of a source file are provided.\n"
YESNO = "You are a code evolution analyst. Two versions of a source file are provided. Determine whether the described change occurred between them.\n" + VERSIONS + 'Answer only with "Yes" or "No". You MUST provide an answer — do not leave it blank. No explanation, no markdown.'
CHANGED = TWO + VERSIONS + "Answer in the exact format: `from: <old value> ; to: <new value>`\nUse the exact signature/type/value as it appears in the code. No extra explanation."
CALLS_CHANGED = TWO + VERSIONS + (
    "Compare the set of functions/methods called inside the named function between the two versions.\n"
    "Answer using ONLY this exact format: `added: f1, f2; removed: f3`\n"
    'Omit "added: ..." if no calls were added. Omit "removed: ..." if no calls were removed.\n'
    "Use bare names only (no class/object prefix). No extra explanation."
)
RETURNS_CHANGED = TWO + VERSIONS + "Answer in the exact format: `from: <old value> ; to: <new value>`\nIf a return type is not annotated in the code, write `unknown` for that side. No extra explanation."
SNAPSHOT = """\
You are a code evolution analyst. The source file snapshot shown below is from \
the exact version where the described change boundary occurred — either the \
first version where the symbol was introduced, or the last version where it was \
still present.

=== Snapshot ({from_version}) ===
File: {file_path}
```{lang}
{from_content}
```

Question: {question}

Answer with only the version string shown in the snapshot header above \
(e.g. `v2.2.15`). Do not leave blank, no other explanation."""
EVOLUTION = """\
You are a code evolution analyst. Two file snapshots spanning a version range are provided.

=== Earliest snapshot ({from_version}) ===
File: {file_path}
```python
{from_content}
```

=== Latest snapshot ({to_version}) ===
File: {file_path}
```python
{to_content}
```

Question: {question}

Answer in the format: `<version>: <value> -> <version>: <value> -> ...`
List each distinct value with the version it first appeared. No extra explanation."""
MISSING, UNAVAILABLE = "# [File did not exist in this version]", "[context unavailable]"
YESNO_SUBTYPES = ("function_introduced", "function_not_introduced", "function_removed", "function_not_removed", "function_signature_unchanged", "function_return_type_unchanged", "class_introduced", "class_not_introduced", "class_removed", "class_not_removed", "class_inheritance_unchanged")
CHANGED_SUBTYPES = ("function_signature_changed", "function_return_type_changed", "class_inheritance_changed", "function_instantiations_changed")
VERSION_SUBTYPES = ("function_first_introduced", "function_last_present", "class_first_introduced", "class_last_present")


# --- expressions -----------------------------------------------------------------------------------------------
def filled(template: str, **values: Column) -> Column:
    """The template with its names replaced, each by a column; braces in the values stay as they are."""
    import re

    parts = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            parts.append(values[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def fence(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    out = F.lit("")
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def hint(subtype: Column, lang: Column) -> Column:
    out = F.lit(DEFAULT_HINT)
    for s, h in HINTS.items():
        out = F.when(subtype == s, h).otherwise(out)
    own = F.lit(SIGNATURE_HINTS[""])
    for name in ("python", "java"):
        own = F.when(lang == name, SIGNATURE_HINTS[name]).otherwise(own)
    return F.when(subtype == "function_signature", own).otherwise(out)


def question_only(question: Column) -> Column:
    return question


def prompt() -> Column:
    """The prompt of a row with qa_type, qa_subtype, question, file_path, content, from_/to_content, from_/to_version
    and related_contents; null if there is no source text at all."""
    c = F.col
    some = lambda x: F.when(text(x) != "", x).otherwise(MISSING)
    path, question, subtype, lang = text(c("file_path")), c("question"), text(c("qa_subtype")), fence(text(c("file_path")))
    both = {"from_version": F.coalesce(c("from_version"), F.lit("version A")), "to_version": F.coalesce(c("to_version"), F.lit("version B")), "file_path": path, "from_content": some(c("from_content")), "to_content": some(c("to_content")), "question": question}
    one = {"file_path": path, "lang": lang, "content": some(c("content")), "question": question, "format_hint": hint(subtype, lang)}
    sections = F.array_join(F.transform(c("related_contents"), lambda r: filled(RELATED, file_path=r["file_path"], lang=fence(r["file_path"]), content=r["content"])), "")
    temporal = (
        F.when(subtype.isin(*YESNO_SUBTYPES), filled(YESNO, **both)).when(subtype == "function_calls_changed", filled(CALLS_CHANGED, **both)).when(subtype == "function_return_type_changed", filled(RETURNS_CHANGED, **both))
        .when(subtype.isin(*CHANGED_SUBTYPES), filled(CHANGED, **both)).when(subtype.isin(*VERSION_SUBTYPES), filled(SNAPSHOT, lang=lang, **{**both, "from_version": F.coalesce(c("from_version"), F.lit("unknown version"))})).otherwise(filled(EVOLUTION, **both))
    )
    extrinsic = F.when(subtype == "yesno", filled(EXTRINSIC_YESNO, **one)).otherwise(filled(EXTRINSIC, **one))
    intrinsic = F.when(F.coalesce(F.size("related_contents"), F.lit(0)) > 0, filled(MULTIFILE, related_sections=sections, **one)).otherwise(filled(INTRINSIC, **one))
    return (
        F.when((c("qa_type") == "temporal") & (c("from_content").isNotNull() | c("to_content").isNotNull()), temporal).when(c("qa_type") == "temporal", F.lit(None).cast("string"))
        .when(c("content").isNull(), F.lit(None).cast("string")).when(c("qa_type") == "extrinsic", extrinsic).otherwise(intrinsic)
    )
