"""Column functions over symbols: visibility, references, parameters, signatures, keys, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that belong to tests.
TEST_PATH = r"(?i)(?:^|[/\\])tests?[/\\]|(?:^|[/\\])test_|_tests?\.py$|[/\\]src[/\\]test[/\\]|Test\.java$|Tests\.java$"
#: Paths that a source walk leaves out.
WALK_SKIPS = ("test/", "tests/", "/test_", "_test.")
#: Languages by suffix.
LANGUAGES = {".py": "python", ".java": "java"}


def blank(c: Column, default: Column) -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.when(c != "", c), default)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_test_path(path: Column) -> Column:
    return text(path).rlike(TEST_PATH)


def walked(path: Column) -> Column:
    """Whether a source walk reads the path: no part starts with a dot, nothing looks like a test."""
    low = F.lower(path)
    out = ~path.rlike(r"(^|/)\.")
    for x in WALK_SKIPS:
        out = out & ~low.contains(x)
    return out


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    out = F.lit(None).cast("string")
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def public_function(visibility: Column, name: Column) -> Column:
    return F.when(text(visibility) != "", F.lower(visibility) == "public").otherwise(~text(name).startswith("_"))


def public_class(visibility: Column) -> Column:
    return F.when(visibility.isNull(), True).otherwise(F.lower(visibility) == "public")


def public_api(lang: Column, is_class: Column, visibility: Column, container: Column, name: Column) -> Column:
    """What counts for API breaks: Python names without underscore, public Java functions, all Java classes."""
    python = ~text(name).startswith("_") & ~text(container).startswith("_")
    return F.when(lang == "python", python).when(lang == "java", is_class | (F.lower(text(visibility)) == "public")).otherwise(False)


def symbol_ref(container: Column, name: Column) -> Column:
    return F.when(text(container) != "", F.concat(container, F.lit("."), text(name))).otherwise(text(name))


def format_params(params: Column) -> Column:
    one = lambda p: F.concat(text(p["name"]), F.when(text(p["type_annotation"]) != "", F.concat(F.lit(": "), p["type_annotation"])).otherwise(""), F.when(p["default_value"].isNotNull(), F.concat(F.lit(" = "), p["default_value"])).otherwise(""))
    return F.concat(F.lit("("), F.coalesce(F.array_join(F.transform(params, one), ", "), F.lit("")), F.lit(")"))


def complete_signature(signature: Column, params: Column, return_type: Column) -> Column:
    sig = text(signature)
    cut = F.regexp_replace(F.substring_index(sig, "(", 1), r"\s+\z", "")
    made = F.concat(cut, params, F.when(text(return_type) != "", F.concat(F.lit(" -> "), return_type)).otherwise(""), F.lit(":"))
    return F.when(sig.rlike(r":\s*\z"), sig).otherwise(made)


def joined_key(*parts: Column) -> Column:
    return F.concat_ws("|", *map(text, parts))


def version_label(tag: Column, slice_id: Column) -> Column:
    return blank(tag, slice_id)


def list_text(values: Column) -> Column:
    """A list of strings as Python writes it."""
    def item(x: Column) -> Column:
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(values, item), ", "), F.lit("")), F.lit("]"))


def json_text(c: Column) -> Column:
    """A JSON string with only what must be escaped."""
    out = text(c)
    escaped = F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for k in range(32):
        name = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(k, f"\\u{k:04x}")
        escaped = F.replace(escaped, F.lit(chr(k)), F.lit(name))
    return F.concat(F.lit('"'), F.when(out.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(out), F.lit('"'))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *map(text, parts)).cast("binary")), 1, 16)


def evidence_text(kind: Column, name: Column, path: Column) -> Column:
    return F.concat(F.lit('{"file_path": '), json_text(path), F.lit(', "kind": '), json_text(kind), F.lit(', "name": '), json_text(name), F.lit("}"))


def first_sentence(c: Column) -> Column:
    t = F.trim(text(c))
    return F.trim(F.when(t.contains(". "), F.substring_index(t, ". ", 1)).when(t.contains("。"), F.substring_index(t, "。", 1)).otherwise(F.substring_index(t, "\n", 1)))
