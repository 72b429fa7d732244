"""Documentation text: cleaning, roles of prepositions, assembling and filtering of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import text

#: Prepositions and conjunctions by role, and answers or subjects that say nothing.
TEMPORAL = ("after", "before", "when", "while", "during", "once", "until", "upon", "whenever", "following")
LOCATIVE = ("at", "in", "on", "into", "onto", "near", "beside", "within", "among", "along", "across", "inside", "outside", "between", "above", "below", "over", "under", "behind")
MANNER = ("using", "via", "through", "by")
CAUSE = ("since", "because")
PRONOUNS = ("it", "its", "they", "their", "them", "this", "that", "these", "those", "he", "she", "we", "you", "i")
GENERIC = ("the function", "the method", "the code", "this function", "this method", "this code", "the class", "this class", "it")
TAG, NOISE, PLACEHOLDER = r"<[a-zA-Z][^>]*>", r"\n|<[a-zA-Z/]", r"(?i)\b(?:the|this)\s+(?:function|method|class|code)\b"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def role(preposition: Column) -> Column:
    p = F.lower(preposition)
    return F.when(p.isin(*TEMPORAL), "temporal").when(p.isin(*LOCATIVE), "locative").when(p.isin(*MANNER), "manner")


def clean(c: Column) -> Column:
    """The first paragraph without quotes and examples; empty for markup, templates and f-strings."""
    t = F.regexp_replace(text(c), r"\A[\s\"' ]+|[\s\"' ]+\z", "")
    t = _strip(F.regexp_replace(t, r"(?m)^\s*>>>.*$", ""))
    prose = _strip(F.split(t, r"\n\s*\n", 2)[0])
    odd = t.rlike(TAG) | (F.regexp_count(t, F.lit(r"\{[a-zA-Z_]\w*\}")) >= 3) | t.rlike(r"\Af[\"']")
    return F.when(odd, "").otherwise(prose)


def split_auxiliary(c: Column) -> Column:
    """The first word of an auxiliary, "does" without any, and the rest."""
    words = F.split(_strip(c), r"\s+", 2)
    return F.struct(F.when(words[0] == "", "does").otherwise(words[0]).alias("first"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("rest"))


def assemble(*parts: Column) -> Column:
    """The parts that aren't blank as a question."""
    q = _strip(F.regexp_replace(F.array_join(F.filter(F.array(*map(_strip, parts)), lambda x: x != ""), " "), r"\s{2,}", " "))
    return F.when(q == "", "").otherwise(F.concat(F.upper(F.substring(q, 1, 1)), F.substring(q, F.lit(2), F.length(q)), F.lit("?")))


def gated(subtype: Column, question: Column, answer: Column, symbol: Column) -> Column:
    """The question with the symbol in place of "the function" and the like; null if question or answer is no good."""
    q = F.regexp_replace(text(question), F.lit(PLACEHOLDER), F.regexp_replace(symbol, r"([\\$])", r"\\$1"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    a = text(answer)
    good = (q != "") & (a != "") & ~q.rlike(NOISE) & ~a.rlike(NOISE) & ~q.contains("{") & ~a.contains("{") & (words(q) >= 4) & ((subtype == "yesno") | (words(a) >= 3))
    return F.when(good, q)


def quoted(c: Column) -> Column:
    """A string literal without its triple quotes."""
    t = _strip(text(c))
    return _strip(F.regexp_replace(t, r'\A(?:"""|\'\'\')|(?:"""|\'\'\')\z', ""))


def javadoc(c: Column) -> Column:
    """A comment without its marks and without the star that begins a line."""
    t = F.regexp_replace(_strip(text(c)), r"\A/\*\*|\*/\z", "")
    return _strip(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"\A\s*\*\s*", "")), "\n"))


def java_import(c: Column) -> Column:
    """Module, names and whether all names of an import statement; all names, or a bare module, list none."""
    t = _strip(F.regexp_replace(_strip(c), r"\A(?:import )?(?:static )?|;\z", ""))
    every, dotted = t.endswith(".*"), t.contains(".")
    module = F.when(dotted, F.regexp_replace(t, r"\.[^.]*\z", "")).otherwise(t)
    names = F.when(dotted & ~every, F.array(F.regexp_extract(t, r"([^.]*)\z", 1))).otherwise(F.array().cast("array<string>"))
    return F.struct(module.alias("module"), names.alias("names"), every.alias("is_wildcard"))
