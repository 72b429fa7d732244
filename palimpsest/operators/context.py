"""Source text for a question: at a point, at both ends of a change, at the boundary of a presence, nearby, related.

Files by snapshot are a table (repo, slice_idx, file_path, content). All look-ups are equi-joins on repo and path, so a
file's snapshots meet in one place and the nearest is a minimum or maximum over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a file, tries of a nearby look-up, related files and the least each may have.
MAX_CHARS, TRIES, RELATED, LEAST_RELATED = 16_000, 8, 6, 2000
#: Subtypes whose related files are added, that look nearby, and that look for the end of a presence.
CROSS_FILE = {"class_subclasses": "base_classes", "class_instantiation_sites": "instantiations"}
EVOLUTION = ("function_signature_evolution", "function_return_type_evolution")
INTRODUCED, LAST = ("function_first_introduced", "class_first_introduced"), ("function_last_present", "class_last_present")
CUT, LED = "\n# [truncated]", "# [...leading content omitted...]\n"


def around(content: Column, symbol: Column, window: int = MAX_CHARS) -> Column:
    """A text of at most the window as it is, else the part around the symbol's definition, or the start."""
    name = F.element_at(F.split(symbol, r"\."), -1)
    at = F.instr(content, F.concat(F.lit("def "), name, F.lit("("))) - 1
    size = F.length(content)
    start, end = F.greatest(F.lit(0), at - window // 4), F.least(size, at + window * 3 // 4)
    middle = F.concat(F.when(start > 0, LED).otherwise(""), F.substring(content, start + 1, end - start), F.when(end < size, CUT).otherwise(""))
    head = F.concat(F.substring(content, 1, window), F.lit(CUT))
    return F.when(size <= window, content).when(symbol.isNull() | (symbol == ""), head).when(at < 0, head).otherwise(middle)


def point(questions: DataFrame, files: DataFrame, at: str = "slice_idx", name: str = "content", window: int = MAX_CHARS) -> DataFrame:
    """questions (repo, file_path, symbol and the snapshot column) with the file's text there, null if it isn't there."""
    own = files.select("repo", F.col("slice_idx").alias(at), "file_path", F.col("content").alias("_text"))
    return questions.join(own, ["repo", at, "file_path"], "left").withColumn(name, around(F.col("_text"), F.col("symbol"), window)).drop("_text")


def pair(questions: DataFrame, files: DataFrame, window: int = MAX_CHARS) -> DataFrame:
    """Texts at from_idx and to_idx."""
    return point(point(questions, files, "from_idx", "from_content", window), files, "to_idx", "to_content", window)


def nearest(questions: DataFrame, files: DataFrame, key: list[str], low: Column, high: Column, first: bool | Column) -> DataFrame:
    """For each question the first or last snapshot of its file within [low, high]: found_idx and text, null if none.

    first is the same for all, or a column of q. The join is by repo and path; a file's snapshots are few, and the bounds are part of the join.
    """
    q, f = questions.alias("q"), files.select("repo", "file_path", "slice_idx", "content").alias("f")
    meets = (F.col("q.repo") == F.col("f.repo")) & (F.col("q.file_path") == F.col("f.file_path")) & (F.col("f.slice_idx") >= low) & (F.col("f.slice_idx") <= high)
    row, order = F.struct(F.col("f.slice_idx").alias("found_idx"), F.col("f.content").alias("text")), F.col("f.slice_idx")
    best = F.min_by(row, F.when(first, order).otherwise(-order)) if isinstance(first, Column) else (F.min_by if first else F.max_by)(row, order)
    found = q.join(f, meets).groupBy(*(F.col(f"q.{k}") for k in key)).agg(best.alias("_found"))
    return questions.join(found.select(*key, "_found.found_idx", "_found.text"), key, "left")


def boundary(questions: DataFrame, files: DataFrame, key: list[str], first: bool) -> DataFrame:
    """The first or last snapshot between from_idx and to_idx that holds the file; no cap."""
    return nearest(questions, files, key, F.col("q.from_idx"), F.col("q.to_idx"), first)


def fallback(questions: DataFrame, files: DataFrame, key: list[str], at: str, forward: bool, tries: int = TRIES) -> DataFrame:
    """The nearest snapshot that holds the file, at the anchor or up to tries - 1 later (or earlier) ones."""
    anchor = F.col(f"q.{at}")
    low, high = (anchor, anchor + tries - 1) if forward else (anchor - tries + 1, anchor)
    return nearest(questions, files, key, low, high, forward)


def related_paths(questions: DataFrame, symbols: DataFrame, edges: str, key: list[str]) -> DataFrame:
    """questions (repo, slice_idx, name, file_path) with the other files whose symbols name it, in order of the scan.

    related holds the first RELATED, n_related counts all.
    """
    flat = symbols.select("repo", "slice_idx", "ord", F.col("file_path").alias("path"), F.explode(edges).alias("name"))
    files = flat.groupBy("repo", "slice_idx", "name", "path").agg(F.min("ord").alias("ord"))
    q = questions.alias("q")
    own = q.join(files.alias("f"), ["repo", "slice_idx", "name"]).filter((F.col("f.path") != F.col("q.file_path")) & (F.col("f.path") != ""))
    lists = own.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
    out = questions.join(lists, key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("n_related", F.coalesce(F.size("paths"), F.lit(0))).withColumn("related", F.slice(F.coalesce("paths", empty), 1, RELATED)).drop("paths")


def related_texts(questions: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """related files' texts, each cut to an equal part of MAX_CHARS of all that are related, at least LEAST_RELATED."""
    each = questions.select(*key, "repo", "slice_idx", "n_related", F.posexplode("related").alias("pos", "path"))
    budget = F.greatest(F.lit(LEAST_RELATED), F.floor(MAX_CHARS / F.greatest("n_related", F.lit(1)))).cast("int")
    own = files.select("repo", "slice_idx", F.col("file_path").alias("path"), "content")
    found = each.join(own, ["repo", "slice_idx", "path"]).filter("content <> ''").withColumn("content", F.substring(around(F.col("content"), F.lit("")), F.lit(1), budget))
    lists = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "content"))), lambda x: F.struct(x["path"].alias("file_path"), x["content"].alias("content"))).alias("related_contents"))
    return questions.join(lists, key, "left")


def chronological(slices: DataFrame) -> DataFrame:
    """repo, slice_id, slice_idx, version of each snapshot: places by the date that ends the identifier, equal dates by
    the whole of it; the tag, or the identifier where there is none."""
    own = Window.partitionBy("repo").orderBy(F.element_at(F.split("slice_id", "_"), -1), "slice_id")
    tag = F.when(F.col("version_tag") != "", F.col("version_tag"))
    return slices.select("repo", "slice_id", (F.row_number().over(own) - 1).alias("slice_idx"), F.coalesce(tag, "slice_id").alias("version"))


def routed(questions: DataFrame, files: DataFrame, slices: DataFrame, classes: DataFrame | None = None, functions: DataFrame | None = None, key: str = "qa_id", window: int = MAX_CHARS) -> DataFrame:
    """questions with the context that their type and subtype ask for.

    questions (key, repo, qa_type, qa_subtype, file_path, symbol, slice_id, from_slice_id, to_slice_id; key is unique),
    files (repo, slice_id, file_path, content), slices (repo, slice_id, version_tag), and for related files the symbols
    (repo, slice_id, ord, file_path and the names they refer to). Temporal questions get from_content, from_version,
    to_content and to_version: at both ends of the change; for an evolution the nearest of TRIES snapshots inwards; for a
    first or last presence the first or last snapshot in the range, as from_content only. Others get content and version,
    those of CROSS_FILE also related_contents. context_retrieved: whether there is any text. What isn't found is null,
    but the versions of both ends are those of the question; an unknown snapshot has no text.
    """
    places = chronological(slices)
    texts = files.join(places, ["repo", "slice_id"]).select("repo", "slice_idx", "file_path", "content")

    def placed(q: DataFrame, at: str, to: str) -> DataFrame:
        return q.join(places.select("repo", F.col("slice_id").alias(at), F.col("slice_idx").alias(f"{to}_idx"), F.col("version").alias(f"{to}_label")), ["repo", at], "left").withColumn(f"{to}_label", F.coalesce(f"{to}_label", at))

    q = questions.select(key, "repo", "qa_type", "qa_subtype", "file_path", "symbol", "slice_id", "from_slice_id", "to_slice_id")
    for at, to in (("slice_id", "at"), ("from_slice_id", "from"), ("to_slice_id", "to")):
        q = placed(q, at, to)
    temporal = F.coalesce(F.col("qa_type") == "temporal", F.lit(False))
    is_in = lambda names: F.coalesce(F.col("qa_subtype").isin(*names), F.lit(False))
    q = q.withColumns({"temporal": temporal, "ends": temporal & is_in(INTRODUCED + LAST), "evolves": temporal & is_in(EVOLUTION), "forward": ~(temporal & is_in(LAST))})
    more = F.when(F.col("evolves"), TRIES - 1).otherwise(0)
    q = q.withColumns({"low": F.when(F.col("temporal"), F.col("from_idx")).otherwise(F.col("at_idx")), "high": F.when(~F.col("temporal"), F.col("at_idx")).when(F.col("ends"), F.col("to_idx")).otherwise(F.col("from_idx") + more)})
    q = q.withColumns({"to_low": F.when(F.col("temporal") & ~F.col("ends"), F.col("to_idx") - more), "to_high": F.col("to_idx")})

    def found(q: DataFrame, low: str, high: str, first: bool | Column, to: str) -> DataFrame:
        labels = places.select("repo", F.col("slice_idx").alias("found_idx"), F.col("version").alias(f"{to}_found"))
        out = nearest(q, texts, [key], F.col(f"q.{low}"), F.col(f"q.{high}"), first).join(labels, ["repo", "found_idx"], "left")
        return out.withColumn(f"{to}_text", around(F.col("text"), F.col("symbol"), window)).drop("text", "found_idx")

    q = found(found(q, "low", "high", F.col("q.forward"), "main"), "to_low", "to_high", False, "end")
    here, change = ~F.col("temporal"), F.col("temporal") & ~F.col("ends")
    q = q.withColumns({
        "content": F.when(here, F.col("main_text")), "version": F.when(here, F.col("at_label")), "from_content": F.when(F.col("temporal"), F.col("main_text")), "to_content": F.when(change, F.col("end_text")),
        "from_version": F.when(F.col("ends"), F.col("main_found")).when(change, F.coalesce("main_found", "from_label")), "to_version": F.when(change, F.coalesce("end_found", "to_label")),
    })
    new = ["content", "version", "from_content", "from_version", "to_content", "to_version"]
    out = questions.join(q.select(key, *new), key)
    related = None
    for (subtype, edges), symbols in zip(CROSS_FILE.items(), (classes, functions)):
        if symbols is not None:
            asked = q.filter(here & (F.col("qa_subtype") == subtype) & F.col("at_idx").isNotNull()).select(key, "repo", F.col("at_idx").alias("slice_idx"), F.col("symbol").alias("name"), "file_path")
            own = related_paths(asked, symbols.drop("slice_idx").join(places.drop("version"), ["repo", "slice_id"]), edges, [key])
            own = related_texts(own, texts, [key]).select(key, "related_contents")
            related = own if related is None else related.unionByName(own)
    none = F.lit(None).cast("array<struct<file_path:string,content:string>>")
    out = out.withColumn("related_contents", none) if related is None else out.join(related, key, "left")
    empty = F.array().cast("array<struct<file_path:string,content:string>>")
    return out.withColumn("related_contents", F.coalesce("related_contents", empty)).withColumn("context_retrieved", retrieved(F.col("content"), F.col("from_content"), F.col("to_content")))


def retrieved(*contents: Column) -> Column:
    return F.coalesce(*contents).isNotNull()
