"""Rows of the question-answer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import symbols as S

COLUMNS = ("qa_id", "repo", "qa_type", "qa_subtype", "question", "answer", "slice_id", "from_slice_id", "to_slice_id", "question_key", "evidence")


def qa_rows(df: DataFrame, qa_type: str, subtype: str, question: Column, answer: Column, name: Column, path: Column, *, kind: str, slice_id: Column | None = None, from_id: Column | None = None, to_id: Column | None = None, keyed: bool = False) -> DataFrame:
    """One row for each row of df; df has repo. The identifier hashes all but the question's key."""
    none = F.lit(None).cast("string")
    a, b, c = (none if x is None else x for x in (slice_id, from_id, to_id))
    path = S.text(path)
    key = F.concat_ws("||", F.col("repo"), F.lit(qa_type), F.lit(subtype), name, path) if keyed else none
    qa_id = S.stable_id(F.col("repo"), F.lit(qa_type), F.lit(subtype), question, answer, a, b, c, S.evidence_text(F.lit(kind), name, path))
    evidence = F.struct(F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"))
    return df.select(qa_id.alias("qa_id"), "repo", F.lit(qa_type).alias("qa_type"), F.lit(subtype).alias("qa_subtype"), question.alias("question"), answer.alias("answer"), a.alias("slice_id"), b.alias("from_slice_id"), c.alias("to_slice_id"), key.alias("question_key"), evidence.alias("evidence"))


def flat(qa: DataFrame) -> DataFrame:
    """The evidence as plain columns."""
    return qa.select(*COLUMNS[:-1], F.col("evidence.kind").alias("evidence_kind"), F.col("evidence.name").alias("evidence_name"), F.col("evidence.file_path").alias("evidence_path"))
