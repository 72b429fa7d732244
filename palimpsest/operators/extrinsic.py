"""Questions from documentation: cleaned texts go through a sentence parser, its questions through the row gates.

The parser is given by the caller, as it needs a language model that is not part of this package; without one there are
no questions. It is called with a cleaned text and the kind of symbol and yields (subtype, question, answer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import docs as D
from .qa import qa_rows

Parser = Callable[[str, str], Iterable[tuple[str, str, str]]]
SUBTYPES = ("wh_object", "wh_xcomp", "wh_subject", "wh_temporal", "wh_locative", "wh_manner", "wh_cause", "wh_purpose", "yesno")
LEAST = 15


def questions(symbols: DataFrame, kind: str, parser: Parser | None) -> DataFrame:
    """symbols: repo, slice_id, ref, file_path, doc. One row for each question that passes the gates."""
    texts = symbols.select("repo", "slice_id", "ref", "file_path", D.clean(F.col("doc")).alias("doc")).filter(F.length("doc") >= LEAST)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row[:4], *found) for row in batch.itertuples(index=False) for found in (parser(row[4], kind) if parser else ())]
            yield pd.DataFrame(rows, columns=["repo", "slice_id", "ref", "file_path", "subtype", "question", "answer"])

    found = texts.mapInPandas(work, "repo string, slice_id string, ref string, file_path string, subtype string, question string, answer string")
    asked = found.withColumn("question", D.gated(F.col("subtype"), F.col("question"), F.col("answer"), F.col("ref"))).filter("question IS NOT NULL")
    parts = [qa_rows(asked.filter(F.col("subtype") == s), "extrinsic", s, F.col("question"), F.col("answer"), F.col("ref"), F.col("file_path"), kind=kind, slice_id=F.col("slice_id")) for s in SUBTYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
