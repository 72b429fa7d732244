"""Asking a model: prompts in batches, answers cleaned, one more try for those that are missing.

The predictor is given by the caller: a factory, run once in each task, that returns a function from a list of prompts
to a list of answers or Nones. So a model is loaded once for a task, and a service is called with a task's batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.prompts import prompt, question_only
from .scoring import scored

Predict = Callable[[list[str]], list[str | None]]


def retrying(predict: Predict, tries: int = 3, wait: Callable[[float], None] | None = None) -> Predict:
    """predict, tried again with waits that double when it raises; Nones if it always does."""
    import time

    pause = wait or time.sleep

    def own(prompts: list[str]) -> list[str | None]:
        for k in range(tries):
            try:
                return predict(prompts)
            except Exception:  # noqa: BLE001  whatever a service raises
                if k + 1 < tries:
                    pause(2.0**k)
        return [None] * len(prompts)

    return own


def predicted(rows: DataFrame, make: Callable[[], Predict], batch: int = 8, again: Callable[[], Predict] | None = None) -> DataFrame:
    """rows with prediction; rows without prompt are not asked. again is asked once more for what is missing."""
    schema = rows.withColumn("prediction", F.lit(None).cast("string")).schema

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, second = make(), again() if again else None
        for part in batches:
            out: list[str | None] = [None] * len(part)
            for which in (ask, second):
                open_ = [k for k, (p, v) in enumerate(zip(part["prompt"], out)) if p is not None and v is None]
                for at in range(0, len(open_) if which else 0, batch):
                    some = open_[at : at + batch]
                    for k, v in zip(some, which([part["prompt"].iloc[k] for k in some])):
                        out[k] = v
            yield part.assign(prediction=out)

    found = rows.mapInPandas(work, schema)
    return found.withColumn("prediction", A.without_fence(A.without_markers(F.col("prediction"))))


def evaluated(questions: DataFrame, make: Callable[[], Predict], mode: str = "slice_context", **how) -> DataFrame:
    """questions with contexts (see prompts.prompt), asked and scored; answer is the truth."""
    context = F.coalesce("content", "from_content", "to_content").isNotNull()
    text = question_only(F.col("question")) if mode == "question_only" else prompt()
    asked = questions.withColumn("context_retrieved", context).withColumn("prompt", text).withColumn("ground_truth", F.col("answer"))
    return scored(predicted(asked, make, **how)).drop("prompt")


def echo() -> Predict:
    """A predictor for tests: the first line of each prompt."""
    return lambda prompts: [p.split("\n", 1)[0] for p in prompts]
