"""The boundary to a language model: a function from prompts to replies, called once per row in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ModelFunction = Callable[[str], str]


def offline_reply(prompt: str) -> str:
    """A deterministic stand-in: a JSON object for index prompts, a score list for rating prompts, else an echo."""
    import json
    import re

    first = next((line for line in prompt.splitlines() if line.strip()), "")
    if prompt.startswith("Rate"):
        ids = [int(x) for x in re.findall(r"^\[(\d+)\]", prompt, re.M)]
        return json.dumps([{"id": i, "score": (7 * i + len(prompt)) % 11} for i in ids])
    if prompt.startswith(("Describe", "Outline")):
        return json.dumps({"title": f"Section of {len(prompt)} characters", "summary": " ".join(prompt.split()[-12:])}, ensure_ascii=False)
    return first[:200]


def model_column(model: ModelFunction = offline_reply) -> Callable[[Column], Column]:
    """A column function that asks ``model``; a failing call gives null. Nondeterministic, so the planner neither repeats nor moves it."""

    @F.pandas_udf("string")
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            replies = []
            for prompt in batch:
                try:
                    replies.append(None if prompt is None else model(prompt))
                except Exception:
                    replies.append(None)
            yield pd.Series(replies, dtype=object)

    return call.asNondeterministic()


def with_reply(df: DataFrame, prompt: str, reply: str, model: ModelFunction = offline_reply) -> DataFrame:
    """``df`` with a column of replies, materialised so that no later use asks again."""
    from paperloom.session import cut_lineage

    return cut_lineage(df.withColumn(reply, model_column(model)(F.col(prompt))))
