"""Exchange with answering services through tables.

A request table goes out, a response table comes back; both are keyed by the hash of the
prompt. Which service answers, and how it batches, is outside of Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.text import join_bytes, join_key, key_bytes, prompt_key


def request_table(rows: DataFrame, prompt: Column, suffix: str = "") -> DataFrame:
    """Distinct requests ``(prompt_key, prompt)``: equal prompts are answered once."""
    full = F.concat(prompt, F.lit(suffix))
    return rows.select(full.alias("prompt")).filter(F.col("prompt").isNotNull()).select(
        prompt_key(F.col("prompt")).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])


def attach_responses(rows: DataFrame, prompt: Column, responses: DataFrame, name: str = "reply",
                     suffix: str = "") -> DataFrame:
    """Add the reply to each row's prompt; unanswered prompts keep a null."""
    replies = responses.select(key_bytes(F.col("prompt_key")).alias("prompt_key"), F.col("text").alias(name))
    keyed = rows.withColumn("prompt_key", join_bytes(F.concat(prompt, F.lit(suffix)), *rows.columns))
    return keyed.join(replies, "prompt_key", "left").drop("prompt_key")


def answer_requests(requests: DataFrame, answer: Callable[[list[str]], list[str]],
                    batch: int = 100) -> DataFrame:
    """Response table from a caller's function over batches of prompts, run in the tasks."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                yield pd.DataFrame({"prompt_key": part["prompt_key"].to_numpy(),
                                    "text": answer(part["prompt"].tolist())})

    return requests.select("prompt_key", "prompt").mapInPandas(run, "prompt_key string, text string")


def attach_vectors(rows: DataFrame, text: str, vectors: DataFrame, name: str) -> DataFrame:
    """Add the vector of a text column; ``vectors`` is ``(text_key, vec)``."""
    keyed = rows.withColumn("text_key", join_key(F.col(text), *rows.columns))
    return keyed.join(vectors.withColumnRenamed("vec", name), "text_key", "left").drop("text_key")
