"""Helpers of the corpus operators: written tables, row places, joins that a hot key cannot unbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.session import materialize

#: One word, and one run of white space, as the contracts of these operators define them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Texts that a Python worker gets at once; Spark's default of 10,000 is meant for short values.
TEXTS_AT_ONCE = 1_000

__all__ = ["WORD", "SPACE", "table", "whole_texts", "materialize", "with_place", "attach_spread", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs`` itself, after the session has been told to hand fewer rows at once to Python (unless it was told
    another number already), so that a worker's memory follows the length of the texts and not a row count."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(TEXTS_AT_ONCE))
    return docs


def with_place(df: DataFrame) -> DataFrame:
    """Add ``_rid`` (unique per row) and ``_part`` (the task that read it). Write the result before using
    them: they are only fixed once written."""
    return df.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_rid", 33))


def attach_spread(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` (with ``_part``) with ``found``, which has one row for each key.

    A key may hold any share of the rows. The keys of each part are reduced to one row first, so a key meets
    ``found`` at most once per part, and the rows of a key meet their answer part by part.
    """
    asked = rows.select("_part", *keys).distinct()
    answers = asked.join(found, keys)
    return rows.join(answers, ["_part", *keys], "left")
