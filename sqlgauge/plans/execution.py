"""Evidence from running statements: pairs of gold and predicted SQL, their outcomes and result rows.

A pair is worked out once, however many rows of a corpus hold it, and a statement is run once, however many
pairs it is part of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions.text import prompt_key
from sqlgauge.session import materialize
from sqlgauge.sources import runner


@dataclass(frozen=True)
class PairRuns:
    """``pairs``: case_id, gold_sql, pred_sql. ``outcomes``: case_id, gold_ok, pred_ok. ``rows``: result rows."""

    pairs: DataFrame
    outcomes: DataFrame
    rows: DataFrame


def pair_id(gold: Column, pred: Column) -> Column:
    """Name of a pair of texts."""
    return F.sha2(F.concat(F.length(gold).cast("string"), F.lit(":"), gold, pred), 256)


def with_pair(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.withColumn("case_id", pair_id(F.col(gold), F.col(pred)))


def run_pairs(session: SparkSession, rows: DataFrame, gold: str = "gold", pred: str = "pred",
              same_text: bool = False, **options) -> PairRuns:
    """Run both statements of each different pair of ``rows`` (with ``case_id`` of ``with_pair``).

    Pairs of one text need no run unless ``same_text`` asks for their results. A result that many pairs share
    is repeated for each of them; a failed statement has no rows.
    """
    pairs = materialize(rows.select("case_id", F.col(gold).alias("gold_sql"), F.col(pred).alias("pred_sql"))
                        .dropDuplicates(["case_id"]), "pairs")
    asked = pairs if same_text else pairs.where("gold_sql <> pred_sql")
    sides = asked.select("case_id", F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_sql").alias("sql")) for side in ("gold", "pred")])))
    sides = materialize(sides.select("case_id", "side", "sql", prompt_key(F.col("sql")).alias("sql_key")), "sides")
    corpus = runner.run_statements(session, runner.statement_table(sides, "sql"), **options)
    ran = sides.drop("sql").join(corpus.outcomes.select("sql_key", "ok"), "sql_key", "left")
    ok = lambda side: F.bool_or(F.when(F.col("side") == side, F.col("ok")))
    outcomes = ran.groupBy("case_id").agg(ok("gold").alias("gold_ok"), ok("pred").alias("pred_ok"))
    found = sides.select("case_id", "side", "sql_key").join(corpus.rows, "sql_key").select(
        "case_id", "side", "row_no", "cells")
    return PairRuns(pairs, materialize(outcomes, "pair-outcomes"), materialize(found, "pair-rows"))


def validity(session: SparkSession, rows: DataFrame, sql: str, **options) -> DataFrame:
    """``(sql_key, valid)`` of the distinct statements of a column: names, types and arity, nothing is run."""
    corpus = runner.run_statements(session, runner.statement_table(rows, sql), execute=False, **options)
    return corpus.outcomes.select("sql_key", F.col("ok").alias("valid"))
