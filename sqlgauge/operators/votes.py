"""Combine the votes of several judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.scores import majority


def vote_counts(votes: DataFrame) -> DataFrame:
    """``(case_id, n_true, n_false, n_failed)`` of ``(case_id, judge_id, verdict)``."""
    v = F.col("verdict")
    return votes.groupBy("case_id").agg(
        F.count_if(v).alias("n_true"), F.count_if(~v).alias("n_false"),
        F.count_if(v.isNull()).alias("n_failed"))


def majority_vote(votes: DataFrame, runs: int = S.MAJORITY_RUNS) -> DataFrame:
    """Majority of the valid votes of the first ``runs`` judges; null when undecided."""
    counts = vote_counts(votes.filter(F.col("judge_id") < runs))
    return counts.withColumn("verdict", majority(F.col("n_true"), F.col("n_false")))


def unanimous_vote(votes: DataFrame, n_judges: int = S.UNANIMOUS_JUDGES) -> DataFrame:
    """True only if at least ``n_judges`` voted and all said true; a failed vote counts as false."""
    return votes.groupBy("case_id").agg(
        ((F.count_if("verdict") == F.count("*")) & (F.count("*") >= n_judges)).alias("verdict"))
