"""Align the columns of two result sets by the similarity of their name vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge import settings as S
from sqlgauge.functions.scores import schema_score


def best_assignment(sim: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) with the largest total similarity.

    Augments along shortest paths with dual prices; every row of the shorter side gets a
    partner.
    """
    if sim.shape[0] > sim.shape[1]:
        return [(r, c) for c, r in best_assignment(sim.T)]
    n, m = sim.shape
    favourite = sim.argmax(axis=1)
    if len(set(favourite.tolist())) == n:  # nobody competes: everyone gets the best
        return list(enumerate(favourite.tolist()))
    cost = sim.max() - sim
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = np.full(m, np.inf)
        came_from = np.full(m, -1)
        open_cols = np.ones(m, dtype=bool)
        row, base, col = start, 0.0, -1
        while row != -1:
            reach = base + cost[row] - row_price[row] - col_price
            better = open_cols & (reach < dist)
            dist[better], came_from[better] = reach[better], col
            col = int(np.argmin(np.where(open_cols, dist, np.inf)))
            base, open_cols[col] = dist[col], False
            row = owner[col]
        closed = ~open_cols
        closed[col] = False
        shift = base - dist[closed]
        row_price[owner[closed]] += shift
        col_price[closed] -= shift
        row_price[start] += base
        while col != -1:
            previous = came_from[col]
            owner[col] = start if previous == -1 else owner[previous]
            col = previous
    return [(int(owner[c]), c) for c in range(m) if owner[c] != -1]


PAIR_TYPE = T.ArrayType(T.StructType([
    T.StructField("true_no", T.IntegerType()), T.StructField("pred_no", T.IntegerType()),
    T.StructField("sim", T.DoubleType())]))


@F.pandas_udf(PAIR_TYPE)
def _assign(true_vecs: pd.Series, pred_vecs: pd.Series) -> pd.Series:
    def pairs(true_rows, pred_rows):
        a = np.array([list(v) for v in true_rows], dtype="float64")
        b = np.array([list(v) for v in pred_rows], dtype="float64")
        if not a.size or not b.size:
            return []
        unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
        sim = unit(a) @ unit(b).T
        return [{"true_no": r, "pred_no": c, "sim": float(sim[r, c])}
                for r, c in best_assignment(sim) if sim[r, c] > S.COLUMN_MATCH_SIM]

    return pd.Series([pairs(a, b) for a, b in zip(true_vecs, pred_vecs)], dtype="object")


def align_columns(columns: DataFrame) -> DataFrame:
    """``(case_id, true_col, pred_col, sim)`` of the best assignment above the threshold.

    ``columns``: case_id, side, col_no, col, vec; a column without a vector is matched with nothing. Cases with
    the same pair of schemas share one assignment. A group holds the columns of one case, so its size is bounded
    by the width of a result, not by the data.
    """
    def listed(side: str):
        return F.array_sort(F.collect_list(F.when(
            F.col("side") == side, F.struct("col_no", "col", "vec"))))

    cases = columns.where("vec is not null").groupBy("case_id").agg(
        listed("gold").alias("gold"), listed("pred").alias("pred"))
    # 128 bits name a pair of schemas
    cases = cases.withColumns({"_k": F.xxhash64("gold", "pred"), "_l": F.xxhash64(F.lit(1), "pred", "gold")})
    vecs = lambda c: F.transform(c, lambda x: x["vec"].cast("array<double>"))
    schemas = cases.dropDuplicates(["_k", "_l"]).select(
        "_k", "_l", "gold", "pred", F.inline(_assign(vecs("gold"), vecs("pred"))).alias("t", "p", "sim"))
    pairs = schemas.groupBy("_k", "_l").agg(F.collect_list(F.struct(
        F.get("gold", "t")["col"].alias("true_col"), F.get("pred", "p")["col"].alias("pred_col"), "sim")).alias("pairs"))
    return cases.select("case_id", "_k", "_l").join(pairs, ["_k", "_l"]).select("case_id", F.inline("pairs"))


def schema_scores(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(case_id, n_gold_cols, n_pred_cols, schema_score)``."""
    widths = columns.groupBy("case_id").agg(
        F.count_if(F.col("side") == "gold").alias("n_gold_cols"),
        F.count_if(F.col("side") == "pred").alias("n_pred_cols"))
    sums = mapping.groupBy("case_id").agg(F.sum("sim").alias("sim_sum"))
    score = schema_score(F.coalesce("sim_sum", F.lit(0.0)), F.col("n_gold_cols"), F.col("n_pred_cols"))
    return widths.join(sums, "case_id", "left").select(
        "case_id", "n_gold_cols", "n_pred_cols", score.alias("schema_score"))
