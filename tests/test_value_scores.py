"""Scores of values that are easily taken for each other, and the order of the comparison stages."""

import pytest

from sqlgauge.operators import resultsets as R

ROWS = "case_id long, side string, row_no long, cells array<struct<col:string,val:string>>"


@pytest.mark.parametrize("limits", [{}, {"fold_limit": 1}])
@pytest.mark.parametrize("gold, pred, want", [
    (["", "0"], ["0", "0"], 0.5), (["", ""], ["0", "0"], 0.0), (["", "0"], ["", "0"], 1.0), (["-1", ""], ["1", ""], 0.5),
])
def test_empty_texts_are_no_numbers(spark, gold, pred, want, limits):
    rows = [(1, side, i, [("a", v)]) for side, values in (("gold", gold), ("pred", pred)) for i, v in enumerate(values)]
    mapping = spark.createDataFrame([(1, "a", "a")], "case_id long, true_col string, pred_col string")
    counts = spark.createDataFrame([(1, 1)], "case_id long, n_gold_cols long")
    got = R.value_scores(spark.createDataFrame(rows, ROWS), mapping, counts, **limits).first()
    assert got["value_score"] == pytest.approx(want)


def test_a_failed_gold_run_comes_before_a_missing_result(spark):
    pairs = spark.createDataFrame([(1, "g", "p"), (2, "g", "p"), (3, "g", "p")], "case_id long, gold_sql string, pred_sql string")
    ok = spark.createDataFrame([(1, False, None), (2, None, False), (3, True, None)], "case_id long, gold_ok boolean, pred_ok boolean")
    got = R.staged_verdict(pairs, ok, spark.createDataFrame([], ROWS), dims=1).collect()
    assert {r["case_id"]: r["stage"] for r in got} == {1: "gold_failed", 2: "pred_failed", 3: "no_result"}
