"""First-fit matching against brute force, in all three ways of playing it through."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import matching as M
from sqlgauge.operators import resultsets as R
from sqlgauge.operators.alignment import best_assignment

SCHEMA = "case_id int, side string, pos bigint, block string, vec array<double>"


def brute(rows, near):
    hits, cases = {}, {r[0] for r in rows}
    for case in cases:
        left = sorted((r[2:] for r in rows if r[0] == case and r[1] == "left"))
        right = sorted((r[2:] for r in rows if r[0] == case and r[1] == "right"))
        n = 0
        for _, block, vec in left:
            for i, (_, other, wec) in enumerate(right):
                if block == other and all(near(x, np.array([y]))[0] for x, y in zip(vec, wec)):
                    del right[i]
                    n += 1
                    break
        hits[case] = n
    return hits


def make_rows(seed, dims, step, n=60):
    rnd = random.Random(seed)
    rows = []
    for case in range(6):
        for side in ("left", "right"):
            for pos in rnd.sample(range(1000), n):
                vec = [rnd.choice((-1, 1, 1)) * (100 + rnd.randrange(25) * step) for _ in range(dims)]
                rows.append((case, side, pos, rnd.choice(("", "b")), vec))
    return rows


@pytest.mark.parametrize("closeness, dims, step", [
    (M.CELL_CLOSENESS, 1, 0.03), (M.CELL_CLOSENESS, 2, 0.06), (M.VALUE_CLOSENESS, 1, 0.4)])
@pytest.mark.parametrize("limits", [
    {}, {"fold_limit": 0}, {"fold_limit": 4, "group_limit": 8}])
def test_matching_equals_brute_force(spark, closeness, dims, step, limits):
    if "group_limit" in limits and dims == 2:
        limits = {"fold_limit": 0, "group_limit": 0}
    rows = make_rows(7 + dims, dims, step, 60 if "group_limit" not in limits else 12)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["case_id"]: r["hits"] for r in M.first_fit_hits(df, ["case_id"], closeness, dims, **limits).collect()}
    assert got == brute(rows, closeness.near_np)


@pytest.mark.parametrize("closeness", [M.CELL_CLOSENESS, M.VALUE_CLOSENESS])
def test_close_numbers_are_in_neighbouring_cells(spark, closeness):
    rnd = random.Random(3)
    pairs = [(0.0, 9.9e-7), (-5e-7, 4.9e-7)]
    for _ in range(3000):
        x = rnd.choice((-1, 1)) * 10 ** rnd.uniform(-9, 12)
        pairs.append((x, x * (1 + rnd.uniform(-1, 1) * closeness.rel * 1.001)))
    df = spark.createDataFrame(pairs, "x double, y double")
    x, y = F.col("x"), F.col("y")
    bad = df.filter(closeness.near(x, y) & (F.abs(closeness.cell(x) - closeness.cell(y)) > 1))
    assert bad.count() == 0


def _rows(case, gold, pred):
    cell = lambda v: [("v", None if v is None else str(v))]
    return ([(case, "gold", i, cell(v)) for i, v in enumerate(gold)]
            + [(case, "pred", i, cell(v)) for i, v in enumerate(pred)])


ROW_SCHEMA = "case_id int, side string, row_no bigint, cells array<struct<col: string, val: string>>"


def test_order_decides(spark):
    rows = _rows(1, [1.0, 1.0009], [1.0009, 0.9995]) + _rows(2, [1.0009, 1.0], [1.0009, 0.9995])
    got = {r["case_id"]: r["n_matched"] for r in R.fuzzy_matches(spark.createDataFrame(rows, ROW_SCHEMA)).collect()}
    assert got == {1: 1, 2: 2}


def test_strict_reads_null_as_none_but_fuzzy_does_not(spark):
    rows = spark.createDataFrame(_rows(1, [None], ["None"]), ROW_SCHEMA)
    assert R.strict_equality(rows).first()["strict_equal"] is True
    assert R.fuzzy_matches(rows).first()["n_matched"] == 0


def test_a_hot_case_is_decided_by_counts(spark):
    """One case with most rows, all of equal or well separated values: nothing is played through."""
    n = 20000
    gold = spark.range(n).select(F.lit(1).alias("case_id"), F.lit("left").alias("side"), F.col("id").alias("pos"),
                                 F.lit("").alias("block"), F.array((F.col("id") % 50) * 10.0 + 1).alias("vec"))
    pred = gold.withColumns({"side": F.lit("right"), "vec": F.array(F.get("vec", F.lit(0)) * 1.0001)})
    got = M.first_fit_hits(gold.unionByName(pred), ["case_id"], M.CELL_CLOSENESS, 1, fold_limit=0, group_limit=0)
    assert got.first()["hits"] == n


def test_values_and_f1(spark):
    rows = spark.createDataFrame(
        _rows(1, ["1.005", "x", "2.5", "2.0"], ["1.0", "2.0", "x", "5"]), ROW_SCHEMA)
    mapping = spark.createDataFrame([(1, "v", "v")], "case_id int, true_col string, pred_col string")
    widths = spark.createDataFrame([(1, 1)], "case_id int, n_gold_cols int")
    assert R.value_scores(rows, mapping, widths).first()["value_score"] == pytest.approx(0.75)


def test_verdict_ignores_row_and_column_order(spark):
    rnd = random.Random(5)
    base = [(("a", str(rnd.randrange(9))), ("b", str(rnd.random()))) for _ in range(20)]
    shuffled = rnd.sample(base, len(base))
    rows = [(1, "gold", i, sorted(r)) for i, r in enumerate(base)]
    rows += [(1, "pred", i, sorted(reversed(r))) for i, r in enumerate(shuffled)]
    assert R.strict_equality(spark.createDataFrame(rows, ROW_SCHEMA)).first()["strict_equal"] is True


def test_stages(spark):
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", "b"), (4, "a", "b"), (5, "a", "b"), (6, "a", "b")],
                                  "case_id int, gold_sql string, pred_sql string")
    outcomes = spark.createDataFrame([(2, False, True), (3, True, False), (4, True, True), (5, True, True)],
                                     "case_id int, gold_ok boolean, pred_ok boolean")
    rows = spark.createDataFrame(_rows(5, [1.0, 2.0], [2.0001, 1.0001]), ROW_SCHEMA)
    got = {r["case_id"]: (r["stage"], r["verdict"]) for r in R.staged_verdict(pairs, outcomes, rows).collect()}
    assert got == {1: ("same_text", True), 2: ("gold_failed", False), 3: ("pred_failed", False),
                   4: ("both_empty", True), 5: ("fuzzy", True), 6: ("no_result", False)}


def test_assignment_is_optimal():
    from itertools import permutations

    rnd = np.random.default_rng(1)
    for shape in ((3, 3), (2, 5), (5, 2), (4, 6), (1, 1)):
        for _ in range(20):
            sim = rnd.random(shape)
            wide = sim if shape[0] <= shape[1] else sim.T
            best = max(sum(wide[i, c] for i, c in enumerate(p))
                       for p in permutations(range(wide.shape[1]), wide.shape[0]))
            got = best_assignment(sim)
            assert len(got) == min(shape) and sum(sim[r, c] for r, c in got) == pytest.approx(best)
