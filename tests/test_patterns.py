"""Period-wide figures, picks from small pools and matching of whole cases against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import matching as M
from sqlgauge.operators import patterns as P
from sqlgauge.operators import resultsets as R
from sqlgauge.operators import sampling as D
from test_matching import ROW_SCHEMA, SCHEMA, _rows, brute, make_rows


def facts(seed, n=600):
    rnd = random.Random(seed)
    months = [None, "2024-01-01", "2024-02-01", "2024-03-01"]
    # one month and one amount hold most rows, so that ties cross the ranges
    return [(i, rnd.choice(months + ["2024-01-01"] * 4), rnd.choice([None, 5, 5, 5, rnd.randrange(40)]))
            for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_distributed_rank(spark, partitions):
    rows = facts(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "id int, month string, amount int").repartition(5)
        got = {r["id"]: r["place"] for r in P.distributed_rank(df, ["month"], "amount", "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    value = lambda a: -1 if a is None else a
    want = {i: 1 + sum(value(b) > value(a) for _, n, b in rows if n == m) for i, m, a in rows}
    assert got == want


def test_distributed_rank_of_nothing_and_without_groups(spark):
    empty = spark.createDataFrame([], "id int, month string, amount int")
    assert P.distributed_rank(empty, ["month"], "amount", "place").collect() == []
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 1)], "id int, amount int")
    got = {r["id"]: r["place"] for r in P.distributed_rank(df, [], "amount", "place").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 4}


def test_ranks_hold_no_whole_period_in_a_window(spark):
    df = spark.createDataFrame(facts(5), "id int, month string, amount int")
    plan = P.shares(df, ["id"], "month", "amount")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_shares(spark):
    rows = facts(4)
    df = spark.createDataFrame(rows, "id int, month string, amount int")
    got = {r["id"]: r["share"] for r in P.shares(df, ["id"], "month", "amount").collect()}
    whole = {}
    for _, m, a in rows:
        whole[m] = whole.get(m, 0) + (a or 0)
    assert got == {i: None if a is None else pytest.approx(a / whole[m]) for i, m, a in rows}


@pytest.mark.parametrize("n_pool", [1, 3, 5000])
def test_every_row_gets_one_example(spark, n_pool):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("query"))
    pool = spark.range(n_pool).select(F.col("id").alias("example_id"))
    picks = D.attach_example(rows, F.sha2("query", 256), pool, "example_id")
    first = {r["query"]: r["example_id"] for r in picks.collect()}
    assert len(first) == picks.count() == 3000
    assert len(set(first.values())) > min(n_pool, 3000) * 0.4
    again = D.attach_example(rows.repartition(3), F.sha2("query", 256), pool.repartition(2), "example_id")
    assert {r["query"]: r["example_id"] for r in again.collect()} == first


@pytest.mark.parametrize("closeness, dims, step", [
    (M.CELL_CLOSENESS, 1, 0.03), (M.CELL_CLOSENESS, 2, 0.06), (M.VALUE_CLOSENESS, 1, 0.4)])
@pytest.mark.parametrize("limits", [{}, {"fold_limit": 0}, {"fold_limit": 2, "group_limit": 4}])
def test_complete_cases(spark, closeness, dims, step, limits):
    """Which cases match item for item is the same with and without the prune."""
    rows = make_rows(11 + dims, dims, step, 12)
    rnd = random.Random(5)
    for case in range(100, 112):  # each right item close to a left one; some of them moved away afterwards
        for pos in range(8):
            vec = [100 + rnd.randrange(30) * step for _ in range(dims)]
            moved = 3 if case % 3 == 0 and pos == 0 else 0
            rows.append((case, "left", pos, "b", vec))
            rows.append((case, "right", 7 - pos, "b", [v + 0.01 + moved for v in vec]))
    want = brute(rows, closeness.near_np)
    counts = {r[0]: sum(s[0] == r[0] and s[1] == "left" for s in rows) for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.first_fit_hits(df, ["case_id"], closeness, dims, complete=True, **limits).collect()
    assert {r["case_id"]: r["hits"] == r["n_left"] for r in got} == {c: want[c] == counts[c] for c in counts}
    assert any(want[c] == counts[c] for c in counts) and any(want[c] < counts[c] for c in counts)
    assert all(r["hits"] <= want[r["case_id"]] for r in got)


def test_texts_that_read_nan_equal_themselves(spark):
    rows = _rows(1, ["NaN", 2.0], [2.0, "NaN"]) + _rows(2, ["NaN"], ["nan"]) + _rows(3, ["NaN"], [1.0])
    got = {r["case_id"]: r["n_matched"] for r in R.fuzzy_matches(spark.createDataFrame(rows, ROW_SCHEMA)).collect()}
    assert got == {1: 2, 2: 0, 3: 0}
