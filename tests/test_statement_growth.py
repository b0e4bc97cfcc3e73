"""Statements and result rows in numbers: taken once, told cheaply, dealt evenly."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions.sqltext import token_text
from sqlgauge.operators import resultsets as R
from sqlgauge.sources import runner


def test_result_rows_are_taken_once_when_their_numbers_are_counted(spark):
    taken = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        taken.add(1)
        return value

    pairs = [("c", s, k, str(10.0 * k + d)) for k in range(20) for s, d in (("gold", 0.0), ("pred", 0.001))]
    rows = spark.createDataFrame(pairs, "case_id string, side string, row_no bigint, v string").withColumn(
        "v", counted.asNondeterministic()("v"))
    cells = rows.select("case_id", "side", "row_no", F.array(F.struct(F.lit("n").alias("col"), F.col("v").alias("val"))).alias("cells"))
    assert R.fuzzy_matches(cells).first()["n_matched"] == 20 - 1 and taken.value == len(pairs)


@pytest.mark.parametrize("text, want", [
    ("SELECT re/**/flect FROM t", None), ("SELECT 'reflect' AS x", None), ("SELECT ReFlect('a', 'b')", "FORBIDDEN_CALL"),
    ("FROM t MAP a uſing 'cat'", "FORBIDDEN_CALL"), ("SELECT a FROM t JOIN u USING (a)", None), ("SELECT 1", None),
    ("SELECT Identifier /* x */ ('a')", "FORBIDDEN_CALL"), ("\n", "BLANK_STATEMENT"), (None, "BLANK_STATEMENT")])
def test_refusals(evaluate, text, want):
    assert evaluate(runner.refusal, text) == want


def test_result_rows_are_not_dealt_by_the_job_that_made_them(spark):
    session = runner.guarded_session(spark)
    statements = runner.statement_table(spark.createDataFrame([("SELECT 1 AS a",)], "sql string"), "sql")
    rows = runner.run_statements(session, statements).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and rows.count() == 1


@pytest.mark.parametrize("text, want", [
    ("select A . b, c.D from \"x . Y\" . z", 'SELECT a.b , c.d FROM "x . Y" . z'), ("select 1.5 , '. a'", "SELECT 1.5 , '. a'")])
def test_blanks_go_from_dotted_names_only(evaluate, text, want):
    assert evaluate(token_text, text) == want


def test_cases_left_by_strict_equality_are_met_with_their_rows_once(spark):
    cases = spark.createDataFrame([("a", "x", "y", True, True), ("b", "x", "z", True, False)],
                                  "case_id string, gold_sql string, pred_sql string, gold_ok boolean, pred_ok boolean")
    rows = spark.createDataFrame([(c, s, 0, [("n", v)]) for c in "ab" for s, v in (("gold", "1.0"), ("pred", "1.0005"))],
                                 "case_id string, side string, row_no bigint, cells array<struct<col: string, val: string>>")
    joins = []
    met = R.fuzzy_matches
    try:
        R.fuzzy_matches = lambda todo, *a, **k: joins.append(
            todo._jdf.queryExecution().optimizedPlan().toString().count("Join")) or met(todo, *a, **k)
        got = R.staged_verdict(cases.select("case_id", "gold_sql", "pred_sql"), cases.select("case_id", "gold_ok", "pred_ok"), rows)
        assert {r["case_id"]: r["stage"] for r in got.collect()} == {"a": "fuzzy", "b": "pred_failed"} and joins == [1]
    finally:
        R.fuzzy_matches = met
