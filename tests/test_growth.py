"""Tables as folders, statements in numbers, files and texts of any size."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import scores as C
from sqlgauge import session
from sqlgauge.functions.replies import sql_in_reply
from sqlgauge.querybook import arrivals, prompts
from sqlgauge.querybook.results import cell_closeness
from sqlgauge.session import scratch_path
from sqlgauge.sources import runner


def test_stream_reads_a_table_that_is_a_folder(spark):
    sf = scratch_path(spark, "tables")
    talks = spark.createDataFrame(
        [(c, t, r, f"text {c} {t}") for c in range(6) for t, r in enumerate(("user", "assistant"))],
        "conv_id bigint, turn int, role string, text string")
    talks.repartition(3).write.parquet(f"{sf}/conversations.parquet")
    got = arrivals.stream_scores(spark, sf).collect()
    assert sorted(r["key"] for r in got) == [f"{c}-1" for c in range(6)]


def test_stream_reads_a_table_that_is_one_file(spark, tmp_path):
    talks = spark.createDataFrame([(7, 1, "assistant", "a")], "conv_id bigint, turn int, role string, text string")
    talks.toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert [r["key"] for r in arrivals.stream_scores(spark, str(tmp_path)).collect()] == ["7-1"]


@pytest.mark.parametrize("a, b, want", [
    ("NaN", "NaN", False), ("NaN", "1", False), ("nan", "nan", True), (None, None, True), (None, "NaN", False), ("1", "1.0", True)])
def test_cells_of_number_columns_that_read_nan_are_close_to_nothing(evaluate, a, b, want):
    assert evaluate(lambda x, y: C.cells_close(x, y, numbers=True), a, b) is want


def test_prices_that_are_no_numbers_are_not_close(spark):
    sf = scratch_path(spark, "tables")
    orders = spark.range(64).select(F.col("id").alias("o_orderkey"), F.lit("P").alias("o_orderstatus"), F.lit(2.5).alias("o_totalprice"))
    orders.write.parquet(f"{sf}/orders.parquet")
    form = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("bigint") % 8
    got = cell_closeness(spark, sf).withColumn("form", form).collect()
    assert {r["is_close"] for r in got if r["form"] == 5} == {False}
    assert {r["is_close"] for r in got if r["form"] in (0, 1, 3, 6)} == {True}



def test_statements_that_fail_alike_are_not_analysed_one_by_one(spark, monkeypatch):
    texts = [f"SELECT n_name FROM nation WHERE n_nationkey = {k} UNION ALL SELECT n_name, 1 FROM nation" for k in range(40)]
    texts += [f"SELECT n_name FROM nation WHERE n_nationkey = {k} ORDER BY n_name" for k in range(12)]
    # members whose constants are the same in other places fail in other ways
    texts += [f"SELECT n_regionkey = {k}, count(*) FROM nation GROUP BY n_regionkey = {k + k % 2} LIMIT 5" for k in range(20)]
    guarded = runner.guarded_session(spark, {"nation": "/root/testdata/sf0.001/nation.parquet"})
    statements = runner.statement_table(spark.createDataFrame([(t,) for t in texts], "sql string"), "sql")
    paged = []
    page = runner._Run.page
    monkeypatch.setattr(runner._Run, "page", lambda self, rows: paged.extend(r["sql_text"] for r in rows) or page(self, rows))

    def outcomes(family):
        found = statements.join(runner.run_statements(guarded, statements, family=family).outcomes, "sql_key")
        return {r["sql_text"]: (r["ok"], r["condition"]) for r in found.collect()}

    each = outcomes(10**6)
    paged.clear()
    assert outcomes(8) == each and len(each) == len(texts)
    assert sum(not ok for ok, _ in each.values()) == 50 and not [t for t in paged if "UNION" in t]


def test_csv_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(prompts, "CSV_ROWS", 10)
    rows = spark.range(95).select(F.concat(F.lit('a\n"b" '), "id").alias("query"), F.lit("r").alias("response")).coalesce(1)
    path = prompts._round_trip(rows, "csv")
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path").distinct().count()
    assert files == 10 and sorted(prompts.tables.read_seeds(spark, path, "csv").select("query", "response").collect()) == sorted(rows.collect())


def test_tasks_hold_no_more_rows_when_a_table_grows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    sizes = {n: session.dealt(spark.range(n), "id").rdd.getNumPartitions() for n in (100, 5000)}
    assert sizes == {100: spark.sparkContext.defaultParallelism, 5000: 100}


@pytest.mark.parametrize("text, want", [
    ("SQL -> select 1\n\nSQL -> select 2", "select 1"), ("```sql\n a \n``` ```sql b```", "a"), ("x select 2", "select 2"),
    ("``` ``` -> SELECT 3", "SELECT 3"), ("none", None), (None, None)])
def test_the_first_statement_of_a_reply_is_taken(evaluate, text, want):
    assert evaluate(sql_in_reply, text) == want


def test_a_column_made_once_is_not_put_into_later_filters(spark):
    made = session.once(spark.range(3), key=F.sha2(F.col("id").cast("string"), 256)).filter("key is not null").select(
        "id", F.md5(F.col("key").cast("binary")).alias("a"), F.concat("key", F.lit("b")).alias("b"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and made.count() == 3
