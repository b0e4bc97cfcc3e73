"""Jobs: statement runner, exchange, resume and draws, streaming, accuracy."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import sampling as D
from sqlgauge.operators import votes as V
from sqlgauge.plans import evaluate as E
from sqlgauge.plans import reward as W
from sqlgauge.session import scratch_path
from sqlgauge.sources import exchange, runner, tables
from sqlgauge.streaming.scoring import completion_stream, score_stream


def run(spark, *texts, execute=True):
    session = runner.guarded_session(spark, {"nation": "/root/testdata/sf0.001/nation.parquet"})
    statements = runner.statement_table(session.createDataFrame([(t,) for t in texts], "sql string"), "sql")
    keys = {r["sql_text"]: r["sql_key"] for r in statements.collect()}
    corpus = runner.run_statements(session, statements, execute)
    outcomes = {r["sql_key"]: r for r in corpus.outcomes.collect()}
    return {t: outcomes[keys[t]] for t in texts}, corpus, keys


REFUSED = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect`('a', 'b')",
    "SELECT REFLECT /* x */ ('a', 'b')", "SELECT java_method('a', 'b')",
    "FROM nation |> EXTEND reflect('a', 'b') AS r |> SELECT r",
    "SELECT TRANSFORM(n_name) USING 'cat' FROM nation", "FROM nation MAP n_name USING 'cat'",
    "SELECT identifier('ref' || 'lect')('a', 'b')", "", " \n"]
FAILING = [
    "DROP TABLE nation", "CREATE TABLE t AS SELECT 1", "INSERT INTO nation SELECT 1", "SET a=1", "SHOW TABLES",
    "SELECT 1; SELECT 2", "SELECT 1) AS q; DROP TABLE nation; SELECT * FROM (SELECT 1",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT nope FROM nation", "SELECT 1/0 AS x"]
RUNNING = [
    "SELECT 1 AS a, 2 AS a", "WITH c AS (SELECT count(*) AS n FROM nation) SELECT n FROM c -- end",
    "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 3;", "SELECT 'reflect on this' AS x",
    "SELECT a.n_name FROM nation a JOIN nation b USING (n_nationkey)"]


def test_runner(spark):
    got, corpus, keys = run(spark, *REFUSED, *FAILING, *RUNNING)
    for text in REFUSED:
        assert got[text]["condition"] in ("FORBIDDEN_CALL", "BLANK_STATEMENT"), text
    for text in FAILING:
        assert not got[text]["ok"] and got[text]["condition"] not in ("FORBIDDEN_CALL",), text
    for text in RUNNING:
        assert got[text]["ok"], (text, got[text]["message"])
    rows = corpus.rows.filter(F.col("sql_key") == keys[RUNNING[2]]).orderBy("row_no").collect()
    assert [r["cells"][0]["val"] for r in rows] == ["NATION_9", "NATION_8", "NATION_7"]
    twice = corpus.rows.filter(F.col("sql_key") == keys[RUNNING[0]]).first()["cells"]
    assert [c["col"] for c in twice] == ["a#0", "a#1"]


FAMILIES = [
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = {} GROUP BY o_orderstatus",
    "SELECT count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_custkey={}",
    "SELECT count(*) AS n FROM orders WHERE o_custkey = {} HAVING count(*) > 9",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {} AND o_orderstatus = 'F' AND o_orderkey <> 5",
    "SELECT o_orderkey FROM orders WHERE o_custkey = {} ORDER BY 1 DESC LIMIT 2",
    "SELECT o_custkey = {} FROM orders WHERE o_orderkey < 40",
    "SELECT 'it = 5' AS t, 1 / (o_custkey - 3) AS x FROM orders WHERE o_custkey = {}",
    "SELECT n_name, k FROM nation JOIN (SELECT count(*) AS k FROM orders WHERE o_custkey = {}) ON n_nationkey = k",
    "SELECT nope FROM orders WHERE o_custkey = {}",
    "WITH m AS (SELECT o_custkey AS c, max(o_totalprice) AS Top FROM orders WHERE o_custkey = {} GROUP BY 1) SELECT * FROM m",
    "SELECT n_regionkey, n_name AS Name FROM nation WHERE n_name = 'NATION_{}'",
    "SELECT count(*) AS n /* = 5 'a */ FROM orders -- it's = {0}\n WHERE o_custkey - 1 = {0} / 1 -- {0}",
    "SELECT count(*) AS n FROM nation WHERE n_name = 'it''s {}' OR n_name >= 'NATION_9' OR n_name == 'NATION_1'",
]


def test_families_come_out_as_their_members_do(spark):
    sf = "/root/testdata/sf0.001"
    session = runner.guarded_session(spark, {n: f"{sf}/{n}.parquet" for n in ("orders", "nation")})
    texts = [(f.format(k),) for f in FAMILIES for k in range(1, 13)]
    statements = runner.statement_table(spark.createDataFrame(texts, "sql string"), "sql")
    found = runner.with_family(statements).groupBy("family").count().where("family is not null")
    assert {r["count"] for r in found.collect()} == {12} and found.count() == 11

    def results(family):
        corpus = runner.run_statements(session, statements, family=family)
        rows = corpus.rows.groupBy("sql_key").agg(F.array_sort(F.collect_list(F.to_json("cells"))).alias("rows"))
        out = statements.join(corpus.outcomes, "sql_key").join(rows, "sql_key", "left")
        return {r["sql_text"]: (r["ok"], r["condition"], r["rows"]) for r in out.collect()}

    each, together = results(10**6), results(8)
    assert len(each) == len(texts) and each == together
    assert each["SELECT 'it = 5' AS t, 1 / (o_custkey - 3) AS x FROM orders WHERE o_custkey = 3"][1] == "DIVIDE_BY_ZERO"
    assert sum(not ok for ok, *_ in each.values()) == 13


def test_time_limit_is_an_outcome(spark):
    session = runner.guarded_session(spark, {})
    slow = "SELECT count(*) AS n FROM range(0, 100000000000) WHERE sqrt(id) < 0"
    statements = runner.statement_table(spark.createDataFrame([(slow,), ("SELECT 1 AS a",)], "sql string"), "sql")
    got = {r["sql_text"]: r["condition"] for r in statements.join(
        runner.run_statements(session, statements, timeout=4.0).outcomes, "sql_key").collect()}
    assert got == {slow: "TIME_LIMIT", "SELECT 1 AS a": None}


def test_analysis_does_not_run(spark):
    got, corpus, _ = run(spark, "SELECT 1/0 AS x", "SELECT nope FROM nation", execute=False)
    assert corpus.rows is None
    assert [r["ok"] for r in got.values()] == [True, False]


def test_exchange_hook_answers_every_request(spark):
    rows = spark.range(250).select((F.col("id") % 120).cast("string").alias("q"))
    requests = exchange.request_table(rows, F.col("q"))
    assert requests.count() == 120
    responses = exchange.answer_requests(requests, lambda prompts: [p + "!" for p in prompts], batch=7)
    got = exchange.attach_responses(rows, F.col("q"), responses)
    assert got.filter(F.col("reply") == F.concat("q", F.lit("!"))).count() == 250


def test_resume_is_idempotent_and_null_safe(spark):
    todo = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "query string")
    done = spark.createDataFrame([("a",), (None,), ("a",)], "original_prompt string")
    once = D.not_yet_done(todo, done)
    assert [r["query"] for r in once.collect()] == ["b"]
    assert D.not_yet_done(once, done).count() == 1


def test_dense_index_and_draws(spark):
    seeds = spark.range(5000).select((F.col("id") * 7).alias("k"))
    index = D.dense_index(seeds, "k", 16)
    assert index.agg(F.min("row_index"), F.max("row_index"), F.count_distinct("row_index")).first()[:] == (0, 4999, 5000)
    draws = D.draw_with_replacement(seeds, "k", 1200, 200)
    assert draws.count() == 1000 and draws.select("draw_no").distinct().count() == 1000
    assert D.draw_with_replacement(seeds, "k", 5, 5).count() == 0


def test_missing_column_fails_early(spark):
    with pytest.raises(tables.MissingColumns, match="query"):
        tables.conform(spark.range(1), tables.EVALUATION_SCHEMA, ("query",))


def test_votes(spark):
    votes = spark.createDataFrame(
        [(1, 0, True), (1, 1, True), (1, 2, False), (2, 0, True), (2, 1, None), (3, 0, True)],
        "case_id int, judge_id int, verdict boolean")
    major = {r["case_id"]: r["verdict"] for r in V.majority_vote(votes).collect()}
    all_of = {r["case_id"]: r["verdict"] for r in V.unanimous_vote(votes).collect()}
    # the no of a third judge counts: all votes must be true, and there must be enough
    assert major == {1: True, 2: True, 3: True} and all_of == {1: False, 2: False, 3: False}
    agreed = votes.where("case_id > 1 OR verdict")
    assert {r["case_id"]: r["verdict"] for r in V.unanimous_vote(agreed).collect()} == {1: True, 2: False, 3: False}


def test_accuracy_counts_add_up(spark):
    rows = spark.createDataFrame(
        [("sql", True), ("sql", None), ("multi_step", False), ("clarify", True)], "task string, verdict boolean")
    got = {(r["grp"], r["task"]): r for r in E.accuracy(rows).collect()}
    assert got["all", "all"]["n_rows"] == 4
    assert got["sql", "sql"]["acc_all"] == 0.5 and got["sql", "sql"]["acc_judged"] == 1
    assert got["sql", "all"]["acc_all"] == 0.25 and got["all", "all"]["acc_all"] == 0.5


def test_group_statistics_drop_flat_prompts_and_long_completions(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 5), (1, 2.0, 5), (1, 9.0, 5000), (2, 1.0, 5), (2, 1.0, 5)],
        "prompt_id int, total_reward double, n_tokens int")
    got = W.group_statistics(rows).collect()
    assert len(got) == 2 and {r["mean_reward"] for r in got} == {1.5}


def test_stream_scores_each_key_once_across_restarts(spark):
    source, out = scratch_path(spark, "drops"), scratch_path(spark, "scores")
    schema = "key string, content string, n_tokens bigint"
    drop = lambda n, keys: spark.createDataFrame([(k, "x", 1) for k in keys], schema).coalesce(1).write.parquet(f"{source}/{n}")
    from pyspark.sql.types import LongType, StringType, StructType

    typed = StructType().add("key", StringType()).add("content", StringType()).add("n_tokens", LongType())

    def score(progress):
        stream = completion_stream(spark, f"{source}/*", typed, files_per_batch=1)
        score_stream(stream, out, progress).awaitTermination()
        return sorted(r["key"] for r in spark.read.parquet(out).collect())

    first = scratch_path(spark, "p")
    drop("a", ["1", "2", "2"])
    assert score(first) == ["1", "2"]
    drop("b", ["2", "3"])
    assert score(first) == ["1", "2", "3"]
    drop("c", ["3", "4"])
    assert score(first) == ["1", "2", "3", "4"]
    assert score(first) == ["1", "2", "3", "4"]
    assert score(scratch_path(spark, "p")) == ["1", "2", "3", "4"]
