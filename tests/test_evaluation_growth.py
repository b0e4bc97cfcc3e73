"""Evaluation of many rows: texts are read once, and replies once each."""

from pyspark.sql import functions as F

from sqlgauge.functions.text import prompt_key
from sqlgauge.plans import evaluate as E
from sqlgauge.session import materialize


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ROWS = [  # row_id, query, response, answer, type
    (1, "q", "<answer> SELECT 1 AS a</answer>", "SELECT 1 AS a", "sql"),
    (2, "q", "<answer>SELECT 1 AS a</answer>", "no idea", "sql"),
    (3, "q", "<answer>which order?</answer>", "this one?", "歧义澄清"),
    (4, "q", "<answer>which order?</answer>", None, "歧义澄清"),
    (5, "q", "no tag", "SELECT 1", "sql"),
    (6, "q", "<answer>SELECT 1</answer>", "SELECT 1", "other"),
]


def test_evaluation_table_reads_the_routed_rows_and_no_reply_of_theirs_again(spark):
    rows = spark.createDataFrame(ROWS, "row_id bigint, query string, response string, answer string, type string")
    ready = materialize(E.routed(rows), "routed")
    verdicts = spark.createDataFrame([(1, "same_text", True)], "row_id bigint, stage string, verdict boolean")
    votes = spark.createDataFrame([], "prompt_key string, judge_id int, text string")
    requests = E.sentence_judge_request(ready)
    replies = requests.where("prompt is not null").select(
        prompt_key(F.col("prompt")).alias("prompt_key"), F.lit('{"is_identical": true, "reason": "r"}').alias("text"))
    table = E.evaluation_table(ready, verdicts, E.sql_judge_candidates(ready), votes, requests, replies)
    got = {r[0]: (r["equivalent_exec"], r["msg_exec"], r["equivalent_semantic"], r["msg_semantic"], r["error_processing"])
           for r in table.collect()}
    assert got == {
        1: (True, "same_text", None, None, None), 2: (None, E.NO_SQL, None, None, None), 3: (None, None, True, "r", None),
        4: (None, None, False, "model answer is empty", None), 5: (None, None, None, None, "gold has no SQL"),
        6: (None, None, None, None, "unknown type: other")}
    assert "<answer>" not in optimized(table)


def test_sentence_replies_are_read_before_they_meet_the_rows(spark):
    requests = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "bad"), (5, "none"), (6, None)],
                                     "row_id bigint, prompt string")
    responses = spark.createDataFrame([("p", '{"is_identical": false, "reason": "r"}'), ("bad", "x")], "p string, text string").select(
        prompt_key(F.col("p")).alias("prompt_key"), "text")
    judged = E.semantic_route(requests, responses)
    unread = (None, None, "judge reply unreadable")
    assert {r[0]: tuple(r)[1:] for r in judged.collect()} == {
        **{k: (False, "r", None) for k in (1, 2, 3)}, 4: unread, 5: unread, 6: (False, "model answer is empty", None)}
    assert "get_json_object" not in optimized(judged).split("Join")[0]


def test_result_judge_requests_carry_their_prompts(spark):
    rows = spark.createDataFrame([("c", s, 0, [("n", v)]) for s, v in (("gold", "1"), ("pred", "2"))],
                                 "case_id string, side string, row_no bigint, cells array<struct<col: string, val: string>>")
    verdicts = spark.createDataFrame([(1, "c", "multi_step", "q1", 1, 1, "value_mismatch"), (2, "c", "sql", "q2", 1, 1, "value_mismatch")],
                                     "row_id bigint, case_id string, task string, query string, n_gold bigint, n_pred bigint, stage string")
    assert [(r["row_id"], r["query"]) for r in E.result_judge_requests(verdicts, rows).collect()] == [(1, "q1")]
