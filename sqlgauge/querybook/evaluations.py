"""The whole evaluation job over rows of all types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions.text import hash_bucket, question_text
from sqlgauge.plans import evaluate as E
from sqlgauge.plans.execution import run_pairs
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.prompts import sql_render
from sqlgauge.querybook.registry import query
from sqlgauge.querybook.results import _sql_accuracy
from sqlgauge.session import materialize
from sqlgauge.sources import runner

_TYPES = ("sql", "多步推理", "反思数据", "维度退化", "歧义澄清", "维度拒识")


#: Rows of a customer's result, what a form of an answer changes in it, and the forms of its gold statement.
_RESULT = ("SELECT o_orderstatus AS status, sum(CAST(o_totalprice AS DECIMAL(18,2))){} AS total FROM orders "
           "WHERE o_custkey = ", " GROUP BY o_orderstatus")
_NONE = " AND o_orderkey < 0"
_ANSWERS = 8
_GOLDS = 6


def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per seed: type, gold form and answer form by hash; statements about the order's customer."""
    seeds = I.seeds(spark, sf)
    part = lambda salt, n: hash_bucket(F.concat("query", F.lit(salt)), n)
    custkey = F.regexp_extract("query", "年客户 (\\d+) 的", 1)
    rows = seeds.select(
        F.col("seed_id").alias("row_id"), "query", F.col("seed_id").cast("string").alias("k"), custkey.alias("c"),
        I.pick(part("t", 6), *_TYPES).alias("type"), part("g", _GOLDS).alias("g"), part("a", _ANSWERS).alias("a"))
    lit, executed = F.lit, F.col("type").isin(*_TYPES[:3])
    only = F.when(F.col("g") == 3, lit(_NONE)).otherwise(lit(""))

    def result(factor: str = "", extra: str = "", end: str = "") -> Column:
        return F.concat(lit(_RESULT[0].format(factor)), "c", lit(extra), only, lit(_RESULT[1] + end))

    broken = F.concat(lit("SELECT sum(o_total) AS total FROM orders WHERE o_custkey = "), "c")
    no_sql = [lit("no idea"), lit(None).cast("string")]
    wanted = F.when(F.col("g") == 4, broken).otherwise(result())
    given = I.pick(F.col("a"), wanted, result(extra=" AND o_orderkey > -1"), result(" * 1.0005"), result(" * 1.01"),
                   result(end=" HAVING o_orderstatus <> 'F'"), broken, *no_sql)
    # the judge and semantic routes read texts only
    sql = F.concat(lit("SELECT count(*) AS n FROM orders WHERE o_orderkey = "), "k")
    again = F.concat(lit("select COUNT( * ) as n\nfrom Orders where O_ORDERKEY = "), "k", lit(" ;"))
    other = F.concat(lit("SELECT count(*) AS n FROM orders WHERE o_custkey = "), "k")
    read = I.pick(F.col("a") % 4, again, other, *no_sql)
    gold = F.when(executed, wanted).when(F.col("type") == "歧义澄清", lit("which order?")).otherwise(sql)
    tagged = F.concat(lit("<think>t</think><answer> "), gold, lit("\n</answer>"))
    return rows.select("row_id", "query", F.when(F.col("g") == 5, gold).otherwise(tagged).alias("response"),
                       F.when(executed, given).otherwise(read).alias("answer"), "type")


_B = lambda salt, n: I.sql_bucket(f"query || '{salt}'", n)
# Both results of every customer and form, and what comparing them gives: counts, equal rows, close rows.
_COMPARED = """gold_rows AS (SELECT o_custkey AS c, o_orderstatus AS s, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY ALL),
pred_rows AS (SELECT c, a, s, CASE a WHEN 2 THEN v * 1.0005 WHEN 3 THEN v * 1.01 ELSE v END AS v FROM gold_rows, range(1, 5) f(a) WHERE a < 4 OR s <> 'F'),
sides AS (SELECT c, a, s, v AS g, NULL AS p FROM gold_rows, range(1, 5) f(a) UNION ALL SELECT c, a, s, NULL, v FROM pred_rows),
met AS (SELECT c, a, s, max(g) AS g, max(p) AS p FROM sides GROUP BY c, a, s),
compared AS (SELECT c, a, count(g) AS ng, count(p) AS np, bool_and(g IS NOT DISTINCT FROM p) AS same,
  bool_and(coalesce(abs(g::DOUBLE - p::DOUBLE) <= greatest(0.001::DOUBLE * greatest(abs(g::DOUBLE), abs(p::DOUBLE)), 0.000001::DOUBLE), false)) AS near FROM met GROUP BY c, a)"""
_EXEC = "type IN ('sql', '多步推理', '反思数据')"
_EVAL = f"""ev AS (SELECT *, {I.sql_pick(_B('t', 6), *[I.q(t) for t in _TYPES])} AS type, {_B('g', _GOLDS)} AS g, {_B('a', _ANSWERS)} AS fa, fa % 4 AS a,
  regexp_extract(query, '年客户 (\\d+) 的', 1)::BIGINT AS ck,
  'SELECT count ( * ) AS n FROM orders WHERE o_orderkey = ' || seed_id AS sql_b, 'SELECT count ( * ) AS n FROM orders WHERE o_custkey = ' || seed_id AS other,
  'select COUNT( * ) as n' || chr(10) || 'from Orders where O_ORDERKEY = ' || seed_id || ' ;' AS again_raw, 'SELECT count(*) AS n FROM orders WHERE o_custkey = ' || seed_id AS other_raw FROM sec),
er AS (SELECT *, CASE WHEN type = '维度拒识' THEN 'unknown type: 维度拒识' WHEN type = '歧义澄清' AND g = 5 THEN 'gold is empty'
  WHEN type <> '歧义澄清' AND g = 5 THEN 'gold has no SQL' WHEN type = '维度退化' AND a < 2 AND schema = '' THEN 'no schema in prompt' END AS err FROM ev),
{_COMPARED},
staged AS (SELECT er.*, ng, np, CASE WHEN fa = 0 OR g = 4 AND fa = 5 THEN 'same_text' WHEN g = 4 THEN 'gold_failed' WHEN fa = 5 THEN 'pred_failed'
  WHEN g = 3 THEN 'both_empty' WHEN same THEN 'strict' WHEN ng = np AND near THEN 'fuzzy' WHEN ng <> np THEN 'row_count_mismatch' ELSE 'value_mismatch' END AS st
  FROM er LEFT JOIN compared ON c = ck AND compared.a = fa),
gated AS (SELECT *, type = '多步推理' AND st IN ('row_count_mismatch', 'value_mismatch') AS asked, {I.sql_bucket("question || 'j'", 3)} = 0 AS said FROM staged),
jk AS (SELECT *, sha256({sql_render('judge_sql', question='question', schema='schema', sql_a='other', sql_b='sql_b')}) AS k,
  sha256({sql_render('judge_sentences', sentence_a="'which order?'", sentence_b="CASE a WHEN 0 THEN again_raw WHEN 1 THEN other_raw ELSE 'no idea' END")}) AS sk FROM gated),
jv AS (SELECT *, {" + ".join(f"({I.sql_bucket(f'k || {j}', 3)} = 0)::INTEGER" for j in ("'0'", "'1'", "'2'"))} AS yes,
  {" + ".join(f"({I.sql_bucket(f'k || {j}', 3)} = 1)::INTEGER" for j in ("'0'", "'1'", "'2'"))} AS no, {I.sql_bucket('sk', 3)} AS sv FROM jk),
done AS (SELECT seed_id AS row_id,
  CASE WHEN err IS NULL AND {_EXEC} AND fa < 6 THEN CASE WHEN asked THEN said ELSE st IN ('same_text', 'both_empty', 'strict', 'fuzzy') END END AS equivalent_exec,
  CASE WHEN err IS NULL AND {_EXEC} THEN CASE WHEN fa >= 6 THEN 'model SQL missing SELECT' WHEN asked THEN 'judge' ELSE st END END AS msg_exec,
  CASE WHEN err IS NULL AND type = '维度退化' THEN CASE WHEN a >= 2 THEN false WHEN a = 0 THEN true WHEN yes > no THEN true WHEN no > yes THEN false END END AS equivalent_llm,
  CASE WHEN err IS NULL AND type = '维度退化' THEN CASE WHEN a >= 2 THEN 'model SQL missing SELECT' WHEN a = 0 THEN 'same canonical text' WHEN yes = no THEN 'no majority' ELSE 'majority' END END AS msg_llm,
  CASE WHEN err IS NULL AND type = '歧义澄清' THEN CASE WHEN a = 3 THEN false WHEN sv = 0 THEN true WHEN sv = 1 THEN false END END AS equivalent_semantic,
  CASE WHEN err IS NULL AND type = '歧义澄清' THEN CASE WHEN a = 3 THEN 'model answer is empty' WHEN sv = 0 THEN 'same' WHEN sv = 1 THEN 'no reason' END END AS msg_semantic,
  CASE WHEN err IS NOT NULL THEN err WHEN type = '歧义澄清' AND a < 3 AND sv = 2 THEN 'judge reply unreadable' END AS error_processing FROM jv)"""


def executed_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Routed evaluation rows, and ``(row_id, stage, verdict)`` of those whose statements were run and compared."""
    # gold and pred hold what the routes read of response and answer
    ready = materialize(E.routed(evaluation_rows(spark, sf)).drop("response", "answer"), "routed")
    mine = materialize(E.executable(ready), "executable")
    session = runner.guarded_session(spark, {"orders": f"{sf}/orders.parquet"})
    runs = run_pairs(session, mine)
    verdicts = materialize(E.execution_verdicts(mine, runs), "row-verdicts")
    requests = materialize(E.result_judge_requests(verdicts, runs.rows), "requests")
    said = I.pick(hash_bucket(F.concat(question_text(F.col("query")), F.lit("j")), 3), '{"is_equivalent": true}',
                  '```json\n{"is_equivalent": false}\n```', "no idea")
    responses = materialize(I.replies(requests, F.col("prompt"), said), "judgements")
    return ready, E.with_result_judgements(verdicts, requests, responses)


@query("evaluation_table", "E5, E6, E7, E8, E9, E10, E11", f"WITH {I.SECTIONED}, {_EVAL} SELECT * FROM done")
def evaluation_table(spark: SparkSession, sf: str) -> DataFrame:
    ready, verdicts = executed_rows(spark, sf)
    candidates = materialize(E.sql_judge_candidates(ready), "candidates")
    judges = candidates.withColumn("judge_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    vote = I.pick(hash_bucket(F.concat("prompt_key", F.col("judge_id").cast("string")), 3),
                  '{"is_equivalent": true}', '```json\n{"is_equivalent": false}\n```', "bad")
    votes = materialize(I.replies(judges, F.col("prompt"), vote, "judge_id"), "votes")
    said = I.pick(hash_bucket(F.col("prompt_key"), 3), '{"is_identical": true, "reason": "same"}',
                  'so: {"is_identical": false}', "bad")
    sentences = materialize(E.sentence_judge_request(ready), "sentences")
    replies = materialize(I.replies(sentences, F.col("prompt"), said), "replies")
    return E.evaluation_table(ready, verdicts, candidates, votes, sentences, replies)


@query("executed_accuracy", "E8, E12", f"""
WITH {I.SECTIONED}, {_EVAL}, v AS (SELECT CASE type WHEN '多步推理' THEN 'multi_step' WHEN '反思数据' THEN 'reflection' ELSE type END AS task, equivalent_exec AS verdict
  FROM ev JOIN done ON seed_id = row_id WHERE {_EXEC}), {_sql_accuracy('v')}""")
def executed_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy from statements that were run: answers without SQL and rows without gold count as not judged."""
    ready, verdicts = executed_rows(spark, sf)
    tasks = ready.where(F.col("route") == "exec").select("row_id", "task")
    return E.accuracy(tasks.join(verdicts.select("row_id", "verdict"), "row_id", "left"))
