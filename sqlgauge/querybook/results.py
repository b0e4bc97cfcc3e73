"""Queries that compare result sets, count votes and roll up accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions.scores import cells_close
from sqlgauge.functions.text import hash_bucket
from sqlgauge.operators import resultsets as R
from sqlgauge.operators import votes as V
from sqlgauge.plans import evaluate as E
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.registry import query, rounded, table
from sqlgauge.session import dealt

_NUMBER = r"'^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$'"


def sql_near(x: str, y: str) -> str:
    return f"({x} = {y} OR abs({x} - {y}) <= greatest(0.001::DOUBLE * greatest(abs({x}), abs({y})), 0.000001::DOUBLE))"


# Each order's price against a slightly different text of it.
_CELL_FORMS = ("a", "(a::DOUBLE * 1.0009)::VARCHAR", "(a::DOUBLE * 1.0011)::VARCHAR", "NULL", "'None'", "'NaN'",
               "' ' || a || ' '", "o_orderstatus")


@query("cell_closeness", "E1", f"""
WITH b AS (SELECT o_orderkey, o_orderstatus, {I.sql_bucket('o_orderkey::VARCHAR', 8)} AS form, o_totalprice::DECIMAL(18,2)::VARCHAR AS p FROM orders),
c AS (SELECT *, CASE WHEN o_orderstatus = 'P' AND form IN (3, 5) THEN CASE form WHEN 3 THEN NULL ELSE 'NaN' END ELSE p END AS a FROM b),
d AS (SELECT *, {I.sql_pick('form', *_CELL_FORMS)} AS b FROM c),
n AS (SELECT *, CASE WHEN regexp_matches(a, {_NUMBER}) THEN trim(a)::DOUBLE END AS x, CASE WHEN regexp_matches(b, {_NUMBER}) THEN trim(b)::DOUBLE END AS y FROM d)
SELECT o_orderkey, CASE WHEN a IS NOT DISTINCT FROM 'NaN' OR b IS NOT DISTINCT FROM 'NaN' THEN false
  ELSE a IS NOT DISTINCT FROM b OR coalesce({sql_near('x', 'y')}, false) END AS is_close FROM n""")
def cell_closeness(spark: SparkSession, sf: str) -> DataFrame:
    form = hash_bucket(F.col("o_orderkey").cast("string"), 8)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", form.alias("form"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))
    special = (F.col("o_orderstatus") == "P") & F.col("form").isin(3, 5)
    rows = rows.withColumn("a", F.when(special & (F.col("form") == 5), F.lit("NaN")).when(~special, F.col("p")))
    a = F.col("a")
    scaled = lambda k: (a.try_cast("double") * k).cast("string")
    b = I.pick(F.col("form"), a, scaled(1.0009), scaled(1.0011), F.lit(None).cast("string"), "None", "NaN",
               F.concat(F.lit(" "), a, F.lit(" ")), F.col("o_orderstatus"))
    # prices are numbers: one that reads NaN is no text
    return rows.select("o_orderkey", cells_close(a, b, numbers=True).alias("is_close"))


@query("row_closeness", "E2", f"""
WITH {I.CASE_ROWS}
SELECT g.case_id, -p.pos AS row_no, p.form NOT IN ('column_renamed', 'column_added')
  AND {sql_near('g.v.amount::DOUBLE', 'p.v.amount::DOUBLE')} AND {sql_near('g.v.idx::DOUBLE', 'p.v.idx::DOUBLE')} AS is_close
FROM g_rows g JOIN p_rows p ON g.case_id = p.case_id AND g.pos = -p.pos""")
def row_closeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.case_rows(spark, sf)
    gold = rows.filter("side = 'gold'").select("case_id", "row_no", F.col("cells").alias("g"))
    pred = rows.filter("side = 'pred'").select("case_id", (-F.col("row_no")).alias("row_no"), F.col("cells").alias("p"))
    return gold.join(pred, ["case_id", "row_no"]).select(
        "case_id", "row_no", R.rows_close(F.col("g"), F.col("p")).alias("is_close"))


_STRICT = """counts AS (SELECT case_id, row, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p FROM (
    SELECT case_id, row, 1 AS g, 0 AS p FROM g_rows UNION ALL SELECT case_id, row, 0, 1 FROM p_rows) GROUP BY ALL),
strict AS (SELECT case_id, sum(g)::BIGINT AS n_gold, sum(p)::BIGINT AS n_pred, bool_and(g = p) AS strict_equal FROM counts GROUP BY case_id)"""


@query("strict_equality", "E4, X7", f"WITH {I.CASE_ROWS}, {_STRICT} SELECT * FROM strict")
def strict_equality(spark: SparkSession, sf: str) -> DataFrame:
    return R.strict_equality(I.case_rows(spark, sf))


@query("only_in_gold", "X7", f"""
WITH {I.CASE_ROWS}, {_STRICT}, f AS (SELECT case_id, row, min(pos) AS first_pos FROM g_rows GROUP BY ALL)
SELECT case_id, sum(g - p)::BIGINT AS n_only_gold, arg_min(row, first_pos) AS sample_row
FROM counts JOIN f USING (case_id, row) WHERE g > p GROUP BY case_id""")
def only_in_gold(spark: SparkSession, sf: str) -> DataFrame:
    return R.only_in_gold(dealt(I.stored_case_rows(spark, sf), "case_id"))


_GOLD_JSON = """'{"amount":"' || v.amount || '","idx":"' || v.idx || '","status":"' || v.status || '"}'"""
_PRED_JSON = """'{"amount":"' || v.amount || '",' || CASE WHEN form = 'column_added' THEN '"extra":"' || v.status || '",' ELSE '' END
  || '"idx":"' || v.idx || '","' || CASE WHEN form = 'column_renamed' THEN 'state' ELSE 'status' END || '":"' || v.status || '"}'"""


@query("result_preview", "T13", f"""
WITH {I.CASE_ROWS}, b AS (SELECT case_id, 'gold' AS side, pos, {_GOLD_JSON} AS line FROM g_rows
  UNION ALL SELECT case_id, 'pred', pos, {_PRED_JSON} FROM p_rows),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY pos) AS n FROM b),
c AS (SELECT case_id, side, count(*) AS n_rows FROM b GROUP BY ALL)
SELECT case_id, side, any_value(n_rows) AS n_rows, 'rows: ' || any_value(n_rows) || chr(10) || string_agg(line, chr(10) ORDER BY pos)
  || CASE WHEN any_value(n_rows) > 10 THEN chr(10) || '(more rows not shown)' ELSE '' END AS preview
FROM r JOIN c USING (case_id, side) WHERE n <= 10 GROUP BY case_id, side""")
def result_preview(spark: SparkSession, sf: str) -> DataFrame:
    return R.result_preview(dealt(I.stored_case_rows(spark, sf), "case_id"))


def sql_walk(near: str, lefts: str, rights: str, keys: str = "case_id") -> str:
    """First-fit matching played through item by item, as a recursive query.

    ``lefts``: keys, k (1..n), v; ``rights``: keys, items (list); ``near`` tests l and r.
    """
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"w.{k} = l.{k}" for k in names)
    own = ", ".join(f"w.{k}" for k in names)
    return f"""walk AS (SELECT {keys}, 0 AS k, items AS free, 0 AS hits FROM {rights}
  UNION ALL
  SELECT {keys}, k, CASE WHEN spot IS NULL THEN free ELSE list_concat(free[1:spot - 1], free[spot + 1:]) END,
    hits + CASE WHEN spot IS NULL THEN 0 ELSE 1 END FROM (
    SELECT {own}, l.k AS k, w.free AS free, w.hits AS hits,
      list_position(list_transform(w.free, lambda r: {near}), true) AS spot
    FROM walk w JOIN {lefts} l ON {on} AND l.k = w.k + 1))"""


_NEAR_CASE = (f"(l.v.status = r.status AND {sql_near('l.v.amount::DOUBLE', 'r.amount::DOUBLE')}"
              f" AND {sql_near('l.v.idx::DOUBLE', 'r.idx::DOUBLE')})")
_FUZZY = f"""lefts AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS k, v FROM g_rows),
rights AS (SELECT case_id, list(v ORDER BY pos) AS items FROM p_rows WHERE form NOT IN ('column_renamed', 'column_added') GROUP BY case_id),
{sql_walk(_NEAR_CASE, 'lefts', 'rights')},
fuzzy AS (SELECT case_id, max(hits)::BIGINT AS n_matched FROM walk GROUP BY case_id)"""


@query("fuzzy_matches", "E3", f"""WITH RECURSIVE {I.CASE_ROWS}, {_FUZZY}
SELECT case_id, coalesce(n_matched, 0) AS n_matched FROM (SELECT DISTINCT case_id FROM p_rows) LEFT JOIN fuzzy USING (case_id)""")
def fuzzy_matches(spark: SparkSession, sf: str) -> DataFrame:
    both = I.stored_case_rows(spark, sf)
    matched = R.fuzzy_matches(both, dims=2)
    with_pred = both.filter("side = 'pred'").select("case_id").distinct()
    return with_pred.join(matched, "case_id", "left").select(
        "case_id", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


# Narrow values: long chains of neighbours in which the order decides.
_CHAIN = f"""{I.CASE_ROWS},
lefts AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS k, v.idx::DOUBLE AS v FROM g_rows),
rights AS (SELECT case_id, list(v.idx::DOUBLE ORDER BY pos) AS items FROM p_rows GROUP BY case_id)"""


@query("fuzzy_matches_in_chains", "E3", f"""
WITH RECURSIVE {_CHAIN}, {sql_walk(sql_near('l.v', 'r'), 'lefts', 'rights')}
SELECT case_id, max(hits)::BIGINT AS n_matched FROM walk GROUP BY case_id""")
def fuzzy_matches_in_chains(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.stored_case_rows(spark, sf).withColumn("cells", F.filter("cells", lambda c: c["col"] == "idx"))
    with_pred = rows.filter("side = 'pred'").select("case_id").distinct()
    return with_pred.join(R.fuzzy_matches(rows, dims=1), "case_id", "left").select(
        "case_id", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


_VERDICT = f"""{_STRICT}, {_FUZZY},
verdict AS (SELECT c.case_id, task, CASE
    WHEN form = 'same_text' THEN 'same_text' WHEN form = 'gold_failed' THEN 'gold_failed' WHEN form = 'pred_failed' THEN 'pred_failed'
    WHEN n_gold IS NULL THEN 'both_empty' WHEN strict_equal THEN 'strict'
    WHEN n_gold = n_pred AND coalesce(n_matched, 0) = n_gold THEN 'fuzzy' WHEN n_gold <> n_pred THEN 'row_count_mismatch'
    ELSE 'value_mismatch' END AS stage,
  CASE WHEN form IN ('same_text', 'gold_failed', 'pred_failed') THEN 0 ELSE coalesce(n_gold, 0) END AS n_gold,
  CASE WHEN form IN ('same_text', 'gold_failed', 'pred_failed') THEN 0 ELSE coalesce(n_pred, 0) END AS n_pred
  FROM cases c LEFT JOIN strict USING (case_id) LEFT JOIN fuzzy USING (case_id)),
judged AS (SELECT *, stage IN ('same_text', 'both_empty', 'strict', 'fuzzy') AS verdict FROM verdict)"""


def case_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return R.staged_verdict(I.case_pairs(spark, sf), I.case_outcomes(spark, sf),
                            I.stored_case_rows(spark, sf), dims=2)


@query("staged_verdict", "E5, E8", f"""
WITH RECURSIVE {I.CASE_ROWS}, {_VERDICT} SELECT case_id, n_gold, n_pred, stage, verdict FROM judged""")
def staged_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return case_verdicts(spark, sf)


_GATED = "stage IN ('row_count_mismatch', 'value_mismatch') AND n_gold < 31 AND n_pred < 31 AND task = 'multi_step'"
_JUDGE_REPLY = I.sql_pick(I.sql_bucket("case_id::VARCHAR", 3), "true", "false", "false")


@query("judged_verdict", "E6, E7", f"""
WITH RECURSIVE {I.CASE_ROWS}, {_VERDICT}
SELECT case_id, n_gold, n_pred, CASE WHEN {_GATED} THEN 'judge' ELSE stage END AS stage,
  CASE WHEN {_GATED} THEN {_JUDGE_REPLY} ELSE verdict END AS verdict FROM judged""")
def judged_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = case_verdicts(spark, sf)
    gated = E.judge_gate(verdicts, I.cases(spark, sf).select("case_id", "task"))
    reply = I.pick(hash_bucket(F.col("case_id").cast("string"), 3), '{"is_equivalent": true}',
                   '```json\n{"is_equivalent": false}\n```', "no idea")
    return E.with_judge_verdicts(verdicts, gated.select("case_id", reply.alias("reply")))


def _sql_accuracy(source: str) -> str:
    return f"""per AS (SELECT task, CASE WHEN task IN ('sql', 'reflection', 'multi_step', 'degenerate_dim') THEN 'sql' ELSE 'boundary' END AS grp,
  count(*) AS n_rows, count(verdict) AS n_judged, count(*) FILTER (WHERE verdict) AS n_true FROM {source} GROUP BY task),
acc AS (SELECT *, n_true / n_rows AS acc_all, CASE WHEN n_judged > 0 THEN n_true / n_judged END AS acc_judged FROM per)
SELECT coalesce(grp, 'all') AS grp, coalesce(task, 'all') AS task, sum(n_rows)::BIGINT AS n_rows, sum(n_judged)::BIGINT AS n_judged,
  sum(n_true)::BIGINT AS n_true, round(avg(acc_all), 6) AS acc_all, round(avg(acc_judged), 6) AS acc_judged
FROM acc GROUP BY ROLLUP (grp, task)"""


@query("evaluate_execution_accuracy", "E8, E12", f"""
WITH RECURSIVE {I.CASE_ROWS}, {_VERDICT}, v AS (SELECT task, CASE WHEN stage <> 'gold_failed' THEN verdict END AS verdict FROM judged),
{_sql_accuracy('v')}""")
def evaluate_execution_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = case_verdicts(spark, sf).join(I.cases(spark, sf).select("case_id", "task"), "case_id")
    usable = F.when(F.col("stage") != "gold_failed", F.col("verdict"))
    return E.accuracy(rows.select("task", usable.alias("verdict")))


@query("accuracy_by_task", "E12", f"""
WITH v AS (SELECT d.doc_id, {I.sql_pick(I.sql_bucket('d.doc_id::VARCHAR', 8), *[I.q(t) for t in I.S.TASKS])} AS task, quality = 1 AS verdict
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
{_sql_accuracy('v')}""")
def accuracy_by_task(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("verdict"))
    task = I.pick(hash_bucket(F.col("doc_id").cast("string"), 8), *I.S.TASKS)
    return E.accuracy(docs.join(labels, "doc_id", "left").withColumn("task", task))


# --- votes -----------------------------------------------------------------------

_COUNTS = "count(*) FILTER (WHERE verdict) AS n_true, count(*) FILTER (WHERE NOT verdict) AS n_false, count(*) FILTER (WHERE verdict IS NULL) AS n_failed"


@query("majority_votes", "V1, V3", f"""
WITH {I.VOTES}, c AS (SELECT case_id, {_COUNTS} FROM votes GROUP BY case_id)
SELECT *, CASE WHEN n_true > n_false THEN true WHEN n_false > n_true THEN false END AS verdict FROM c""")
def majority_votes(spark: SparkSession, sf: str) -> DataFrame:
    return V.majority_vote(I.votes(spark, sf))


@query("unanimous_votes", "V2", f"""
WITH {I.VOTES} SELECT case_id, count(*) >= 2 AND bool_and(coalesce(verdict, false)) AS verdict FROM votes GROUP BY case_id""")
def unanimous_votes(spark: SparkSession, sf: str) -> DataFrame:
    return V.unanimous_vote(I.votes(spark, sf))
