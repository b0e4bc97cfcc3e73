"""Inputs that Spark derives from the given tables, and the same derivations as SQL.

Whole tables are used throughout: the hash buckets choose a *form* for a row, never whether
it takes part.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.text import hash_bucket, prompt_key
from sqlgauge.querybook.registry import table
from sqlgauge.session import dealt, materialize, once, spread

METRICS = ("订单金额", "订单量", "客单价", "退货率", "折扣率", "毛利额")

PRIORITY_METRIC = {
    "1-URGENT": "订单金额",
    "2-HIGH": "订单量",
    "3-MEDIUM": "客单价",
    "4-NOT SPECIFIED": "退货率",
    "5-LOW": "满意程度",
}


def choose(c: Column, values: dict[str, str]) -> Column:
    out = F.lit("")
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def pick(bucket: Column, *values: Column | str) -> Column:
    """The value at a bucket number; the bucket is worked out once."""
    listed = F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])
    return F.get(listed, bucket.cast("int"))


def sql_bucket(key: str, n: int | str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 15))::BIGINT % {n})"


def sql_pick(bucket: str, *values: str) -> str:
    return "CASE " + bucket + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def q(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# --- seeds -------------------------------------------------------------------------

def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """One seed per order: a prompt in the corpus layout and a response holding SQL."""
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    cust = F.col("o_custkey").cast("string")
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    metric = choose(prio, PRIORITY_METRIC)
    no_marker = (status == "P") & (prio == "1-URGENT")
    lit = F.lit
    query = F.concat(
        lit("--- 1.role\nanalyst\n"), F.when(no_marker, lit("")).otherwise(lit(S.SCHEMA_MARKER + "\n")),
        lit("orders(o_orderkey, o_custkey, o_totalprice, o_orderstatus="), status, lit(")\n"),
        lit(S.KNOWLEDGE_MARKER + "\n指标："), metric, lit("\n"),
        F.when(prio == "2-HIGH", lit("")).otherwise(lit("  计算逻辑：sum(o_totalprice)\n")),
        lit(S.DOMAIN_MARKER + "\n"),
        F.when(prio == "4-NOT SPECIFIED", lit("")).otherwise(F.concat(lit("priority "), prio, lit("\n"))),
        lit(S.DATA_MARKER + "\n- day "), day, lit("\n" + S.FEW_SHOT_MARKER + "\n问题：客户 1 的"), metric,
        lit("，写出对应的SQL语句\nSELECT 1\n问题："), F.substring(day, 1, 4), lit("年客户 "), cust,
        lit(" 的"), metric, lit("是多少，写出对应的SQL语句"))
    sql = F.concat(lit("SELECT sum(o_totalprice) AS v FROM orders WHERE o_custkey = "), cust)
    response = (
        F.when(status == "F", F.concat(lit("SQL -> "), sql, lit("\n\nchecked")))
        .when(status == "O", F.concat(lit("<think>by customer</think>\n<answer>"), sql, lit("\n\n</answer>")))
        .otherwise(F.concat(lit("```sql\n"), sql, lit("\n```"))))
    orders = spread(table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    return orders.select(
        F.col("o_orderkey").alias("seed_id"), query.alias("query"), response.alias("response"),
        metric.alias("index_name"), status.alias("state"))


_SQL_METRIC = "CASE o_orderpriority " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in PRIORITY_METRIC.items()) + " END"
SEEDS = f"""base AS (SELECT *, {_SQL_METRIC} AS metric, strftime(o_orderdate, '%Y-%m-%d') AS day,
  'SELECT sum(o_totalprice) AS v FROM orders WHERE o_custkey = ' || o_custkey AS sql FROM orders),
seeds AS (SELECT o_orderkey AS seed_id, metric AS index_name, o_orderstatus AS state,
  '--- 1.role' || chr(10) || 'analyst' || chr(10)
  || CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '' ELSE '--- 2.schema kg' || chr(10) END
  || 'orders(o_orderkey, o_custkey, o_totalprice, o_orderstatus=' || o_orderstatus || ')' || chr(10)
  || '--- 3.knowledge graph' || chr(10) || '指标：' || metric || chr(10)
  || CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE '  计算逻辑：sum(o_totalprice)' || chr(10) END
  || '--- 4.domain kg' || chr(10)
  || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'priority ' || o_orderpriority || chr(10) END
  || '--- 5.data kg' || chr(10) || '- day ' || day || chr(10) || '--- 6.few shot' || chr(10)
  || '问题：客户 1 的' || metric || '，写出对应的SQL语句' || chr(10) || 'SELECT 1' || chr(10)
  || '问题：' || substr(day, 1, 4) || '年客户 ' || o_custkey || ' 的' || metric || '是多少，写出对应的SQL语句' AS query,
  CASE o_orderstatus WHEN 'F' THEN 'SQL -> ' || sql || chr(10) || chr(10) || 'checked'
    WHEN 'O' THEN '<think>by customer</think>' || chr(10) || '<answer>' || sql || chr(10) || chr(10) || '</answer>'
    ELSE '```sql' || chr(10) || sql || chr(10) || '```' END AS response FROM base)"""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sql_strip(expr: str) -> str:
    return _STRIP.format(expr)


SQL_SECTIONS = {
    "schema": "CASE WHEN strpos(query, '--- 2.schema kg') > 0 AND strpos(query, '--- 3.knowledge graph') > 0 THEN "
              + sql_strip("substr(query, strpos(query, '--- 2.schema kg') + 15, strpos(query, '--- 3.knowledge graph')"
                          " - strpos(query, '--- 2.schema kg') - 15)") + " ELSE '' END",
    "knowledge": sql_strip(r"regexp_extract(query, '(?s)---\s*3\.knowledge graph\s*(.*?)---\s*4\.domain kg', 1)"),
    "domain": sql_strip(r"regexp_extract(query, '(?s)---\s*4\.domain kg\s*(.*?)---\s*5\.data kg', 1)"),
    "data": "replace(" + sql_strip(r"regexp_extract(query, '(?s)---\s*5\.data kg\s*(.*?)---\s*6\.few shot', 1)")
            + ", '-', '')",
    "question": sql_strip("regexp_extract(query, '(?s).*问题：(.*?)，写出对应的SQL语句', 1)"),
}
SECTIONED = f"""{SEEDS},
sec AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in SQL_SECTIONS.items())} FROM seeds)"""


def sql_gaps(required) -> str:
    parts = ", ".join(f"CASE WHEN {n} = '' THEN '{n}' END" for n in required)
    return f"coalesce(concat_ws(',', {parts}), '')"


# --- completions --------------------------------------------------------------------

def completions(spark: SparkSession, sf: str) -> DataFrame:
    """One completion per assistant turn, in six forms, for eight tasks."""
    return as_completions(spread(table(spark, sf, "conversations")))


def as_completions(conversations: DataFrame) -> DataFrame:
    turns = conversations.filter(F.col("role") == "assistant")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    conv = F.col("conv_id").cast("string")
    rows = turns.select(key.alias("key"), "conv_id", "text", conv.alias("conv")).withColumns({
        "task_no": hash_bucket(F.col("key"), 8),
        "form": hash_bucket(F.concat("key", F.lit("v")), 6),
        "body_no": hash_bucket(F.concat("key", F.lit("s")), 4),
    })
    is_sql = F.col("task_no") < 4
    gold_sql = F.concat(F.lit("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = "), "conv",
                        F.lit(" GROUP BY o_orderstatus"))
    rows = rows.withColumns({
        "task": pick(F.col("task_no"), *S.TASKS),
        "gold": F.when(is_sql, gold_sql).otherwise(F.col("text")),
    })
    sql_body = pick(
        F.col("body_no"), F.col("gold"),
        F.concat(F.lit("select o.o_orderstatus from customer_orders_hf o where o.o_custkey = "), "conv",
                 F.lit(" -- all")),
        "SELECT count(*) AS n FROM orders ORDER BY 1 LIMIT 10", F.col("text"))
    text_body = pick(F.col("body_no"), F.col("text"), F.concat("text", F.lit(" ok")), "SELECT 1",
                     F.concat(F.lit("no "), "text"))
    rows = rows.withColumn("body", F.when(is_sql, sql_body).otherwise(text_body))
    body, lit = F.col("body"), F.lit
    content = pick(
        F.col("form"),
        F.concat(lit("<think>t</think><answer>"), body, lit("</answer>")),
        F.concat(lit("<answer>"), body, lit("</answer>")),
        F.concat(lit("<think>a</think><answer>"), body, lit("</answer><answer>y</answer>")),
        F.concat(lit("plan\n```res\n"), body, lit("\n```")),
        body,
        F.concat(lit("<think>a\nb</think>\n<answer>\n "), body, lit(" \n</answer> tail")))
    return rows.select(
        "key", F.col("conv_id").alias("prompt_id"), "task", content.alias("content"), "gold", "text",
        F.size(F.split("text", " ")).cast("bigint").alias("n_tokens"))


_GOLD = "'SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = ' || conv_id || ' GROUP BY o_orderstatus'"
COMPLETIONS = f"""turns AS (SELECT conv_id || '-' || turn AS key, conv_id, text FROM conversations WHERE role = 'assistant'),
t1 AS (SELECT *, {sql_bucket("key", 8)} AS task_no, {sql_bucket("key || 'v'", 6)} AS form, {sql_bucket("key || 's'", 4)} AS body_no FROM turns),
t2 AS (SELECT *, {sql_pick("task_no", *[q(t) for t in S.TASKS])} AS task,
  CASE WHEN task_no < 4 THEN {_GOLD} ELSE text END AS gold FROM t1),
t3 AS (SELECT *, CASE WHEN task_no < 4 THEN {sql_pick("body_no", "gold",
    "'select o.o_orderstatus from customer_orders_hf o where o.o_custkey = ' || conv_id || ' -- all'",
    "'SELECT count(*) AS n FROM orders ORDER BY 1 LIMIT 10'", "text")}
  ELSE {sql_pick("body_no", "text", "text || ' ok'", "'SELECT 1'", "'no ' || text")} END AS body FROM t2),
completions AS (SELECT key, conv_id AS prompt_id, task, gold, text, len(string_split(text, ' ')) AS n_tokens, form, body_no,
  {sql_pick("form", "'<think>t</think><answer>' || body || '</answer>'", "'<answer>' || body || '</answer>'",
    "'<think>a</think><answer>' || body || '</answer><answer>y</answer>'",
    "'plan' || chr(10) || '```res' || chr(10) || body || chr(10) || '```'", "body",
    "'<think>a' || chr(10) || 'b</think>' || chr(10) || '<answer>' || chr(10) || ' ' || body || ' ' || chr(10) || '</answer> tail'")} AS content FROM t3)"""


# --- votes, vectors -------------------------------------------------------------------

def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Three votes per case from consecutive events."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).cast("bigint").alias("case_id"),
        (F.col("event_id") % 3).cast("int").alias("judge_id"),
        F.when(kind.isin("click", "view"), True).when(kind.isin("signup", "purchase"), False).alias("verdict"))


VOTES = """votes AS (SELECT event_id // 3 AS case_id, event_id % 3 AS judge_id,
  CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type IN ('signup', 'purchase') THEN false END AS verdict
  FROM events)"""


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector and a mix of it with its successor; the first one follows the last."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    n = (emb.agg(F.max("vec_id")).first()[0] or 0) + 1
    nxt = emb.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("a").alias("b"))
    weight = (F.col("vec_id") % 6) * F.lit(0.12)
    return emb.join(nxt, "vec_id").select(
        F.col("vec_id").alias("pair_id"), F.col("a").alias("emb_gold"),
        F.zip_with("a", "b", lambda x, y: x + y * weight).alias("emb_pred"))


PAIRS = """pairs AS (SELECT e.vec_id AS pair_id, e.embedding::DOUBLE[] AS emb_gold,
  list_transform(list_zip(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), lambda z: z[1] + z[2] * ((e.vec_id % 6) * 0.12::DOUBLE)) AS emb_pred
  FROM embeddings e JOIN embeddings f ON f.vec_id = (e.vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings))"""


# --- result sets --------------------------------------------------------------------------

RESULT_FORMS = ("identical", "scaled_little", "scaled_much", "row_dropped", "column_renamed",
                "column_added", "both_empty", "pred_failed", "gold_failed", "same_text")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One comparison case per customer; the form decides how pred differs from gold."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("case_id"),
        pick(hash_bucket(F.col("c_custkey").cast("string"), 10), *RESULT_FORMS).alias("form"),
        pick(hash_bucket(F.concat(F.col("c_custkey").cast("string"), F.lit("t")), 3),
             "sql", "reflection", "multi_step").alias("task"))


CASES = f"""cases AS (SELECT c_custkey AS case_id, {sql_pick(sql_bucket("c_custkey::VARCHAR", 10), *[q(f) for f in RESULT_FORMS])} AS form,
  {sql_pick(sql_bucket("c_custkey || 't'", 3), "'sql'", "'reflection'", "'multi_step'")} AS task FROM customer)"""


def case_pairs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("SELECT amount, idx, status FROM case_orders WHERE customer = "),
                    F.col("case_id").cast("string"))
    return cases(spark, sf).select(
        "case_id", text.alias("gold_sql"),
        F.when(F.col("form") == "same_text", text).otherwise(F.concat(text, F.lit(" ORDER BY 1"))).alias("pred_sql"))


def case_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("case_id", (F.col("form") != "gold_failed").alias("gold_ok"),
                                   (F.col("form") != "pred_failed").alias("pred_ok"))


def _cells(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("col"), v.cast("string").alias("val"))
                     for n, v in sorted(values.items())])


def stored_case_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows as a stored table, as a run of statements leaves them."""
    return materialize(case_rows(spark, sf), "case-rows")


def case_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of both sides: a customer's orders with amount, a narrow index and status."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    index = (amount * F.lit(Decimal("0.000004")) + F.lit(Decimal("1000"))).cast("decimal(18,4)")
    orders = dealt(table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("row_no"), amount.alias("amount"),
        index.alias("idx"), F.col("o_orderstatus").alias("status"))
    first = orders.groupBy("case_id").agg(F.min("row_no").alias("first_row"))
    rows = orders.join(cases(spark, sf).select("case_id", "form"), "case_id").join(first, "case_id").filter(
        F.col("form") != "both_empty")
    form, amt, idx, st = F.col("form"), F.col("amount"), F.col("idx"), F.col("status")
    gold = rows.select("case_id", F.lit("gold").alias("side"), "row_no",
                       _cells(amount=amt, idx=idx, status=st).alias("cells"))
    factor = F.when(form == "scaled_little", F.lit(Decimal("1.0005"))).when(
        form == "scaled_much", F.lit(Decimal("1.0100"))).otherwise(F.lit(Decimal("1.0000"))).cast("decimal(5,4)")
    a = F.when(form.isin("scaled_little", "scaled_much"),
               (amt * factor).cast("decimal(18,4)").cast("string")).otherwise(amt.cast("string"))
    i = F.when(form.isin("scaled_little", "scaled_much"),
               (idx * factor).cast("decimal(18,4)").cast("string")).otherwise(idx.cast("string"))
    cells = (
        F.when(form == "column_renamed", _cells(amount=a, idx=i, state=st))
        .when(form == "column_added", _cells(amount=a, extra=st, idx=i, status=st))
        .otherwise(_cells(amount=a, idx=i, status=st)))
    dropped = (form == "row_dropped") & (F.col("row_no") == F.col("first_row"))
    pred = rows.filter(~dropped & ~form.isin("pred_failed", "gold_failed")).select(
        "case_id", F.lit("pred").alias("side"), (-F.col("row_no")).alias("row_no"), cells.alias("cells"))
    return gold.unionByName(pred)


_SQL_SCALED = "form IN ('scaled_little', 'scaled_much')"
CASE_ROWS = f"""{CASES},
co AS (SELECT o_custkey AS case_id, o_orderkey AS row_no, o_totalprice::DECIMAL(18,2) AS amount,
  (o_totalprice::DECIMAL(18,2) * 0.000004 + 1000)::DECIMAL(18,4) AS idx, o_orderstatus AS status FROM orders),
cf AS (SELECT co.*, form, min(row_no) OVER (PARTITION BY co.case_id) AS first_row FROM co JOIN cases USING (case_id) WHERE form <> 'both_empty'),
cg AS (SELECT case_id, row_no AS pos, form, {{'amount': amount::VARCHAR, 'idx': idx::VARCHAR, 'status': status}} AS v FROM cf),
cp AS (SELECT case_id, -row_no AS pos, form,
  {{'amount': CASE WHEN {_SQL_SCALED} THEN (amount * (CASE form WHEN 'scaled_little' THEN 1.0005 ELSE 1.0100 END))::DECIMAL(18,4)::VARCHAR ELSE amount::VARCHAR END,
    'idx': CASE WHEN {_SQL_SCALED} THEN (idx * (CASE form WHEN 'scaled_little' THEN 1.0005 ELSE 1.0100 END))::DECIMAL(18,4)::VARCHAR ELSE idx::VARCHAR END,
    'status': status}} AS v
  FROM cf WHERE form NOT IN ('pred_failed', 'gold_failed') AND NOT (form = 'row_dropped' AND row_no = first_row)),
g_rows AS (SELECT case_id, pos, '[{{"col":"amount","val":"' || v.amount || '"}},{{"col":"idx","val":"' || v.idx || '"}},{{"col":"status","val":"' || v.status || '"}}]' AS row, v FROM cg),
p_rows AS (SELECT case_id, pos, '[{{"col":"amount","val":"' || v.amount || '"}},'
  || CASE WHEN form = 'column_added' THEN '{{"col":"extra","val":"' || v.status || '"}},' ELSE '' END
  || '{{"col":"idx","val":"' || v.idx || '"}},{{"col":"' || CASE WHEN form = 'column_renamed' THEN 'state' ELSE 'status' END || '","val":"' || v.status || '"}}]' AS row,
  v, form FROM cp)"""


def word_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of each document and of its successor (the first one follows the last), over the whole texts."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.array_distinct(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("words"))
    n = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    nxt = docs.select(F.pmod(F.col("doc_id") - 1, F.lit(n)).alias("doc_id"), F.col("words").alias("gold"))
    return docs.join(nxt, "doc_id").select("doc_id", F.col("words").alias("pred"), "gold")


WORD_SETS = """docs AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')) AS words FROM documents),
word_sets AS (SELECT a.doc_id, a.words AS pred, b.words AS gold FROM docs a JOIN docs b ON b.doc_id = (a.doc_id + 1) % (SELECT max(doc_id) + 1 FROM docs))"""


# --- replies ---------------------------------------------------------------------------------

def replies(asked: DataFrame, prompt: Column, text: Column, *also: str) -> DataFrame:
    """Stub response table: ``text`` may use ``prompt_key`` and the columns of ``asked``."""
    keyed = once(asked, prompt_key=prompt_key(prompt)).filter(F.col("prompt_key").isNotNull())
    return keyed.select("prompt_key", *also, text.alias("text")).dropDuplicates(["prompt_key", *also])
