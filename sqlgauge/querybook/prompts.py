"""Queries over prompts: sources and sinks, sections, text mutation, request texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions import sqltext as Q
from sqlgauge.functions import templates as T
from sqlgauge.functions import text as X
from sqlgauge.plans.evaluate import route_of, task_of
from sqlgauge.plans.mutate import with_gaps
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.registry import query
from sqlgauge.session import scratch_path
from sqlgauge.sources import exchange, tables
from sqlgauge.functions.replies import sql_in_reply
from sqlgauge.operators.sampling import fault_for


def sql_render(template_id: str, **values: str) -> str:
    parts = []
    for i, piece in enumerate(T._SLOT.split(T.TEMPLATES[template_id])):
        if i % 2 == 0 and piece:
            parts.append(I.q(piece))
        elif i % 2:
            parts.append(f"coalesce(({values[piece]})::VARCHAR, '')")
    return "(" + " || ".join(parts) + ")"


#: Rows of a CSV file at most.
CSV_ROWS = 50_000


# --- sources and sinks ----------------------------------------------------------

def _round_trip(df: DataFrame, name: str) -> str:
    """Written in files of a bounded number of rows: a file with line ends in its fields is read by one task."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(header=True, quote='"', escape='"', maxRecordsPerFile=CSV_ROWS).csv(path)
    return path


@query("scan_seed_corpus", "S1", f"WITH {I.SEEDS} SELECT query, response, NULL::VARCHAR AS index_name FROM seeds")
def scan_seed_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = _round_trip(I.seeds(spark, sf).select("query", "response"), "seed-csv")
    return tables.read_seeds(spark, path, "csv")


@query("scan_example_pool", "S2", f"WITH {I.SECTIONED} SELECT question AS original_question, response FROM sec WHERE state = 'O'")
def scan_example_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = I.seeds(spark, sf).filter("state = 'O'").select(
        X.question_text(F.col("query")).alias("original_question"), "response")
    return tables.read_examples(spark, _round_trip(pool, "example-csv"), "csv")


@query("scan_constraint_seeds", "S3", f"WITH {I.SEEDS} SELECT query, response FROM seeds WHERE index_name <> '满意程度'")
def scan_constraint_seeds(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "constraint-seeds")
    I.seeds(spark, sf).filter(F.col("index_name") != "满意程度").select("query", "response").write.parquet(path)
    return tables.read_seeds(spark, path).select("query", "response")


@query("scan_evaluation_set", "S4", f"WITH {I.COMPLETIONS} SELECT text AS query, content AS response, gold AS answer, task AS type FROM completions")
def scan_evaluation_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.completions(spark, sf).select(
        F.col("text").alias("query"), F.col("content").alias("response"), F.col("gold").alias("answer"),
        F.col("task").alias("type"))
    return tables.read_evaluation(spark, _round_trip(rows, "evaluation-csv"), "csv")


@query("append_checkpoint", "S5", f"WITH {I.SEEDS} SELECT state, count(*) AS n_rows, count(DISTINCT query) AS n_prompts FROM seeds GROUP BY state")
def append_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "checkpoint")
    rows = I.seeds(spark, sf).select(F.col("query").alias("original_prompt"), "state")
    for state in ("O", "none", "P", "F"):
        tables.append_rows(rows.filter(F.col("state") == state), path)
    done = spark.read.parquet(path).groupBy("state", X.prompt_key(F.col("original_prompt")).alias("k")).agg(
        F.count("*").alias("n"))
    return done.groupBy("state").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_prompts"))


@query("write_annotated_table", "S6", f"WITH {I.COMPLETIONS} SELECT key AS row_id, content, form <> 4 AND form <> 3 AS tagged FROM completions")
def write_annotated_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "annotated")
    rows = I.completions(spark, sf).select(
        F.col("key").alias("row_id"), "content", F.col("content").contains("<answer>").alias("tagged"))
    tables.write_annotated(rows, path)
    return spark.read.parquet(path)


@query("exchange_requests", "S9, X6", f"""
WITH {I.SECTIONED}, p AS (SELECT seed_id, {sql_render('judge_sentences', sentence_a='question', sentence_b='knowledge')} || {I.q(T.CLOSED_SUFFIX)} AS prompt FROM sec),
r AS (SELECT sha256(prompt) AS k, 'reply ' || {I.sql_bucket('sha256(prompt)', 100)} AS text FROM p GROUP BY prompt)
SELECT seed_id, CASE WHEN {I.sql_bucket('k', 4)} > 0 THEN text END AS reply FROM p JOIN r ON k = sha256(prompt)""")
def exchange_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_sections(I.seeds(spark, sf))
    prompt = T.render("judge_sentences", sentence_a=F.col("question"), sentence_b=F.col("knowledge"))
    requests = exchange.request_table(rows, prompt, T.CLOSED_SUFFIX)
    responses = requests.filter(X.hash_bucket(F.col("prompt_key"), 4) > 0).select(
        "prompt_key", F.concat(F.lit("reply "), X.hash_bucket(F.col("prompt_key"), 100).cast("string")).alias("text"))
    return exchange.attach_responses(rows, prompt, responses, suffix=T.CLOSED_SUFFIX).select("seed_id", "reply")


# --- sections and mutation --------------------------------------------------------

@query("prompt_sections", "T1, T2, T3, T4, T5", f"""
WITH {I.SECTIONED} SELECT seed_id, schema, knowledge, domain, data, question FROM sec""")
def prompt_sections(spark: SparkSession, sf: str) -> DataFrame:
    return X.with_sections(I.seeds(spark, sf)).select("seed_id", *X.SECTIONS)


@query("replace_question", "T6", f"""
WITH {I.SEEDS} SELECT seed_id, regexp_replace(query, '(?s)^(.*?问题：).*?(，写出对应的SQL语句.*)$', '\\1') || '2025 ' || state
  || regexp_extract(query, '(?s)^(.*?问题：).*?(，写出对应的SQL语句.*)$', 2) AS new_prompt FROM seeds""")
def replace_question(spark: SparkSession, sf: str) -> DataFrame:
    return I.seeds(spark, sf).select(
        "seed_id", X.replace_question(F.col("query"), F.concat(F.lit("2025 "), "state")).alias("new_prompt"))


@query("section_rows", "T7", f"""
WITH {I.SECTIONED} SELECT seed_id, unnest(['schema', 'knowledge', 'domain', 'data', 'question']) AS section,
  unnest([schema, knowledge, domain, data, question]) AS text FROM sec""")
def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.section_rows(I.seeds(spark, sf), "seed_id")


@query("prompt_gaps", "T7", f"""
WITH {I.SECTIONED} SELECT seed_id, {I.sql_gaps(S.REQUIRED_SECTIONS['reflection'])} AS gaps FROM sec""")
def prompt_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return with_gaps(I.seeds(spark, sf), "reflection").select("seed_id", "gaps")


@query("context_before_examples", "T8", f"""
WITH {I.SEEDS} SELECT seed_id, {I.sql_strip("split_part(query, '--- 6.few shot', 1)")} AS context FROM seeds""")
def context_before_examples(spark: SparkSession, sf: str) -> DataFrame:
    return I.seeds(spark, sf).select("seed_id", X.context_before_examples(F.col("query")).alias("context"))


@query("insert_constraint", "T9", f"""
WITH {I.SEEDS} SELECT seed_id, CASE WHEN strpos(query, chr(10) || '  计算逻辑：') > 0 THEN
  replace(query, chr(10) || '  计算逻辑：', chr(10) || '必备约束：status ' || state || chr(10) || '  计算逻辑：') END AS new_prompt FROM seeds""")
def insert_constraint(spark: SparkSession, sf: str) -> DataFrame:
    return I.seeds(spark, sf).select("seed_id", X.insert_constraint(
        F.col("query"), F.concat(F.lit("status "), "state")).alias("new_prompt"))


# --- requests ----------------------------------------------------------------------

_KNOW = {n: n for n in ("schema", "knowledge", "domain", "data")}
_RENDERED = {
    "clarify_rewrite": {"categories": I.q(T.CLARIFY_CATEGORIES), "schema": "schema", "question": "question"},
    "clarify_reasoning": {"context": "data", "question": "question", "reason": "state"},
    "reject_reasoning": {"schema": "schema", "question": "question"},
    "constraint_extract": {**_KNOW, "question": "question"},
    "constraint_check": {"question": "question", "constraint": "state"},
    "constraint_reasoning": {"prompt": "query", "example": "question", "example_think": "state"},
    "steps_question": dict(_KNOW),
    "steps_sql": {**_KNOW, "question": "question", "analysis": "state"},
    "steps_check": {**_KNOW, "question": "question", "sql": "response"},
    "steps_reasoning": {**_KNOW, "question": "question", "sql": "response"},
}


@query("render_requests", "T10", f"""
WITH {I.SECTIONED} SELECT seed_id, {", ".join(f"sha256({sql_render(t, **v)}) AS {t}" for t, v in _RENDERED.items())} FROM sec""")
def render_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_sections(I.seeds(spark, sf))
    value = lambda v: v.strip("'") if v.startswith("'") else F.col(v)
    return rows.select("seed_id", *[
        X.prompt_key(T.render(t, **{k: value(v) for k, v in slots.items()})).alias(t)
        for t, slots in _RENDERED.items()])


_FAULT_ROWS = ", ".join(f"({i}, {I.q(f.name)}, {I.q(f.instruction)})" for i, f in enumerate(S.FAULT_TYPES))


@query("fault_requests", "T11, X4", f"""
WITH {I.SECTIONED}, faults(i, name, instruction) AS (VALUES {_FAULT_ROWS}),
s AS (SELECT sec.*, name, instruction, 'SELECT sum(o_totalprice) AS v FROM orders WHERE o_custkey = '
  || regexp_extract(question, '客户 (\\d+)', 1) AS sql FROM sec JOIN faults ON i = {I.sql_bucket('query', 10)})
SELECT seed_id, name AS fault, {sql_render('fault_injection', fault='name', instruction='instruction', sql='sql')} AS request,
  sha256({sql_render('fault_reflection', schema='schema', knowledge='knowledge', domain='domain', question='question',
                     wrong_sql='sql', message='name', right_sql='sql')}) AS reflection_key FROM s""")
def fault_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_sections(I.seeds(spark, sf)).withColumns({
        "f": fault_for(F.col("query")), "sql": sql_in_reply(F.col("response"))})
    return rows.select(
        "seed_id", F.col("f.name").alias("fault"),
        T.render("fault_injection", fault=F.col("f.name"), instruction=F.col("f.instruction"),
                 sql=F.col("sql")).alias("request"),
        X.prompt_key(T.render(
            "fault_reflection", schema=F.col("schema"), knowledge=F.col("knowledge"), domain=F.col("domain"),
            question=F.col("question"), wrong_sql=F.col("sql"), message=F.col("f.name"),
            right_sql=F.col("sql"))).alias("reflection_key"))


@query("judge_requests", "T12", f"""
WITH {I.SECTIONED} SELECT seed_id,
  {sql_render('judge_sql', question='question', schema='schema', sql_a='response', sql_b='state')} AS sql_request,
  {sql_render('judge_sentences', sentence_a='question', sentence_b='response')} AS sentence_request,
  sha256({sql_render('judge_results', question='question', result_a='response', result_b='state', **_KNOW)}) AS result_key FROM sec""")
def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_sections(I.seeds(spark, sf))
    c = F.col
    return rows.select(
        "seed_id",
        T.render("judge_sql", question=c("question"), schema=c("schema"), sql_a=c("response"),
                 sql_b=c("state")).alias("sql_request"),
        T.render("judge_sentences", sentence_a=c("question"), sentence_b=c("response")).alias("sentence_request"),
        X.prompt_key(T.render("judge_results", question=c("question"), result_a=c("response"), result_b=c("state"),
                              **{n: c(n) for n in _KNOW})).alias("result_key"))


def _sql_others() -> str:
    names = S.TASK_DEFINITIONS
    listing = lambda own: "\n".join(f"{n}: {d}" for n, d in names.items() if n != own)
    cases = " ".join(f"WHEN '{n}' THEN {I.q(listing(n))}" for n in names)
    return f"CASE task {cases} ELSE {I.q(listing(None))} END"


@query("task_exclusion_requests", "T14", f"""
WITH {I.COMPLETIONS} SELECT key, {sql_render('task_exclusion', context='prompt_id', question='text', answer='gold', types=_sql_others())} AS request FROM completions""")
def task_exclusion_requests(spark: SparkSession, sf: str) -> DataFrame:
    return I.completions(spark, sf).select("key", T.render(
        "task_exclusion", context=F.col("prompt_id"), question=F.col("text"), answer=F.col("gold"),
        types=T.other_task_list(F.col("task"))).alias("request"))


@query("constraint_replies", "T15", f"""
WITH {I.SECTIONED}, r AS (SELECT seed_id, CASE state WHEN 'F' THEN '思考过程：x' || chr(10) || '必备约束： need ' || question || chr(10) || 'end'
  WHEN 'O' THEN '必备约束：无' ELSE 'nothing' END AS reply, CASE state WHEN 'F' THEN ' 是' || chr(10) ELSE '否' END AS flag, state, question FROM sec)
SELECT seed_id, CASE state WHEN 'F' THEN 'need ' || question END AS needed, state = 'F' AS has_time FROM r""")
def constraint_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_sections(I.seeds(spark, sf))
    state = F.col("state")
    reply = F.when(state == "F", F.concat(F.lit("思考过程：x\n必备约束： need "), "question", F.lit("\nend"))).when(
        state == "O", F.lit("必备约束：无")).otherwise(F.lit("nothing"))
    flag = F.when(state == "F", F.lit(" 是\n")).otherwise(F.lit("否"))
    return rows.select("seed_id", X.constraint_line(reply).alias("needed"), X.mentions_time(flag).alias("has_time"))


# --- predicates and canonical SQL ------------------------------------------------------

_TYPE_NAMES = {v: k for k, v in S.REWARD_TYPES.items()}
_SQL_TYPE = "CASE task " + " ".join(f"WHEN '{t}' THEN {I.q(n)}" for t, n in _TYPE_NAMES.items()) + " END"


@query("route_by_type", "F1, F2, F3", f"""
WITH {I.COMPLETIONS}, n AS (SELECT *, {_SQL_TYPE} AS type FROM completions)
SELECT key, CASE WHEN type IN ('多步推理', '反思数据') THEN 'exec' WHEN type = '维度退化' THEN 'judge'
  WHEN type = '歧义澄清' THEN 'semantic' ELSE 'unknown' END AS route, task AS reward_task,
  content ILIKE '%select%' AS has_select, upper(content) LIKE '%SELECT%' AS answer_sql,
  upper(gold) LIKE '%SELECT%' AND gold NOT LIKE '%不支持查询%' AS gold_sql FROM n""")
def route_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.completions(spark, sf).withColumn("type", I.choose(F.col("task"), _TYPE_NAMES))
    return rows.select(
        "key", route_of(task_of(F.col("type"))).alias("route"),
        task_of(F.col("type"), S.REWARD_TYPES).alias("reward_task"),
        Q.contains_select(F.col("content")).alias("has_select"), Q.is_sql_answer(F.col("content")).alias("answer_sql"),
        Q.is_sql_gold(F.col("gold")).alias("gold_sql"))


@query("canonical_statements", "F8, F9", f"""
WITH c AS (SELECT c_custkey, {I.sql_bucket('c_custkey::VARCHAR', 4)} AS form FROM customer)
SELECT c_custkey, 'SELECT c_name , count ( * ) AS n FROM customer WHERE c_custkey = ' || c_custkey ||
  ' AND c_name <> ''A -- b'' GROUP BY c_name' AS canonical, form < 3 AS same FROM c WHERE form < 3
UNION ALL SELECT c_custkey, 'SELECT c_name FROM customer WHERE c_custkey = ' || c_custkey, false FROM c WHERE form = 3""")
def canonical_statements(spark: SparkSession, sf: str) -> DataFrame:
    from sqlgauge.querybook.registry import table

    key = F.col("c_custkey").cast("string")
    plain = F.concat(F.lit("SELECT c_name, count(*) AS n FROM customer WHERE c_custkey = "), key,
                     F.lit(" AND c_name <> 'A -- b' GROUP BY c_name"))
    noisy = F.concat(F.lit("Answer: select C_Name,\n  Count( * ) as N -- how many\nfrom customer /* all\n of them */ "
                           "where c_custkey="), key, F.lit(" and C_NAME<>'A -- b' group by c_name ;"))
    spaced = F.concat(F.lit("\tSELECT  c_name , COUNT(*)  AS n\nFROM Customer WHERE C_CUSTKEY =   "), key,
                      F.lit("\nAND c_name <> 'A -- b'\nGROUP   BY c_name;;"))
    other = F.concat(F.lit("select c_name from customer where c_custkey = "), key)
    text = I.pick(X.hash_bucket(key, 4), plain, noisy, spaced, other)
    return table(spark, sf, "customer").select(
        "c_custkey", Q.canonical_sql(text).alias("canonical"),
        (Q.canonical_sql(text) == Q.canonical_sql(plain)).alias("same"))
