"""Queries that run SQL statements as data, and the mutations that need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.text import hash_bucket, prompt_key, with_sections
from sqlgauge.plans import mutate as M
from sqlgauge.plans.execution import validity
from sqlgauge.operators.resultsets import row_text
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.mutations import _DRAWS, _b, _draws
from sqlgauge.querybook.prompts import sql_render
from sqlgauge.querybook.registry import query, table
from sqlgauge.session import materialize_small, passing_tables
from sqlgauge.sources import runner

_KNOW = {n: n for n in ("schema", "knowledge", "domain", "data")}


def _session(spark: SparkSession, sf: str) -> SparkSession:
    views = {n: f"{sf}/{n}.parquet" for n in ("customer", "orders", "nation")}
    return runner.guarded_session(spark, views)


def _run(spark: SparkSession, sf: str, statements: DataFrame, sql: str) -> runner.Corpus:
    """Run in a session of its own."""
    return runner.run_statements(_session(spark, sf), runner.statement_table(statements, sql))


# --- statements about customers -----------------------------------------------------------

_RESULT_SQL = ("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = ", " GROUP BY o_orderstatus")


@query("run_statements", "S7", """
SELECT o_custkey, '[{"col":"n","val":"' || count(*) || '"},{"col":"o_orderstatus","val":"' || o_orderstatus || '"}]' AS row
FROM orders GROUP BY o_custkey, o_orderstatus""")
def run_statements(spark: SparkSession, sf: str) -> DataFrame:
    """A statement for every customer who ordered; the rows of all results."""
    text = F.concat(F.lit(_RESULT_SQL[0]), F.col("o_custkey").cast("string"), F.lit(_RESULT_SQL[1]))
    asked = table(spark, sf, "orders").select("o_custkey").distinct().withColumn("sql", text)
    rows = _run(spark, sf, asked, "sql").rows
    return asked.withColumn("sql_key", prompt_key(F.col("sql"))).join(rows, "sql_key").select(
        "o_custkey", row_text(F.col("cells")).alias("row"))


# Right statement, what becomes of it, the engine's condition, fault and category. {c} is a customer, so there is
# a statement for each; {n} is a nation, of which there are few.
_COUNT = "SELECT count(*) AS n FROM customer WHERE c_custkey = {c}"
_NAMES = "SELECT c_name FROM customer WHERE c_mktsegment = 'F' AND c_custkey = {c}"
_FORMS = (
    (_COUNT, _COUNT, None, None, None),
    (_COUNT, "SELEC count(*) AS n FROM customer WHERE c_custkey = {c}", "PARSE_SYNTAX_ERROR", "keyword_misspelling", "syntax"),
    (_COUNT, "SELECT cuont(*) AS n FROM customer WHERE c_custkey = {c}", "UNRESOLVED_ROUTINE", "function_misspelling", "syntax"),
    (_NAMES, "SELECT @c_name FROM customer WHERE c_mktsegment = 'F' AND c_custkey = {c}", "PARSE_SYNTAX_ERROR",
     "illegal_character", "syntax"),
    (_NAMES, "SELECT c_name FROM customer WHERE c_mktsegment 'F' AND c_custkey = {c}", "UNSUPPORTED_TYPED_LITERAL",
     "operator_deletion", "syntax"),
    (_COUNT, "SELECT count(* AS n FROM customer WHERE c_custkey = {c}", "PARSE_SYNTAX_ERROR", "operator_deletion", "syntax"),
    ("SELECT c_name FROM customer WHERE c_custkey = {c}",
     "SELECT c_name FROM customer WHERE c_custkey = {c} UNION ALL SELECT c_name, 1 FROM customer", "NUM_COLUMNS_MISMATCH",
     "union_column_mismatch", "syntax"),
    (_COUNT, "SELECT row_number() AS r FROM customer WHERE c_custkey = {c}", "WINDOW_FUNCTION_WITHOUT_OVER_CLAUSE",
     "window_without_over", "syntax"),
    (_COUNT, "SELECT c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE a.c_custkey = {c}",
     "AMBIGUOUS_REFERENCE", "ambiguous_column", "identifier"),
    (_COUNT, "SELECT 1 / (c_nationkey - c_nationkey) AS x FROM customer WHERE c_nationkey = {n}", "DIVIDE_BY_ZERO",
     "division_by_zero", "runtime"),
    (_COUNT, "SELECT c_mktsegment + {n} AS x FROM customer", "CAST_INVALID_INPUT", "type_conversion", "runtime"),
    (_COUNT, "SELECT c_name, count(*) AS n FROM customer WHERE c_custkey = {c} GROUP BY c_nationkey", "MISSING_AGGREGATION",
     "invalid_group_by", "runtime"),
    (None, "DROP TABLE customer_{n}", "PARSE_SYNTAX_ERROR", None, "syntax"),
    (None, "SELECT {n} AS a; SELECT 2 AS b", "PARSE_SYNTAX_ERROR", None, "syntax"),
    (_COUNT, "SELECT reflect('java.lang.Math', 'abs', {n}) AS x", "FORBIDDEN_CALL", None, None),
    (_COUNT, " \n", "BLANK_STATEMENT", None, None),
    (_COUNT, "SELECT nope FROM customer WHERE c_custkey = {c}", "UNRESOLVED_COLUMN.WITH_SUGGESTION", None, "identifier"),
    (_COUNT, "SELECT * FROM parquet.`/nation_{n}`", "TABLE_OR_VIEW_NOT_FOUND", None, "identifier"),
)
_FORM_ROWS = ", ".join(
    f"({i}, {', '.join(I.q(v) if v else 'NULL' for v in f[2:])})" for i, f in enumerate(_FORMS))


@query("statement_outcomes", "S7, S8, M6", f"""
WITH f(form, condition, fault, category) AS (VALUES {_FORM_ROWS})
SELECT c_custkey, condition IS NULL AS ok, condition, fault, category FROM customer JOIN f ON form = c_custkey % {len(_FORMS)}""")
def statement_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A statement for every customer, broken in some way, and what is wrong with it."""
    def filled(text: str | None) -> Column:
        cust, nation = (F.col(c).cast("string") for c in ("c_custkey", "c_nationkey"))
        return F.replace(F.replace(F.lit(text), F.lit("{c}"), cust), F.lit("{n}"), nation)

    form = F.col("c_custkey") % len(_FORMS)
    asked = table(spark, sf, "customer").select(
        "c_custkey", I.pick(form, *[filled(f[0]) for f in _FORMS]).alias("right"),
        I.pick(form, *[filled(f[1]) for f in _FORMS]).alias("sql"))
    outcomes = _run(spark, sf, asked, "sql").outcomes
    return asked.withColumn("sql_key", prompt_key(F.col("sql"))).join(outcomes, "sql_key").withColumn(
        "f", runner.fault_category(F.col("condition"), F.col("sql"), F.col("right"))).select(
        "c_custkey", "ok", "condition", F.col("f.fault").alias("fault"), F.col("f.category").alias("category"))


@query("statement_validity", "S7, W2", """
SELECT c_custkey, c_custkey % 3 <> 1 AS valid FROM customer""")
def statement_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Analyse only: wrong names are found, wrong values are not."""
    key = F.col("c_custkey").cast("string")
    text = I.pick(F.col("c_custkey") % 3, F.concat(F.lit("SELECT c_name FROM customer WHERE c_custkey = "), key),
                  F.concat(F.lit("SELECT c_nome FROM customer WHERE c_custkey = "), key),
                  F.concat(F.lit("SELECT 1 / 0 AS x, c_name FROM customer WHERE c_custkey = "), key))
    asked = table(spark, sf, "customer").select("c_custkey", text.alias("sql"))
    known = validity(_session(spark, sf), asked, "sql")
    return asked.withColumn("sql_key", prompt_key(F.col("sql"))).join(known, "sql_key").select("c_custkey", "valid")


# --- multi-step rows ------------------------------------------------------------------------

def _steps_reply(sql: Column) -> Column:
    body = F.concat(F.lit('{"thought_process":"t","solution_steps":["a","b"],"question":"how much '), "index_name",
                    F.lit('","question_analysis":"n","sql":"'), sql, F.lit('"}'))
    return body


_STEP_SQL = "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"
_STEP_BAD = "SELECT count(*) AS n FROM orderz"


@query("multi_step_rows", "M4", f"""
WITH {_DRAWS},
a AS (SELECT *, {I.sql_gaps(S.REQUIRED_SECTIONS['multi_step'])} AS gaps, {sql_render('steps_question', **_KNOW)} AS p FROM draws),
b AS (SELECT *, CASE WHEN gaps = '' THEN {I.sql_bucket('sha256(p)', 5)} END AS form, 'how much ' || index_name AS qn FROM a),
c AS (SELECT *, CASE WHEN form < 4 THEN {I.sql_bucket("sha256(" + sql_render('steps_sql', question='qn', analysis="'n'", **_KNOW) + ") || 'q'", 4)} END AS form2 FROM b),
d AS (SELECT *, {I.sql_pick('form2', I.q(_STEP_SQL), I.q(_STEP_SQL), I.q(_STEP_BAD), 'NULL')} AS sql FROM c),
e AS (SELECT *, sha256({sql_render('steps_check', question='qn', sql='sql', **_KNOW)}) AS k FROM d),
s AS (SELECT *, CASE WHEN gaps <> '' THEN 'missing: ' || gaps WHEN form = 4 THEN 'no_question' WHEN form2 = 3 THEN 'no_sql'
  WHEN form2 = 2 THEN 'sql_failed' WHEN {I.sql_bucket("k || '0'", 3)} = 2 OR {I.sql_bucket("k || '1'", 3)} = 2 THEN 'not_accepted' ELSE 'ok' END AS status FROM e)
SELECT query AS original_prompt, CASE WHEN form < 4 THEN 't' END AS thought_process, CASE WHEN form < 4 THEN 'a,b' END AS steps,
  CASE WHEN form < 4 THEN qn WHEN form = 4 THEN 'x' END AS question, sql, CASE WHEN sql IS NOT NULL THEN 'because' END AS cot_process, status FROM s""")
def multi_step_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stepped(spark, sf, I.seeds(spark, sf))


def stepped(spark: SparkSession, sf: str, seeds: DataFrame) -> DataFrame:
    draws = materialize_small(_draws(spark, sf, seeds.select("seed_id", "query", "index_name")), "draws")
    asked = M.with_gaps(draws, "multi_step")
    full = _steps_reply(F.lit("SELECT 1"))
    first = materialize_small(I.replies(asked, M.steps_request(), I.pick(
        _b(5), full, F.concat(F.lit("```json\n"), full, F.lit("\n```")), full, full, '{"question":"x"}')), "replies")
    invented = M.steps_candidates(draws, first)
    second = materialize_small(I.replies(invented, M.steps_sql_request(), I.pick(
        _b(4, "q"), f'{{"sql":"{_STEP_SQL}"}}', f'```json\n{{"sql":"{_STEP_SQL}"}}\n```', f'{{"sql":"{_STEP_BAD}"}}',
        "no")), "replies")
    candidates = materialize_small(M.steps_candidates(draws, first.unionByName(second)), "candidates")
    outcomes = _run(spark, sf, candidates, "sql").outcomes
    judges = candidates.withColumn("judge_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
    reply = I.pick(hash_bucket(F.concat("prompt_key", F.col("judge_id").cast("string")), 3), '{"is_correct": true}',
                   '```json\n{"is_correct": true}\n```', '{"is_correct": false}')
    votes = I.replies(judges, M.steps_check_request(), reply, "judge_id")
    third = I.replies(candidates, M.steps_reasoning_request(), F.lit(" because\n"))
    rows = M.steps_rows(candidates, outcomes, votes, third)
    return rows.withColumn("steps", F.array_join("steps", ","))


# --- reflection rows ------------------------------------------------------------------------

_WRONG = ("SELEC sum(o_totalprice) FROM orders", "SELECT sum(o_totalprice) AS v FROM orders", "SELECT nope FROM orders",
          "SELECT o_orderkey / 0 AS v FROM orders")


def _fault_reply() -> Column:
    item = lambda kind, no: F.concat(
        F.lit('{"error_type_applied":"' + kind + '","modified_sql":"'),
        I.pick(hash_bucket(F.concat("prompt_key", F.lit(no)), 4), *_WRONG), F.lit('"}'))
    both = F.concat(F.lit("["), item("a", "1"), F.lit(","), item("b", "2"), F.lit("]"))
    return I.pick(_b(3, "f"), both, F.concat(F.lit("```json\n"), both, F.lit("\n```")), "[]")


@query("reflection_rows", "M5, F7", f"""
WITH {I.SECTIONED}, faults(i, name, instruction) AS (VALUES {", ".join(f"({i}, {I.q(f.name)}, {I.q(f.instruction)})" for i, f in enumerate(S.FAULT_TYPES))}),
a AS (SELECT sec.*, name, instruction, 'SELECT sum(o_totalprice) AS v FROM orders WHERE o_custkey = ' || regexp_extract(question, '客户 (\\d+)', 1) AS correct_sql
  FROM sec JOIN faults ON i = {I.sql_bucket('query', 10)} WHERE {I.sql_gaps(S.REQUIRED_SECTIONS['reflection'])} = ''),
b AS (SELECT *, sha256({sql_render('fault_injection', fault='name', instruction='instruction', sql='correct_sql')}) AS k FROM a),
c AS (SELECT *, unnest(['a', 'b']) AS error_type, unnest([{I.sql_bucket("k || '1'", 4)}, {I.sql_bucket("k || '2'", 4)}]) AS w FROM b WHERE {I.sql_bucket("k || 'f'", 3)} < 2)
SELECT query AS original_prompt, question, correct_sql, {I.sql_pick('w', *[I.q(x) for x in _WRONG])} AS error_sql, error_type,
  true AS has_message, 'found it' AS reflection_process, schema AS schema_info, knowledge AS knowledge_info, domain AS domain_info FROM c WHERE w <> 1""")
def reflection_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = reflected(spark, sf, with_sections(I.seeds(spark, sf)))
    return rows.withColumn("has_message", F.length("error_message") > 0).drop("error_message")


def reflected(spark: SparkSession, sf: str, seeds: DataFrame) -> DataFrame:
    with passing_tables(spark) as keep:
        stored = materialize_small(M.fault_seeds(seeds).select(*M.FAULT_COLUMNS, "gaps", "fault"), "seeds")
        first = materialize_small(I.replies(stored, M.fault_request(), _fault_reply()), "replies")
        broken = materialize_small(M.broken_statements(stored, first), "broken")
        # stored, so it is known to be small where it is, and statements need not be dealt by key
        outcomes = materialize_small(_run(spark, sf, broken, "error_sql").outcomes, "outcomes")
        failing = keep(M.failing_statements(broken, outcomes), "failing")
    second = materialize_small(I.replies(failing, M.reflection_request(), F.lit("found it\n")), "replies")
    return M.reflection_rows(failing, second)
