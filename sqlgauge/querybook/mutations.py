"""Queries that draw seeds and build mutated training rows from stub replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.text import hash_bucket, prompt_key, question_text, with_sections
from sqlgauge.operators import sampling as D
from sqlgauge.plans import mutate as M
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.prompts import sql_render
from sqlgauge.querybook.registry import query, table
from sqlgauge.session import materialize_small, passing_tables

_KNOW = {n: n for n in ("schema", "knowledge", "domain", "data")}


def _b(n: int, salt: str = "") -> Column:
    return hash_bucket(F.concat("prompt_key", F.lit(salt)), n)


def _sb(key: str, n: int) -> str:
    return I.sql_bucket(f"sha256({key})", n)


# --- resume and draws ------------------------------------------------------------

@query("resume_seeds", "X1", f"""
WITH {I.SEEDS} SELECT seed_id, index_name FROM seeds WHERE query NOT IN (SELECT query FROM seeds WHERE state = 'F')""")
def resume_seeds(spark: SparkSession, sf: str) -> DataFrame:
    seeds = I.seeds(spark, sf)
    done = seeds.filter("state = 'F'").select(F.col("query").alias("original_prompt"))
    return D.not_yet_done(seeds, done).select("seed_id", "index_name")


_INDEXED = f"""ix AS (SELECT *, row_number() OVER (ORDER BY {I.sql_bucket('seed_id::VARCHAR', 1024)}, seed_id) - 1 AS row_index FROM sec)"""
_DRAWS = f"""{I.SECTIONED}, {_INDEXED}, wanted AS (SELECT (SELECT count(*) FROM customer) - (SELECT count(*) FROM nation) AS k),
draws AS (SELECT d.draw_no, ix.* FROM (SELECT unnest(range((SELECT k FROM wanted))) AS draw_no) d
  JOIN ix ON ix.row_index = {I.sql_bucket('d.draw_no::VARCHAR', '(SELECT count(*) FROM orders)')})"""


def _draws(spark: SparkSession, sf: str, seeds: DataFrame | None = None) -> DataFrame:
    """As many draws as customers are wanted; as many as nations are there already."""
    return D.draw_with_replacement(I.seeds(spark, sf) if seeds is None else seeds, "seed_id",
                                   table(spark, sf, "customer").count(), table(spark, sf, "nation").count())


@query("draw_seeds", "X2", f"WITH {_DRAWS} SELECT draw_no, seed_id FROM draws")
def draw_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _draws(spark, sf).select("draw_no", "seed_id")


_POOL = f"""pool AS (SELECT seed_id AS example_id, question AS example,
  coalesce({I.sql_strip("regexp_extract(response, '(?s)<think>(.*?)</think>', 1)")}, '') AS think,
  row_number() OVER (ORDER BY {I.sql_bucket('seed_id::VARCHAR', 1024)}, seed_id) - 1 AS row_index FROM sec WHERE state = 'O'),
pool_n AS (SELECT count(*) AS n FROM pool), picked AS (SELECT sec.*, {_sb('query', 'n')} AS pick FROM sec, pool_n)"""


def _pool(seeds: DataFrame) -> DataFrame:
    return seeds.filter("state = 'O'").select(
        F.col("seed_id").alias("example_id"), question_text(F.col("query")).alias("original_question"), "response")


@query("attach_examples", "X3", f"""
WITH {I.SECTIONED}, {_POOL} SELECT picked.seed_id, example_id, example FROM picked JOIN pool ON row_index = pick""")
def attach_examples(spark: SparkSession, sf: str) -> DataFrame:
    seeds = I.seeds(spark, sf).select("seed_id", "query")
    pool = _pool(I.seeds(spark, sf)).select("example_id", F.col("original_question").alias("example"))
    return D.attach_example(seeds, prompt_key(F.col("query")), pool, "example_id").select(
        "seed_id", "example_id", "example")


_ORDERED = sorted(I.METRICS, key=lambda m: (-len(m), m))
_NAMES = "[" + ", ".join(I.q(m) for m in _ORDERED) + "]"
_SWAP = f"""hit AS (SELECT *, regexp_extract(question, '({"|".join(_ORDERED)})') AS found FROM sec),
swapped AS (SELECT *, CASE WHEN found <> '' THEN list_extract({_NAMES}, ((list_position({_NAMES}, found) - 1
  + {I.sql_bucket('query', len(_ORDERED) - 1)} + 1) % {len(_ORDERED)} + 1)::INTEGER) END AS new_indicator FROM hit),
swaps AS (SELECT *, replace(question, found, new_indicator) AS swapped_question FROM swapped)"""


@query("metric_swaps", "X5, F6", f"""
WITH {I.SECTIONED}, {_SWAP} SELECT seed_id, CASE WHEN schema <> '' THEN swapped_question END AS swapped_question,
  CASE WHEN schema <> '' THEN new_indicator END AS new_indicator FROM swaps""")
def metric_swaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.metric_swaps(I.seeds(spark, sf), I.METRICS).select(
        "seed_id", F.col("swap.question").alias("swapped_question"), F.col("swap.metric").alias("new_indicator"))


# --- clarification -----------------------------------------------------------------

def stored_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds and their sections as a stored table, as it is where replies come from outside."""
    return materialize_small(with_sections(I.seeds(spark, sf)), "seeds")


def _clarify_replies(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rewrites, and the replies to their requests."""
    seeds = M.with_gaps(stored, "clarify")
    text = I.pick(
        _b(5), F.concat(F.lit('{"rewrite_logic":"time open","ambiguous_question":"about '), "question",
                        F.lit('","difficulty_analysis":"easy"}')),
        F.concat(F.lit('{"rewrite_logic":"place open","ambiguous_question":"2025 '), "question",
                 F.lit('","difficulty_analysis":null}')),
        '{"rewrite_logic":"x","ambiguous_question":"y"}',
        '{"rewrite_logic":"无法改写","ambiguous_question":"","difficulty_analysis":"hard"}', "sorry")
    with passing_tables(stored.sparkSession) as keep:
        first = materialize_small(I.replies(seeds, M.clarify_request(), text), "replies")
        rewritten = keep(M.clarify_rewrites(stored, first), "rewrites")
    second = I.replies(rewritten, M.clarify_reasoning_request(), I.pick(
        _b(3, "r"), "[思考过程] two readings\n[澄清问题] which one?", "[思考过程]a[澄清问题] b ", "no tags"))
    return rewritten, materialize_small(second, "replies")


_NEW_PROMPT = """(regexp_replace(query, '(?s)^(.*?问题：).*?(，写出对应的SQL语句.*)$', '\\1') || ambiguous_question
  || regexp_extract(query, '(?s)^(.*?问题：).*?(，写出对应的SQL语句.*)$', 2))"""
_CLARIFY = f"""p1 AS (SELECT *, {sql_render('clarify_rewrite', categories=I.q(M.CLARIFY_CATEGORIES), schema='schema', question='question')} AS prompt FROM sec),
f1 AS (SELECT *, {_sb('prompt', 5)} AS form, schema = '' OR question = '' AS gap FROM p1),
rw AS (SELECT *, CASE WHEN gap THEN NULL ELSE {I.sql_pick('form', "'time open'", "'place open'", "'x'", "'无法改写'", 'NULL')} END AS rewrite_logic,
  CASE WHEN gap THEN NULL ELSE {I.sql_pick('form', "'about ' || question", "'2025 ' || question", "'y'", "''", 'NULL')} END AS ambiguous_question,
  CASE WHEN gap THEN NULL ELSE {I.sql_pick('form', "'easy'", 'NULL', 'NULL', "'hard'", 'NULL')} END AS difficulty_analysis FROM f1),
p2 AS (SELECT *, CASE WHEN NOT gap AND form < 2 THEN {sql_render('clarify_reasoning', context=I.sql_strip(f"split_part({_NEW_PROMPT}, '--- 6.few shot', 1)"),
    question='ambiguous_question', reason='rewrite_logic')} END AS prompt2 FROM rw),
f2 AS (SELECT *, {I.sql_bucket("sha256(prompt2) || 'r'", 3)} AS form2 FROM p2),
clarified AS (SELECT seed_id, query AS original_prompt, rewrite_logic, question AS original_question, ambiguous_question, difficulty_analysis,
  {I.sql_pick('form2', "'two readings'", "'a'", 'NULL')} AS cot_process, {I.sql_pick('form2', "'which one?'", "'b'", 'NULL')} AS clarification_question,
  CASE WHEN gap THEN 'missing: ' || {I.sql_gaps(S.REQUIRED_SECTIONS['clarify'])} WHEN form = 2 THEN 'rewrite missing_keys' WHEN form = 4 THEN 'rewrite not_json'
    WHEN form = 3 THEN 'unrewritable' WHEN form2 = 2 THEN 'reasoning no_tags' ELSE 'ok' END AS status FROM f2)"""


def clarified(stored: DataFrame) -> DataFrame:
    return M.clarify_rows(*_clarify_replies(stored))


@query("clarification_rows", "M1", f"WITH {I.SECTIONED}, {_CLARIFY} SELECT * EXCLUDE seed_id FROM clarified")
def clarification_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clarified(stored_seeds(spark, sf))


# --- metric rejection -----------------------------------------------------------------

def _reject_replies(swaps: DataFrame) -> DataFrame:
    return materialize_small(I.replies(swaps, M.reject_request(), I.pick(
        _b(4), F.concat(F.lit("[思考过程] not defined\n[结论] "), F.lit(S.REFUSAL_SENTENCE)),
        "[思考过程] x [结论] maybe", "nothing", F.lit(None).cast("string"))), "replies")


_REJECT = f"""rp AS (SELECT *, CASE WHEN schema <> '' AND found <> '' THEN {sql_render('reject_reasoning', schema='schema', question='swapped_question')} END AS prompt FROM swaps),
rf AS (SELECT *, {_sb('prompt', 4)} AS form FROM rp),
rejected AS (SELECT seed_id, query AS original_prompt, question AS original_question, CASE WHEN prompt IS NOT NULL THEN swapped_question END AS swapped_question,
  CASE WHEN prompt IS NOT NULL THEN new_indicator END AS new_indicator, {I.sql_pick('form', "'not defined'", "'x'", 'NULL', 'NULL')} AS cot_process,
  {I.sql_pick('form', I.q(S.REFUSAL_SENTENCE), "'maybe'", 'NULL', 'NULL')} AS conclusion,
  CASE WHEN schema = '' OR question = '' THEN 'missing: ' || {I.sql_gaps(S.REQUIRED_SECTIONS['metric_reject'])} WHEN found = '' THEN 'no_metric'
    ELSE {I.sql_pick('form', "'ok'", "'wrong_block'", "'no_tags'", "'no_reply'")} END AS status FROM rf)"""


def rejected(stored: DataFrame) -> DataFrame:
    swaps = M.metric_swaps(stored, I.METRICS).select("query", "question", "schema", "gaps", "swap")
    swaps = materialize_small(swaps, "swaps")
    return M.reject_rows(swaps, _reject_replies(swaps), I.METRICS)


@query("rejection_rows", "M2", f"WITH {I.SECTIONED}, {_SWAP}, {_REJECT} SELECT * EXCLUDE seed_id FROM rejected")
def rejection_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejected(stored_seeds(spark, sf))


# --- constraint follow-up -------------------------------------------------------------

def _constraint_replies(stored: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored steps with their examples, and the replies to their requests."""
    seeds = M.with_gaps(stored, "constraint_ask")
    extract = I.pick(
        _b(4), F.concat(F.lit('```json\n{"think":"needed","constraint_description":"name a place for '), "index_name",
                        F.lit('"}\n```')),
        '{"think":"t","constraint_description":"name a type"}', '{"think":"none","constraint_description":"无法提取"}',
        '{"think":"none"}')
    check = I.pick(_b(3, "c"), '{"constraint_satisfied": false}', '{"constraint_satisfied": true}', "unreadable")
    with passing_tables(stored.sparkSession) as keep:
        first = materialize_small(I.replies(seeds, M.constraint_request(), extract), "replies")
        extracts = materialize_small(M.constraint_extracts(stored, first), "extracts")
        second = materialize_small(I.replies(extracts, M.constraint_check_request(), check), "replies")
        steps = materialize_small(M.constraint_steps(extracts, second), "steps")
        attached = keep(M.constraint_examples(steps, second, pool, "example_id"), "attached")
    third = materialize_small(I.replies(attached, M.constraint_reasoning_request(), I.pick(
        _b(2, "s"), "which place do you mean?", " ")), "replies")
    return attached, third


_CONSTRAINT = f"""{_POOL}, cp AS (SELECT *, {sql_render('constraint_extract', question='question', **_KNOW)} AS prompt,
  {I.sql_gaps(S.REQUIRED_SECTIONS['constraint_ask'])} AS gaps FROM picked),
cf AS (SELECT *, CASE WHEN gaps = '' THEN {_sb('prompt', 4)} END AS form FROM cp),
cx AS (SELECT *, {I.sql_pick('form', "'needed'", "'t'", "'none'", "'none'")} AS think,
  {I.sql_pick('form', "'name a place for ' || index_name", "'name a type'", "'无法提取'", 'NULL')} AS described FROM cf),
cc AS (SELECT *, CASE WHEN form < 2 THEN {I.sql_bucket("sha256(" + sql_render('constraint_check', question='question', constraint='described') + ") || 'c'", 3)} END AS form2 FROM cx),
cm AS (SELECT cc.*, CASE WHEN form2 = 0 AND strpos(query, chr(10) || '  计算逻辑：') > 0 THEN
    replace(query, chr(10) || '  计算逻辑：', chr(10) || '必备约束：' || described || chr(10) || '  计算逻辑：') END AS modified, pool.example, pool.think AS example_think
  FROM cc JOIN pool ON pool.row_index = cc.pick),
cs AS (SELECT *, CASE WHEN modified IS NOT NULL THEN {I.sql_bucket("sha256(" + sql_render('constraint_reasoning', prompt='modified', example='example', example_think='example_think') + ") || 's'", 2)} END AS form3 FROM cm),
ct AS (SELECT *, CASE WHEN gaps <> '' THEN 'missing: ' || gaps WHEN form = 3 THEN 'no_constraint' WHEN form = 2 THEN 'cannot_extract' WHEN form2 > 0 THEN 'skip'
  WHEN modified IS NULL THEN 'no_anchor' WHEN form3 = 1 THEN 'no_reply' ELSE 'success' END AS status FROM cs),
constrained AS (SELECT seed_id, status, CASE WHEN status = 'skip' THEN 'conflict' ELSE think END AS reason, query AS original_prompt, question AS original_question,
  CASE WHEN status = 'success' THEN described END AS added_constraint, CASE WHEN status = 'success' THEN modified END AS modified_prompt,
  CASE WHEN status = 'success' THEN 'which place do you mean?' END AS cot_process FROM ct)"""


def constrained(stored: DataFrame) -> DataFrame:
    pool = _pool(stored)
    return M.constraint_rows(*_constraint_replies(stored, pool), pool, "example_id")


@query("constraint_rows", "M3, F4", f"WITH {I.SECTIONED}, {_CONSTRAINT} SELECT * EXCLUDE seed_id FROM constrained")
def constraint_rows(spark: SparkSession, sf: str) -> DataFrame:
    return constrained(stored_seeds(spark, sf))
