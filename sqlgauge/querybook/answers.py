"""Queries that parse model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions import replies as R
from sqlgauge.functions.text import hash_bucket, with_sections
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.registry import query

NL = "chr(10)"


def _sql_group(pattern: str, c: str = "content", flags: str = "s") -> str:
    """First group of a pattern, stripped; null without a match."""
    p = f"'(?{flags}){pattern}'"
    return f"CASE WHEN regexp_matches({c}, {p}) THEN {I.sql_strip(f'regexp_extract({c}, {p}, 1)')} END"


_THINK = _sql_group("<think>(.*?)</think>")
_ANSWER = _sql_group("<answer>(.*?)</answer>")
_FENCE = _sql_group(r"```(?:res)?\s*(.*?)\s*```", flags="si")


def _sql_count(tag: str, c: str = "content") -> str:
    return f"((length({c}) - length(replace({c}, '{tag}', ''))) // {len(tag)})"


@query("tag_answers", "P3, P4, P5, P6", f"""
WITH {I.COMPLETIONS} SELECT key, {_ANSWER} AS first_answer, coalesce({_THINK}, '') AS first_think,
  CASE WHEN {_sql_count('<answer>')} = 1 AND {_sql_count('</answer>')} = 1 THEN {_ANSWER} END AS sole_answer,
  CASE WHEN {" AND ".join(f"{_sql_count(t)} = 1" for t in S.EMPTY_ANSWER_TAGS)} THEN {_ANSWER} END AS strict_answer
FROM completions""")
def tag_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    return I.completions(spark, sf).select(
        "key", R.first_answer(c).alias("first_answer"), R.first_think(c).alias("first_think"),
        R.sole_answer(c).alias("sole_answer"), R.strict_answer(c).alias("strict_answer"))


@query("inference_answers", "P7, P8", f"""
WITH {I.COMPLETIONS}, x AS (SELECT *, {_THINK} AS t, {_ANSWER} AS a, {_FENCE} AS f FROM completions)
SELECT key,
  CASE WHEN t IS NOT NULL OR a IS NOT NULL THEN coalesce(t, '') WHEN f IS NOT NULL THEN {I.sql_strip("split_part(content, '```', 1)")} ELSE '' END AS think,
  CASE WHEN t IS NOT NULL OR a IS NOT NULL THEN coalesce(a, '') WHEN f IS NOT NULL THEN f ELSE content END AS answer,
  coalesce(t, '') AS trained_think, coalesce(a, '') AS trained_answer,
  {I.sql_strip("regexp_replace(content, '(?s)<think>.*?</think>', '', 'g')")} AS base_answer FROM x""")
def inference_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    rows = I.completions(spark, sf).select(
        "key", R.think_and_answer(c).alias("closed"), R.trained_think_and_answer(c).alias("own"),
        R.trained_think_and_answer(c, base_model=True).alias("base"))
    return rows.select("key", "closed.think", "closed.answer", F.col("own.think").alias("trained_think"),
                       F.col("own.answer").alias("trained_answer"), F.col("base.answer").alias("base_answer"))


def _block_reply(tag: str, good: str) -> Column:
    text = F.col("text")
    return I.pick(
        hash_bucket(F.concat("key", F.lit("b")), 4),
        F.concat(F.lit("intro [思考过程]\n "), text, F.lit(f"\n{tag} {good}\n")),
        F.concat(F.lit("[思考过程] a "), F.lit(f"{tag} other")),
        F.concat(text, F.lit(f"{tag} {good}")),
        F.concat(F.lit(f"{tag} x [思考过程]"), text))


def _sql_block_reply(tag: str, good: str) -> str:
    return I.sql_pick(
        I.sql_bucket("key || 'b'", 4),
        f"'intro [思考过程]' || {NL} || ' ' || text || {NL} || '{tag} {good}' || {NL}",
        f"'[思考过程] a ' || '{tag} other'", f"text || '{tag} {good}'", f"'{tag} x [思考过程]' || text")


_B1, _B2 = _sql_block_reply("[澄清问题]", "which one?"), _sql_block_reply("[结论]", S.REFUSAL_SENTENCE)


def _sql_blocks(reply: str, tag: str, needed: str | None) -> str:
    p = rf"'(?s)\[思考过程\](.*?)\[{tag}\](.*)'"
    wrong = f"WHEN strpos(regexp_extract({reply}, {p}, 2), '{needed}') = 0 THEN 'wrong_block'" if needed else ""
    return (f"CASE WHEN regexp_matches({reply}, {p}) THEN {I.sql_strip(f'regexp_extract({reply}, {p}, 1)')} END",
            f"CASE WHEN regexp_matches({reply}, {p}) THEN {I.sql_strip(f'regexp_extract({reply}, {p}, 2)')} END",
            f"CASE WHEN NOT regexp_matches({reply}, {p}) THEN 'no_tags' {wrong} ELSE 'ok' END")


_C, _J = _sql_blocks("c", "澄清问题", None), _sql_blocks("j", "结论", S.REFUSAL_SENTENCE)


@query("tagged_blocks", "P1, P2", f"""
WITH {I.COMPLETIONS}, r AS (SELECT key, {_B1} AS c, {_B2} AS j FROM completions)
SELECT key, {_C[0]} AS thought, {_C[1]} AS clarification, {_C[2]} AS clarify_status, {_J[1]} AS conclusion, {_J[2]} AS reject_status FROM r""")
def tagged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.completions(spark, sf).select(
        "key", R.tagged_blocks(_block_reply(S.CLARIFY_TAG, "which one?"), S.CLARIFY_TAG).alias("c"),
        R.tagged_blocks(_block_reply(S.CONCLUSION_TAG, S.REFUSAL_SENTENCE), S.CONCLUSION_TAG,
                        S.REFUSAL_SENTENCE).alias("j"))
    return rows.select("key", "c.thought", F.col("c.block").alias("clarification"),
                       F.col("c.status").alias("clarify_status"), F.col("j.block").alias("conclusion"),
                       F.col("j.status").alias("reject_status"))


@query("sql_in_replies", "P9", f"""
WITH {I.SEEDS} SELECT seed_id, coalesce({_sql_group(r'SQL\s*->\s*(SELECT[\s\S]+?)(?:\n\n|$)', 'response', 'i')},
  {_sql_group(r'```sql\s*([\s\S]+?)\s*```', 'response', 'i')}, {_sql_group(r'(SELECT[\s\S]+?)(?:\n\n|$)', 'response', 'i')}) AS sql FROM seeds""")
def sql_in_replies(spark: SparkSession, sf: str) -> DataFrame:
    return I.seeds(spark, sf).select("seed_id", R.sql_in_reply(F.col("response")).alias("sql"))


# --- JSON -----------------------------------------------------------------------------

def _json_reply() -> Column:
    good = F.concat(F.lit('{"think":"t","constraint_description":"'), "question", F.lit('"}'))
    return I.pick(
        hash_bucket(F.col("query"), 7), good, F.concat(F.lit("```json\n"), good, F.lit("\n```")),
        '{"think":"t"}', "sorry", '{"think":null,"constraint_description":"x"}',
        F.concat(good, F.lit(" thanks")), '```\n{"think":"t","constraint_description":["a",1]}\n``` ')


_GOOD = """'{"think":"t","constraint_description":"' || question || '"}'"""
_JSON = I.sql_pick(
    I.sql_bucket("query", 7), _GOOD, f"'```json' || {NL} || {_GOOD} || {NL} || '```'", """'{"think":"t"}'""",
    "'sorry'", """'{"think":null,"constraint_description":"x"}'""", f"{_GOOD} || ' thanks'",
    f"""'```' || {NL} || '{{"think":"t","constraint_description":["a",1]}}' || {NL} || '``` '""")


def _sql_status(doc: str) -> str:
    return (f"CASE WHEN NOT json_valid({doc}) THEN 'not_json' WHEN NOT list_has_all(json_keys({doc}), "
            "['think', 'constraint_description']) THEN 'missing_keys' ELSE 'ok' END")


def _sql_field(doc: str, name: str) -> str:
    return f"CASE WHEN json_valid({doc}) THEN json_extract_string({doc}, '$.{name}') END"


@query("json_replies", "P10, P11", f"""
WITH {I.SECTIONED}, r AS (SELECT seed_id, {_JSON} AS reply FROM sec),
f AS (SELECT *, replace(replace({I.sql_strip('reply')}, '```json', ''), '```', '') AS doc FROM r)
SELECT seed_id, {_sql_status('doc')} AS fenced_status, {_sql_field('doc', 'think')} AS think,
  {_sql_field('doc', 'constraint_description')} AS description, {_sql_status('reply')} AS plain_status FROM f""")
def json_replies(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("think", "constraint_description")
    rows = with_sections(I.seeds(spark, sf)).withColumn("reply", _json_reply()).select(
        "seed_id", R.fenced_json_fields(F.col("reply"), fields).alias("f"),
        R.json_fields(F.col("reply"), fields)["status"].alias("plain_status"))
    return rows.select("seed_id", F.col("f.status").alias("fenced_status"), "f.think",
                       F.col("f.constraint_description").alias("description"), "plain_status")


_VOTES = ('```json\n{"is_correct": true, "n": 1}\n```', 'first {"n": 1} then {"is_correct": true}',
          '{"is_correct": "true"}', '{"is_correct": false}', "none", '{"a": {"is_correct": true}}',
          '{"is_correct": true} end', '{"constraint_satisfied": false}', "")


def _sql_text(values) -> str:
    return ", ".join(I.q(v) for v in values)


@query("vote_replies", "P12, F5", f"""
WITH {I.SEEDS}, r AS (SELECT seed_id, list_extract([{_sql_text(_VOTES)}], {I.sql_bucket('query', len(_VOTES))} + 1) AS reply FROM seeds),
d AS (SELECT *, CASE WHEN regexp_matches(reply, '(?s)```json\\s*(\\{{.*?\\}})\\s*```') THEN regexp_extract(reply, '(?s)```json\\s*(\\{{.*?\\}})\\s*```', 1)
  WHEN strpos(reply, '{{') > 0 THEN '{{' || list_last(string_split(reply, '{{')) END AS doc FROM r)
SELECT seed_id, coalesce(json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc END, '$.is_correct') = 'BOOLEAN'
  AND json_extract_string(CASE WHEN json_valid(doc) THEN doc END, '$.is_correct') = 'true', false) AS accepted,
  NOT (reply = '{{"constraint_satisfied": false}}') AS constraint_met FROM d""")
def vote_replies(spark: SparkSession, sf: str) -> DataFrame:
    reply = I.pick(hash_bucket(F.col("query"), len(_VOTES)), *_VOTES)
    return I.seeds(spark, sf).select("seed_id", R.vote_flag(reply).alias("accepted"),
                                     R.constraint_met(reply).alias("constraint_met"))


_JUDGES = ('{"is_equivalent": true, "reason": "same"}', 'ok\n```json\n{"is_equivalent": true}\n```\nbye',
           '```\n{"is_equivalent": false, "reason": "rows"}\n```', '```json\n{"is_equivalent": true}\n```',
           "broken", 'x {"is_identical": true, "reason": "r"} y', '{"is_identical": false}', "{a} {b}")
# Hand-derived: result judge verdict and reason, SQL judge verdict, sentence judge verdict and status.
_JUDGED = (
    ("true", "'same'", "true", "NULL", "'ok'"),
    ("true", "'no reason'", "NULL", "NULL", "'ok'"),
    ("false", "'rows'", "false", "NULL", "'ok'"),
    ("true", "'no reason'", "true", "NULL", "'ok'"),
    ("false", "'format error'", "NULL", "NULL", "'not_json'"),
    ("false", "'format error'", "NULL", "true", "'ok'"),
    ("false", "'no reason'", "NULL", "false", "'ok'"),
    ("false", "'format error'", "NULL", "NULL", "'not_json'"),
)
_JUDGE_ROWS = ", ".join(f"({i}, {a}, {b}, {c}::BOOLEAN, {d}::BOOLEAN, {e})" for i, (a, b, c, d, e) in enumerate(_JUDGED))


@query("judge_replies", "P13, P14, P15", f"""
WITH {I.SEEDS}, j(i, result_verdict, result_reason, sql_verdict, sentence_verdict, sentence_status) AS (VALUES {_JUDGE_ROWS})
SELECT seed_id, result_verdict, result_reason, sql_verdict, sentence_verdict, sentence_status
FROM seeds JOIN j ON i = {I.sql_bucket('query', len(_JUDGES))}""")
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    reply = I.pick(hash_bucket(F.col("query"), len(_JUDGES)), *_JUDGES)
    rows = I.seeds(spark, sf).withColumn("reply", reply)
    r, s = R.result_judgement(F.col("reply")), R.sentence_judgement(F.col("reply"))
    return rows.select(
        "seed_id", r["verdict"].alias("result_verdict"), r["reason"].alias("result_reason"),
        R.sql_judgement(F.col("reply")).alias("sql_verdict"), s["verdict"].alias("sentence_verdict"),
        s["status"].alias("sentence_status"))


def _fault_reply() -> Column:
    a = F.concat(F.lit('{"error_type_applied":"a","modified_sql":"SELEC '), F.col("seed_id").cast("string"), F.lit('"}'))
    b = F.lit('{"error_type_applied":"b","modified_sql":"SELECT 1/0"}')
    empty = F.lit('{"error_type_applied":"c","modified_sql":""}')
    wrap = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    return I.pick(hash_bucket(F.col("query"), 5), wrap(a, b),
                  F.concat(F.lit("here\n```json\n"), wrap(a, empty), F.lit("\n```")), wrap(a), wrap(a, b, a), "none")


@query("fault_replies", "P16", f"""
WITH {I.SEEDS}, r AS (SELECT seed_id, {I.sql_bucket('query', 5)} AS form FROM seeds)
SELECT seed_id, 0 AS fault_no, 'a' AS error_type, 'SELEC ' || seed_id AS error_sql FROM r WHERE form IN (0, 1)
UNION ALL SELECT seed_id, 1, 'b', 'SELECT 1/0' FROM r WHERE form = 0""")
def fault_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.seeds(spark, sf).withColumn("reply", _fault_reply())
    return R.explode_faults(rows, "reply", "seed_id")


@query("replacement_messages", "P17", f"""
WITH {I.SEEDS} SELECT seed_id, CASE WHEN state = 'F' THEN '' ELSE index_name || ' 2' END AS new_value FROM seeds""")
def replacement_messages(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(F.col("state") == "F", F.lit("index:none")).otherwise(
        F.concat(F.lit("index:x -> "), "index_name", F.lit(" 2\n")))
    return I.seeds(spark, sf).select("seed_id", R.replacement_target(message).alias("new_value"))
