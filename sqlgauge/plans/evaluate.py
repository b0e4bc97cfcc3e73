"""Judge predicted answers: route by task, collect verdicts, roll up to accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.replies import first_answer, result_judgement, sentence_judgement, sql_judgement
from sqlgauge.functions.sqltext import canonical_sql, contains_select
from sqlgauge.functions.templates import render
from sqlgauge.functions.text import (
    data_section, domain_section, is_blank, join_key, knowledge_section, question_text, schema_section,
)
from sqlgauge.operators.resultsets import EMPTY_PREVIEW, result_preview, staged_verdict
from sqlgauge.operators.votes import majority_vote
from sqlgauge.plans.execution import PairRuns, with_pair
from sqlgauge.session import materialize
from sqlgauge.sources.exchange import attach_responses


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def task_of(type_name: Column, names: dict[str, str] = S.EVAL_TYPES) -> Column:
    """Task behind a type string; null for unknown ones."""
    return _mapped(type_name, names)


def route_of(task: Column) -> Column:
    """exec, judge or semantic; anything else is an error."""
    return F.coalesce(_mapped(task, S.EVAL_ROUTES), F.lit("unknown"))


def prepare(rows: DataFrame) -> DataFrame:
    """Add task, route, gold and pred to ``(row_id, query, response, answer, type)``."""
    return (
        rows.withColumn("task", task_of(F.col("type")))
        .withColumn("route", route_of(F.col("task")))
        .withColumn("gold", first_answer(F.col("response")))
        .withColumn("pred", F.coalesce("answer", F.lit("")))
    )


def gold_error(route: Column) -> Column:
    """Why a row cannot be evaluated at all; null if it can."""
    gold = F.col("gold")
    no_sql = ~contains_select(gold)
    return (
        F.when(route == "unknown", F.concat(F.lit("unknown type: "), F.coalesce("type", F.lit("null"))))
        .when(route.isin("exec", "judge") & no_sql, F.lit("gold has no SQL"))
        .when((route == "judge") & contains_select(F.col("pred"))
              & (schema_section(F.col("query")) == ""), F.lit("no schema in prompt"))
        .when((route == "judge") & contains_select(F.col("pred"))
              & (question_text(F.col("query")) == ""), F.lit("no question in prompt"))
        .when((route == "semantic") & is_blank(gold), F.lit("gold is empty"))
    )


def routed(rows: DataFrame) -> DataFrame:
    """Prepared rows with the reason why they cannot be evaluated, if there is one."""
    return prepare(rows).withColumn("error", gold_error(F.col("route")))


NO_SQL = "model SQL missing SELECT"


def judge_gate(verdicts: DataFrame, tasks: DataFrame, max_rows: int = S.JUDGE_ROW_GATE) -> DataFrame:
    """Mismatches a judge may still accept: multi-step rows with two small results."""
    return verdicts.filter(_open_to_judges(max_rows)).join(
        tasks.filter(F.col("task") == "multi_step").select("case_id"), "case_id", "left_semi")


def _open_to_judges(max_rows: int) -> Column:
    small = (F.col("n_gold") < max_rows) & (F.col("n_pred") < max_rows)
    return F.col("stage").isin("row_count_mismatch", "value_mismatch") & small


def executable(rows: DataFrame) -> DataFrame:
    """Routed rows whose two statements are run and compared, with the name of their pair."""
    mine = rows.filter((F.col("route") == "exec") & F.col("error").isNull() & contains_select(F.col("pred")))
    return with_pair(mine.select("row_id", "task", "query", "gold", "pred"))


def execution_verdicts(rows: DataFrame, runs: PairRuns, dims: int | None = None) -> DataFrame:
    """``(row_id, case_id, task, query, n_gold, n_pred, stage, verdict)`` of executable rows.

    Pairs are compared once; their verdict is that of every row with the pair.
    """
    verdicts = materialize(staged_verdict(runs.pairs, runs.outcomes, runs.rows, dims), "verdicts")
    return rows.select("row_id", "case_id", "task", "query").join(verdicts, "case_id")


def result_judge_requests(verdicts: DataFrame, rows: DataFrame, max_rows: int = S.JUDGE_ROW_GATE) -> DataFrame:
    """``(row_id, query, prompt)`` for a result judge: both previews of the rows that are open to judges.

    ``verdicts``: of ``execution_verdicts``; ``rows``: result rows of the pairs.
    """
    asked = verdicts.filter(_open_to_judges(max_rows) & (F.col("task") == "multi_step"))
    open_rows = materialize(rows.join(asked.select("case_id").distinct(), "case_id", "left_semi"), "open-rows")
    shown = result_preview(open_rows)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("preview")))
    previews = shown.groupBy("case_id").agg(side("gold").alias("gold_preview"), side("pred").alias("pred_preview"))
    q = F.col("query")
    prompt = render(
        "judge_results", question=question_text(q), schema=schema_section(q),
        knowledge=knowledge_section(q), domain=domain_section(q), data=data_section(q),
        result_a=F.coalesce("gold_preview", F.lit(EMPTY_PREVIEW)),
        result_b=F.coalesce("pred_preview", F.lit(EMPTY_PREVIEW)))
    return asked.join(previews, "case_id", "left").select("row_id", "query", prompt.alias("prompt"))


def with_result_judgements(verdicts: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``(row_id, stage, verdict)``: what the judge says to a row's request decides; no readable reply is false.

    ``requests``: row_id, prompt. ``responses``: prompt_key, text; equal requests share their reply.
    """
    judged = attach_responses(requests, F.col("prompt"), responses).select(
        "row_id", result_judgement(F.col("reply"))["verdict"].alias("v"), F.lit(True).alias("asked"))
    return verdicts.join(judged, "row_id", "left").select(
        "row_id", F.when(F.col("asked"), F.lit("judge")).otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("asked"), F.coalesce("v", F.lit(False))).otherwise(F.col("verdict")).alias("verdict"))


def with_judge_verdicts(verdicts: DataFrame, judged: DataFrame) -> DataFrame:
    """Let result judges overrule the gated mismatches; no readable verdict stays false.

    ``judged``: case_id, reply of the gated cases.
    """
    judged = judged.select("case_id", result_judgement(F.col("reply"))["verdict"].alias("v"),
                           F.lit(True).alias("asked"))
    return verdicts.join(judged, "case_id", "left").select(
        "case_id", "n_gold", "n_pred",
        F.when(F.col("asked"), F.lit("judge")).otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("asked"), F.coalesce("v", F.lit(False))).otherwise(F.col("verdict")).alias("verdict"))


def exec_route(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(row_id, equivalent, message)`` of the rows whose results are compared.

    ``verdicts``: row_id, stage, verdict.
    """
    mine = rows.filter((F.col("route") == "exec") & F.col("error").isNull())
    has_sql = contains_select(F.col("pred"))
    joined = mine.join(verdicts.select("row_id", "stage", "verdict"), "row_id", "left")
    return joined.select("row_id", F.when(has_sql, F.col("verdict")).alias("equivalent"),
                         F.when(has_sql, F.col("stage")).otherwise(F.lit(NO_SQL)).alias("message"))


def sql_judge_candidates(rows: DataFrame) -> DataFrame:
    """Judge-route rows with canonical texts and the request for those that differ."""
    q = F.col("query")
    mine = rows.filter((F.col("route") == "judge") & F.col("error").isNull())
    out = mine.withColumns({"sql_a": canonical_sql(F.col("pred")), "sql_b": canonical_sql(F.col("gold"))})
    kept = ("row_id", "gold", "pred", "sql_a", "sql_b", "prompt")
    ask = contains_select(F.col("pred")) & (F.col("sql_a") != F.col("sql_b"))
    prompt = render("judge_sql", question=question_text(q), schema=schema_section(q),
                    sql_a=F.col("sql_a"), sql_b=F.col("sql_b"))
    return out.withColumn("prompt", F.when(ask, prompt)).select(*kept)


def judge_route(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """Same canonical text is equivalent; otherwise the majority of the judges decides.

    ``votes``: prompt_key, judge_id, text (the judge's reply).
    """
    readable = votes.select(F.col("prompt_key").alias("case_id"), "judge_id",
                            sql_judgement(F.col("text")).alias("verdict"))
    decided = majority_vote(readable).select(F.col("case_id").alias("key"), F.col("verdict"))
    keyed = candidates.select(
        "row_id", join_key(F.col("prompt"), *candidates.columns).alias("key"),
        contains_select(F.col("pred")).alias("has_sql"), (F.col("sql_a") == F.col("sql_b")).alias("same"))
    has_sql, same = F.col("has_sql"), F.col("same")
    return keyed.join(decided, "key", "left").select(
        "row_id",
        F.when(~has_sql, F.lit(False)).when(same, F.lit(True)).otherwise(F.col("verdict")).alias("equivalent"),
        F.when(~has_sql, F.lit(NO_SQL)).when(same, F.lit("same canonical text"))
        .when(F.col("verdict").isNull(), F.lit("no majority")).otherwise(F.lit("majority")).alias("message"))


def sentence_judge_request(rows: DataFrame) -> DataFrame:
    """Semantic rows with the request to compare gold and answer; null for an empty answer."""
    mine = rows.filter((F.col("route") == "semantic") & F.col("error").isNull())
    prompt = render("judge_sentences", sentence_a=F.col("gold"), sentence_b=F.col("pred"))
    return mine.select("row_id", "gold", "pred", F.when(~is_blank(F.col("pred")), prompt).alias("prompt"))


def semantic_route(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """An empty answer is wrong; otherwise the judge's flag, or an error if unreadable.

    A reply is read once, however many rows share it, and before it meets them in one task.
    """
    read = responses.select("prompt_key", sentence_judgement(F.col("text")).alias("text"))
    rows = requests.withColumn("asked", F.col("prompt").isNotNull())
    judged = attach_responses(rows, F.col("prompt"), read, "j")
    j, asked = F.col("j"), F.col("asked")
    return judged.select(
        "row_id", F.when(~asked, F.lit(False)).otherwise(j["verdict"]).alias("equivalent"),
        F.when(~asked, F.lit("model answer is empty")).otherwise(j["reason"]).alias("message"),
        F.when(asked & (F.coalesce(j["status"], F.lit("no reply")) != "ok"), F.lit("judge reply unreadable")).alias("error"))


def evaluation_table(ready: DataFrame, verdicts: DataFrame, candidates: DataFrame, votes: DataFrame,
                     requests: DataFrame, responses: DataFrame) -> DataFrame:
    """All routes put together: one row per input row, seven added columns.

    ``ready``: rows of ``routed``. ``verdicts``: row_id, stage, verdict of the executed rows. ``candidates`` and
    ``requests``: of ``sql_judge_candidates`` and ``sentence_judge_request``, with the ``votes`` and ``responses``
    to them. The three routes touch disjoint rows. Each part reads ``ready`` or a part of it once more, so large
    ones are stored tables.
    """
    judged = judge_route(candidates, votes)
    semantic = semantic_route(requests, responses)
    empty, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    parts = [
        exec_route(ready, verdicts).select(
            "row_id", F.col("equivalent").alias("equivalent_exec"), F.col("message").alias("msg_exec"),
            empty.alias("equivalent_llm"), text.alias("msg_llm"),
            empty.alias("equivalent_semantic"), text.alias("msg_semantic"), text.alias("error_processing")),
        judged.select(
            "row_id", empty.alias("equivalent_exec"), text.alias("msg_exec"),
            F.col("equivalent").alias("equivalent_llm"), F.col("message").alias("msg_llm"),
            empty.alias("equivalent_semantic"), text.alias("msg_semantic"), text.alias("error_processing")),
        semantic.select(
            "row_id", empty.alias("equivalent_exec"), text.alias("msg_exec"),
            empty.alias("equivalent_llm"), text.alias("msg_llm"),
            F.col("equivalent").alias("equivalent_semantic"), F.col("message").alias("msg_semantic"),
            F.col("error").alias("error_processing")),
        ready.filter("error is not null").select(
            "row_id", empty.alias("equivalent_exec"), text.alias("msg_exec"),
            empty.alias("equivalent_llm"), text.alias("msg_llm"),
            empty.alias("equivalent_semantic"), text.alias("msg_semantic"),
            F.col("error").alias("error_processing")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def accuracy(verdicts: DataFrame, task: str = "task", verdict: str = "verdict") -> DataFrame:
    """Accuracy per task, per group and overall; nulls once as wrong, once left out.

    Group and overall figures are macro averages over the tasks.
    """
    v = F.col(verdict)
    per_task = verdicts.groupBy(F.col(task).alias("task")).agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n_judged"), F.count_if(v).alias("n_true"))
    per_task = per_task.withColumns({
        "grp": F.when(F.col("task").isin(*S.SQL_TASKS), "sql").otherwise("boundary"),
        "acc_all": F.col("n_true") / F.col("n_rows"),
        "acc_judged": F.try_divide("n_true", "n_judged"),
    })
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_judged", "n_true")]
    means = [F.avg(c).alias(c) for c in ("acc_all", "acc_judged")]
    rolled = per_task.rollup("grp", "task").agg(*sums, *means)
    return rolled.select(
        F.coalesce("grp", F.lit("all")).alias("grp"), F.coalesce("task", F.lit("all")).alias("task"),
        "n_rows", "n_judged", "n_true",
        F.round("acc_all", 6).alias("acc_all"), F.round("acc_judged", 6).alias("acc_judged"))
