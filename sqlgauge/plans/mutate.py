"""Mutated training rows from seeds, in five families.

Each function is one declarative plan from seeds and a response table (see
``sources.exchange``) to rows with a ``status``. A seed that drops out keeps its reason, so
nothing disappears silently; ``status = 'ok'`` (or ``'success'``) marks finished rows.

A step that needs replies of its own may be stored and passed on in place of the seeds: columns it
has made already are not made again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.replies import (
    constraint_met, explode_faults, fenced_json_fields, first_think, json_fields, sql_in_reply,
    tagged_blocks, vote_flag,
)
from sqlgauge.functions.templates import CLARIFY_CATEGORIES, render
from sqlgauge.functions.text import (
    SECTIONS, context_before_examples, insert_constraint, is_blank, join_key, missing_sections, prompt_key,
    question_text, replace_question, strip, with_sections,
)
from sqlgauge.operators.sampling import attach_example, fault_for, swap_metric
from sqlgauge.operators.votes import unanimous_vote
from sqlgauge.session import once
from sqlgauge.sources.exchange import attach_responses


def with_gaps(seeds: DataFrame, task: str) -> DataFrame:
    """Sections of the prompt and the names of required ones that are empty.

    Seeds that come with their sections (a stored table of them) are not cut again.
    """
    cut = seeds if set(SECTIONS) <= set(seeds.columns) else with_sections(seeds)
    return cut.withColumn("gaps", missing_sections(S.REQUIRED_SECTIONS[task]))


def _gap_status() -> Column:
    return F.when(F.col("gaps") != "", F.concat(F.lit("missing: "), F.col("gaps")))


def _ask(template: str, **values: Column | str) -> Column:
    """Request text, only for seeds with all sections."""
    return F.when(F.col("gaps") == "", render(template, **values))


# --- ambiguity clarification -----------------------------------------------------

REWRITE_FIELDS = ("rewrite_logic", "ambiguous_question", "difficulty_analysis")


def clarify_request() -> Column:
    return _ask("clarify_rewrite", categories=CLARIFY_CATEGORIES, schema=F.col("schema"),
                question=F.col("question"))


def clarify_reasoning_request() -> Column:
    new_prompt = replace_question(F.col("query"), F.col("r.ambiguous_question"))
    text = render("clarify_reasoning", context=context_before_examples(new_prompt),
                  question=F.col("r.ambiguous_question"), reason=F.col("r.rewrite_logic"))
    return F.when(F.col("rewritten"), text)


def clarify_rewrites(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompt and question of the seeds with the parsed rewrite ``r`` and whether it was ``answered`` and can be used."""
    asked = attach_responses(with_gaps(seeds, "clarify"), clarify_request(), responses, "rewrite").select(
        "query", "question", "gaps", "rewrite")
    usable = ~is_blank(F.col("r.ambiguous_question")) & ~F.col("r.rewrite_logic").contains(S.CANNOT_REWRITE)
    return once(asked, r=json_fields(F.col("rewrite"), REWRITE_FIELDS)).withColumns({
        "answered": F.col("rewrite").isNotNull(),
        "rewritten": (F.col("gaps") == "") & F.coalesce((F.col("r.status") == "ok") & usable, F.lit(False)),
    }).drop("rewrite")


def clarify_rows(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    rewrites = seeds if "rewritten" in seeds.columns else clarify_rewrites(seeds, responses)
    rows = attach_responses(rewrites, clarify_reasoning_request(), responses, "reasoning")
    rows = once(rows, c=tagged_blocks(F.col("reasoning"), S.CLARIFY_TAG))
    status = (
        F.coalesce(_gap_status(),
                   F.when(~F.col("answered"), F.lit("no_reply"))
                   .when(F.col("r.status") != "ok", F.concat(F.lit("rewrite "), F.col("r.status")))
                   .when(~F.col("rewritten"), F.lit("unrewritable"))
                   .when(F.col("c.status") != "ok", F.concat(F.lit("reasoning "), F.col("c.status")))
                   .otherwise(F.lit("ok"))))
    return rows.select(
        F.col("query").alias("original_prompt"), F.col("r.rewrite_logic"),
        F.col("question").alias("original_question"), F.col("r.ambiguous_question"),
        F.col("r.difficulty_analysis"), F.col("c.thought").alias("cot_process"),
        F.col("c.block").alias("clarification_question"), status.alias("status"))


# --- metric rejection ------------------------------------------------------------

def reject_request() -> Column:
    return F.when(F.col("swap.question").isNotNull(), render(
        "reject_reasoning", schema=F.col("schema"), question=F.col("swap.question")))


def metric_swaps(seeds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    swap = swap_metric(F.col("question"), F.col("query"), metrics)
    return once(with_gaps(seeds, "metric_reject"), swap=F.when(F.col("gaps") == "", swap))


def reject_rows(seeds: DataFrame, responses: DataFrame, metrics: Sequence[str]) -> DataFrame:
    swaps = seeds if "swap" in seeds.columns else metric_swaps(seeds, metrics)
    rows = attach_responses(swaps, reject_request(), responses)
    rows = once(rows, c=tagged_blocks(F.col("reply"), S.CONCLUSION_TAG, S.REFUSAL_SENTENCE))
    status = F.coalesce(
        _gap_status(),
        F.when(F.col("swap.question").isNull(), F.lit("no_metric"))
        .when(F.col("reply").isNull(), F.lit("no_reply")).otherwise(F.col("c.status")))
    return rows.select(
        F.col("query").alias("original_prompt"), F.col("question").alias("original_question"),
        F.col("swap.question").alias("swapped_question"), F.col("swap.metric").alias("new_indicator"),
        F.col("c.thought").alias("cot_process"), F.col("c.block").alias("conclusion"),
        status.alias("status"))


# --- constraint follow-up ----------------------------------------------------------

EXTRACT_FIELDS = ("think", "constraint_description")


def constraint_request() -> Column:
    return _ask("constraint_extract", schema=F.col("schema"), knowledge=F.col("knowledge"),
                domain=F.col("domain"), data=F.col("data"), question=F.col("question"))


def constraint_check_request() -> Column:
    named = ~F.col("x.constraint_description").contains(S.CANNOT_EXTRACT)
    return F.when(named & (F.col("x.status") == "ok"), render(
        "constraint_check", question=F.col("question"), constraint=F.col("x.constraint_description")))


def constraint_reasoning_request() -> Column:
    return F.when(F.col("modified_prompt").isNotNull(), render(
        "constraint_reasoning", prompt=F.col("modified_prompt"), example=F.col("original_question"),
        example_think=first_think(F.col("example_response"))))


def constraint_extracts(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompt and question of the seeds with the extracted constraint ``x``."""
    rows = attach_responses(with_gaps(seeds, "constraint_ask"), constraint_request(), responses, "extract").select(
        "query", "question", "gaps", "extract")
    return once(rows, x=fenced_json_fields(F.col("extract"), EXTRACT_FIELDS)).drop("extract")


def constraint_steps(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """Extracted constraints with the outcome of the check and the extended prompt."""
    extracts = seeds if "x" in seeds.columns else constraint_extracts(seeds, responses)
    rows = attach_responses(extracts, constraint_check_request(), responses, "check")
    open_case = constraint_check_request().isNotNull() & ~constraint_met(F.col("check"))
    return once(rows, open_case=F.coalesce(open_case, F.lit(False))).withColumn(
        "modified_prompt", F.when(F.col("open_case"), insert_constraint(
            F.col("query"), F.col("x.constraint_description")))).drop("check")


def constraint_examples(seeds: DataFrame, responses: DataFrame, examples: DataFrame,
                        example_key: str) -> DataFrame:
    """Steps with one example each. ``examples``: example_key, original_question, response."""
    pool = examples.select(example_key, "original_question", F.col("response").alias("example_response"))
    steps = seeds if "modified_prompt" in seeds.columns else constraint_steps(seeds, responses)
    return attach_example(steps, prompt_key(F.col("query")), pool, example_key)


def constraint_rows(seeds: DataFrame, responses: DataFrame, examples: DataFrame,
                    example_key: str) -> DataFrame:
    attached = "example_response" in seeds.columns
    steps = seeds if attached else constraint_examples(seeds, responses, examples, example_key)
    rows = attach_responses(steps, constraint_reasoning_request(), responses, "reasoning")
    status = F.coalesce(
        _gap_status(),
        F.when(F.coalesce(F.col("x.status") != "ok", F.lit(True)) | F.col("x.constraint_description").isNull(),
               F.lit("no_constraint"))
        .when(F.col("x.constraint_description").contains(S.CANNOT_EXTRACT), F.lit("cannot_extract"))
        .when(~F.col("open_case"), F.lit("skip"))
        .when(F.col("modified_prompt").isNull(), F.lit("no_anchor"))
        .when(is_blank(F.col("reasoning")), F.lit("no_reply"))
        .otherwise(F.lit("success")))
    done = F.col("status") == "success"
    return rows.withColumn("status", status).select(
        "status", F.when(F.col("status") == "skip", F.lit("conflict")).otherwise(F.col("x.think")).alias("reason"),
        F.col("query").alias("original_prompt"), F.col("question").alias("original_question"),
        F.when(done, F.col("x.constraint_description")).alias("added_constraint"),
        F.when(done, F.col("modified_prompt")).alias("modified_prompt"),
        F.when(done, F.col("reasoning")).alias("cot_process"))


FINAL_CONSTRAINT_STATES = ("success", "skip", "cannot_extract")


def finished_constraints(rows: DataFrame) -> DataFrame:
    """Rows that count as done; all others are tried again on the next run."""
    return rows.filter(F.col("status").isin(*FINAL_CONSTRAINT_STATES))


# --- multi-step reasoning ------------------------------------------------------------

QUESTION_FIELDS = ("thought_process", "solution_steps", "question", "question_analysis", "sql")


def _knowledge() -> dict[str, Column]:
    return {n: F.col(n) for n in ("schema", "knowledge", "domain", "data")}


def steps_request() -> Column:
    return _ask("steps_question", **_knowledge())


def steps_sql_request() -> Column:
    return F.when(F.col("q.status") == "ok", render(
        "steps_sql", **_knowledge(), question=F.col("q.question"), analysis=F.col("q.question_analysis")))


def steps_check_request() -> Column:
    return F.when(F.col("sql").isNotNull(), render(
        "steps_check", **_knowledge(), question=F.col("q.question"), sql=F.col("sql")))


def steps_reasoning_request() -> Column:
    return F.when(F.col("sql").isNotNull(), render(
        "steps_reasoning", **_knowledge(), question=F.col("q.question"), sql=F.col("sql")))


def steps_candidates(draws: DataFrame, responses: DataFrame) -> DataFrame:
    """Invented question ``q`` and refined ``sql`` per drawn seed (null where a reply fails)."""
    rows = attach_responses(with_gaps(draws, "multi_step"), steps_request(), responses, "invented")
    rows = once(rows, q=fenced_json_fields(F.col("invented"), QUESTION_FIELDS))
    rows = attach_responses(rows, steps_sql_request(), responses, "refined")
    refined = fenced_json_fields(F.col("refined"), ("sql",))
    return once(rows, s=refined).withColumn(
        "sql", F.when((F.col("s.status") == "ok") & (F.col("q.status") == "ok"), F.col("s.sql")))


def steps_rows(candidates: DataFrame, outcomes: DataFrame, votes: DataFrame, responses: DataFrame,
               n_judges: int = S.UNANIMOUS_JUDGES) -> DataFrame:
    """Keep candidates whose SQL runs and which every judge accepts.

    ``outcomes``: sql_key, ok. ``votes``: prompt_key, judge_id, text.
    """
    ran = outcomes.select("sql_key", F.col("ok").alias("runs"))
    rows = candidates.withColumn("sql_key", join_key(F.col("sql"), *candidates.columns)).join(ran, "sql_key", "left")
    ballots = votes.select(F.col("prompt_key").alias("case_id"), "judge_id",
                           vote_flag(F.col("text")).alias("verdict"))
    accepted = unanimous_vote(ballots, n_judges).select(
        F.col("case_id").alias("check_key"), F.col("verdict").alias("accepted"))
    rows = rows.withColumn("check_key", join_key(steps_check_request(), *rows.columns)).join(accepted, "check_key", "left")
    rows = attach_responses(rows, steps_reasoning_request(), responses, "reasoning")
    status = F.coalesce(
        _gap_status(),
        F.when(F.coalesce(F.col("q.status"), F.lit("not_json")) != "ok", F.lit("no_question"))
        .when(is_blank(F.col("sql")), F.lit("no_sql"))
        .when(~F.coalesce("runs", F.lit(False)), F.lit("sql_failed"))
        .when(~F.coalesce("accepted", F.lit(False)), F.lit("not_accepted"))
        .when(is_blank(F.col("reasoning")), F.lit("no_reply"))
        .otherwise(F.lit("ok")))
    return rows.select(
        F.col("query").alias("original_prompt"), F.col("q.thought_process"),
        F.from_json("q.solution_steps", "array<string>").alias("steps"), F.col("q.question"), "sql",
        strip(F.col("reasoning")).alias("cot_process"), status.alias("status"))


# --- reflection ----------------------------------------------------------------------

def fault_request() -> Column:
    return _ask("fault_injection", fault=F.col("fault.name"), instruction=F.col("fault.instruction"),
                sql=F.col("correct_sql"))


def fault_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds with sections, correct SQL and one drawn fault type."""
    rows = once(with_gaps(seeds, "reflection"), correct_sql=sql_in_reply(F.col("response")))
    gaps = F.when(F.col("correct_sql").isNull(), F.concat_ws(",", F.nullif("gaps", F.lit("")), F.lit("sql")))
    return rows.withColumn("gaps", gaps.otherwise(F.col("gaps"))).withColumn(
        "fault", fault_for(F.col("query")))


FAULT_COLUMNS = ("query", "question", "correct_sql", "schema", "knowledge", "domain")


def broken_statements(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """Two broken statements per seed with a usable reply."""
    rows = seeds if "fault" in seeds.columns else fault_seeds(seeds)
    rows = attach_responses(rows, fault_request(), responses, "faults")
    return explode_faults(rows.filter(F.col("gaps") == ""), "faults", *FAULT_COLUMNS)


def reflection_request() -> Column:
    return render("fault_reflection", schema=F.col("schema"), knowledge=F.col("knowledge"),
                  domain=F.col("domain"), question=F.col("question"), wrong_sql=F.col("error_sql"),
                  message=F.col("error_message"), right_sql=F.col("correct_sql"))


def failing_statements(broken: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Statements that do fail, with their message; ones that run by accident drop out.

    ``outcomes``: sql_key, ok, message.
    """
    failed = outcomes.filter(~F.col("ok")).select("sql_key", F.col("message").alias("error_message"))
    return broken.withColumn("sql_key", prompt_key(F.col("error_sql"))).join(failed, "sql_key").drop("sql_key")


def reflection_rows(failing: DataFrame, responses: DataFrame) -> DataFrame:
    rows = attach_responses(failing, reflection_request(), responses)
    return rows.filter(~is_blank(F.col("reply"))).select(
        F.col("query").alias("original_prompt"), "question", "correct_sql", "error_sql", "error_type",
        "error_message", strip(F.col("reply")).alias("reflection_process"),
        F.col("schema").alias("schema_info"), F.col("knowledge").alias("knowledge_info"),
        F.col("domain").alias("domain_info"))


# --- one corpus ----------------------------------------------------------------------

#: Columns of the corpus; all texts. ``source`` tells the family that made a row, ``task`` partitions the table.
CORPUS_COLUMNS = ("task", "source", "status", "prompt", "question", "answer", "reasoning", "wrong_sql", "fault")

# Where each family keeps them; what a family does not have is null.
_FAMILIES = {
    "clarify": {"prompt": "original_prompt", "question": "ambiguous_question", "answer": "clarification_question",
                "reasoning": "cot_process"},
    "metric_reject": {"prompt": "original_prompt", "question": "swapped_question", "answer": "conclusion", "reasoning": "cot_process"},
    "constraint_ask": {"prompt": "modified_prompt", "question": "original_question", "answer": "added_constraint", "reasoning": "cot_process"},
    "multi_step": {"prompt": "original_prompt", "question": "question", "answer": "sql", "reasoning": "cot_process"},
    "reflection": {"prompt": "original_prompt", "question": "question", "answer": "correct_sql",
                   "reasoning": "reflection_process", "wrong_sql": "error_sql", "fault": "error_type"},
}


def corpus_family(rows: DataFrame, task: str, source: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of one family in the columns of the corpus; a family without a status holds finished rows only."""
    given = {"status": "status", **(_FAMILIES[task] if columns is None else columns)}
    text = lambda c: (F.col(given[c]) if given.get(c) in rows.columns else F.lit(None)).cast("string")
    named = {"task": F.lit(task), "source": F.lit(source), "status": F.coalesce(text("status"), F.lit("ok"))}
    return rows.select(*[named.get(c, text(c)).alias(c) for c in CORPUS_COLUMNS])


def seed_rows(seeds: DataFrame) -> DataFrame:
    """Seeds that hold a statement, as plain SQL rows of the corpus."""
    question = F.col("question") if set(SECTIONS) <= set(seeds.columns) else question_text(F.col("query"))
    rows = once(seeds, sql=sql_in_reply(F.col("response"))).select(
        "query", question.alias("question"), "sql",
                        F.nullif(first_think(F.col("response")), F.lit("")).alias("think")).where("sql is not null")
    return corpus_family(rows, "sql", "seed", {
        "prompt": "query", "question": "question", "answer": "sql", "reasoning": "think"})


def given_rows(rows: DataFrame, tasks: tuple[str, ...] = ("degenerate_dim", "dim_reject")) -> DataFrame:
    """Rows of tasks that no family makes: ``(task, prompt, answer, reasoning)`` as they were given."""
    return reduce(DataFrame.unionByName, [
        corpus_family(rows.where(F.col("task") == t), t, "given", {
            "prompt": "prompt", "answer": "answer", "reasoning": "reasoning"}) for t in tasks])


def training_corpus(families: Mapping[str, DataFrame], *more: DataFrame) -> DataFrame:
    """One table over all families (by task) and rows already in its columns."""
    made = [corpus_family(df, task, "mutation") for task, df in families.items()]
    return reduce(DataFrame.unionByName, [*made, *more])
