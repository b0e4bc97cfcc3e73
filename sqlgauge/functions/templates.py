"""Request texts. Templates are cut at plan time, so rendering is one ``concat``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge import settings as S

TEMPLATES = {
    "clarify_rewrite": (
        "Make the question below ambiguous in one of these ways: {categories}.\n"
        "Schema:\n{schema}\nQuestion: {question}\n"
        "Reply as JSON with rewrite_logic, ambiguous_question and difficulty_analysis."
    ),
    "clarify_reasoning": (
        "Context:\n{context}\nQuestion: {question}\nWhy it is ambiguous: {reason}\n"
        "Reply with [思考过程] and then [澄清问题]."
    ),
    "reject_reasoning": (
        "Schema:\n{schema}\nQuestion that cannot be answered: {question}\n"
        "Reply with [思考过程] and then [结论]."
    ),
    "constraint_extract": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nData:\n{data}\n"
        "Question: {question}\nName one constraint the question does not meet. "
        "Reply as JSON with think and constraint_description."
    ),
    "constraint_check": (
        "Question: {question}\nConstraint: {constraint}\n"
        "Is the constraint met? Reply as JSON with constraint_satisfied."
    ),
    "constraint_reasoning": (
        "Prompt:\n{prompt}\nExample question: {example}\nExample reasoning:\n{example_think}\n"
        "Reason why the constraint must be asked for, then ask."
    ),
    "steps_question": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nData:\n{data}\n"
        "Invent a two-step business question. Reply as JSON with thought_process, "
        "solution_steps, question, question_analysis and sql."
    ),
    "steps_sql": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nData:\n{data}\n"
        "Question: {question}\nAnalysis: {analysis}\nReply as JSON with sql."
    ),
    "steps_check": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nData:\n{data}\n"
        "Question: {question}\nSQL:\n{sql}\nReply as JSON with is_correct."
    ),
    "steps_reasoning": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nData:\n{data}\n"
        "Question: {question}\nSQL:\n{sql}\nTell how an analyst arrives at this SQL."
    ),
    "fault_injection": (
        "Break this SQL in two different ways, first by: {fault} - {instruction}\n{sql}\n"
        "Reply as a JSON array of two objects with error_type_applied and modified_sql."
    ),
    "fault_reflection": (
        "Schema:\n{schema}\nMetrics:\n{knowledge}\nRules:\n{domain}\nQuestion: {question}\n"
        "Failing SQL:\n{wrong_sql}\nError: {message}\nCorrect SQL:\n{right_sql}\n"
        "Tell in the first person how the fault is found and repaired."
    ),
    "judge_results": (
        "Question: {question}\nSchema:\n{schema}\nKnowledge:\n{knowledge}\n{domain}\n{data}\n"
        "Result A:\n{result_a}\nResult B:\n{result_b}\n"
        "Does B answer the question as A does? Reply as JSON with reason and is_equivalent."
    ),
    "judge_sql": (
        "Question: {question}\nSchema:\n{schema}\nQuery 1:\n{sql_a}\nQuery 2:\n{sql_b}\n"
        "Are they equivalent on every database? Reply as JSON with reasoning and is_equivalent."
    ),
    "judge_sentences": (
        "Sentence A: {sentence_a}\nSentence B: {sentence_b}\n"
        "Do they say exactly the same? Reply as JSON with reason and is_identical."
    ),
    "task_exclusion": (
        "Context:\n{context}\nQuestion: {question}\nFinal answer: {answer}\n"
        "Rule out each of these task types:\n{types}"
    ),
}

CLARIFY_CATEGORIES = "unclear time; unclear place; unclear metric; unclear level of detail"
CLOSED_SUFFIX = "\nPut every final statement or conclusion into a ```res fence."

_SLOT = re.compile(r"\{(\w+)\}")


def render(template_id: str, **values: Column | str) -> Column:
    """Fill a template. Values are inserted as they are, never scanned for slots."""
    parts = []
    for i, piece in enumerate(_SLOT.split(TEMPLATES[template_id])):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            value = values[piece]
            value = F.lit(value) if isinstance(value, str) else value
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)


def other_task_list(task: Column) -> Column:
    """Definitions of every task type but ``task``, one per line."""
    listing = F.lit(None).cast("string")
    everything = "\n".join(f"{n}: {d}" for n, d in S.TASK_DEFINITIONS.items())
    for own in S.TASK_DEFINITIONS:
        lines = "\n".join(f"{n}: {d}" for n, d in S.TASK_DEFINITIONS.items() if n != own)
        listing = F.when(task == own, F.lit(lines)).otherwise(listing)
    return F.coalesce(listing, F.lit(everything))
