"""Scalar scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.replies import has_reply_format, sole_answer, strict_answer
from sqlgauge.functions.sqltext import is_sql_answer, is_sql_gold
from sqlgauge.functions.text import strip

# Text that counts as a number. Casting alone would accept forms such as '1d'.
NUMBER_PATTERN = r"\A\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*\z"


def numeric(c: Column) -> Column:
    """Number behind a text, null for any other text."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def within(x: Column, y: Column, rel: float = S.CELL_REL_TOL, tol: float = S.CELL_ABS_TOL) -> Column:
    """Numbers within ``rel`` of the larger magnitude or within ``tol`` of each other."""
    return (x == y) | (F.abs(x - y) <= F.greatest(F.lit(rel) * F.greatest(F.abs(x), F.abs(y)), F.lit(tol)))


def cells_close(a: Column, b: Column, rel: float = S.CELL_REL_TOL, tol: float = S.CELL_ABS_TOL,
                numbers: bool = False) -> Column:
    """Equal text or close numbers; null equals null only. ``NaN`` is a text here, so it equals itself only.

    Cells of columns of ``numbers`` that read ``NaN`` stand for no number, and are close to nothing.
    """
    close = a.eqNullSafe(b) | F.coalesce(within(numeric(a), numeric(b), rel, tol), F.lit(False))
    return ~(a.eqNullSafe("NaN") | b.eqNullSafe("NaN")) & close if numbers else close


def value_hit(pred: Column, gold: Column) -> Column:
    """Within one per cent of gold (absolute near zero), else equal stripped text."""
    p, g = numeric(pred), numeric(gold)
    both = p.isNotNull() & g.isNotNull()
    near = F.when(g == 0, F.abs(p - g) < S.VALUE_ZERO_TOL).otherwise(
        F.abs(p - g) / F.abs(g) < S.VALUE_REL_TOL)
    return F.when(both, near).otherwise(
        (strip(pred) == strip(gold)) & (pred != "NaN"))


def format_reward(content: Column) -> Column:
    return F.coalesce(has_reply_format(content), F.lit(False)).cast("double")


def length_reward(n_tokens: Column, max_length: int = S.SOFT_MAX_LENGTH,
                  cache: int = S.SOFT_CACHE_LENGTH) -> Column:
    """Zero up to ``max_length - cache`` tokens, then falling without a floor."""
    return F.least(-(n_tokens - (max_length - cache)) / F.lit(float(cache)), F.lit(0.0))


def grammar_reward(content: Column, gold: Column, task: Column, valid: Column) -> Column:
    """Validity of a SQL answer; degenerate dimension is rewarded for *not* being valid."""
    answer = sole_answer(content)
    valid = F.coalesce(valid, F.lit(False))
    return (
        F.when(answer.isNull(), F.lit(0.0))
        .when(task.eqNullSafe("degenerate_dim"), (~valid).cast("double"))
        .when(is_sql_answer(answer), valid.cast("double"))
        .when(F.coalesce(is_sql_gold(gold), F.lit(False)), F.lit(0.0))
        .otherwise(F.lit(1.0))
    )


def exact_reward(content: Column, gold: Column) -> Column:
    return F.coalesce(strict_answer(content) == strip(gold), F.lit(False)).cast("double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a missing, empty or zero vector gives 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) > 0) & (F.size(b) > 0) & (norms > 0)
    return F.when(F.coalesce(usable, F.lit(False)), F.try_divide(_dot(a, b), norms)).otherwise(F.lit(0.0))


def similarity_reward(sim: Column) -> Column:
    return (
        F.when(sim >= S.SIMILARITY_FULL, sim)
        .when(sim >= S.SIMILARITY_PARTIAL, sim * S.SIMILARITY_PARTIAL_FACTOR)
        .otherwise(F.lit(0.0))
    )


def set_score(pred: Column, gold: Column, mode: str = "recall") -> Column:
    """Recall of gold, or Jaccard; nothing wanted scores 1, nothing given scores 0."""
    base = gold if mode == "recall" else F.array_union(gold, pred)
    share = F.try_divide(F.size(F.array_intersect(pred, gold)),
                         F.size(F.array_distinct(base)))
    return (
        F.when(F.size(gold) == 0, F.lit(1.0))
        .when(F.size(pred) == 0, F.lit(0.0))
        .otherwise(share)
    )


def rule_score(table: Column, column: Column, keyword: Column, literal: Column,
               parsed: Column) -> Column:
    w = S.RULE_WEIGHTS
    total = (w["table"] * table + w["column"] * column
             + w["keyword"] * keyword + w["literal"] * literal)
    return F.when(parsed, F.round(total, 4)).otherwise(F.lit(0.0))


def row_count_score(n_gold: Column, n_pred: Column) -> Column:
    ratio = F.try_divide(F.greatest(n_gold, n_pred), F.least(n_gold, n_pred))
    return (
        F.when(n_gold == n_pred, F.lit(1.0))
        .when((n_gold == 0) | (n_pred == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.lit(0.3) * F.log(ratio)))
    )


def schema_score(sim_sum: Column, n_gold: Column, n_pred: Column) -> Column:
    """Matched similarity per gold column, damped by surplus predicted columns."""
    surplus = F.greatest(n_pred - n_gold, F.lit(0))
    damped = F.try_divide(sim_sum, n_gold) / (F.lit(1.0) + F.lit(0.2) * F.try_divide(surplus, n_gold))
    score = F.greatest(F.lit(0.0), F.least(damped, F.lit(1.0)))
    return F.when((n_gold == 0) | (n_pred == 0), F.lit(0.0)).otherwise(score)


def f1_score(hits: Column, n_pred: Column, n_gold: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without hits."""
    return F.when(hits > 0, 2 * hits / (n_pred + n_gold)).otherwise(F.lit(0.0))


def dense_score(schema: Column, rows: Column, value: Column, both_empty: Column) -> Column:
    w = S.DENSE_WEIGHTS
    total = w["schema"] * schema + w["rows"] * rows + w["value"] * value
    return F.when(both_empty, F.lit(0.0)).otherwise(F.round(total, 4))


def total_reward(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of named rewards."""
    weights = S.REWARD_WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * parts[name]
    return total


def majority(true_votes: Column, false_votes: Column) -> Column:
    """The side with more valid votes; null on a tie or without votes."""
    return F.when(true_votes > false_votes, True).when(false_votes > true_votes, False)
