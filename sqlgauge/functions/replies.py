"""Parse model replies. Every parser yields columns and a status, never an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.text import bind, is_blank, strip

# Reply patterns.
THINK_PATTERN = r"(?s)<think>(.*?)</think>"
ANSWER_PATTERN = r"(?s)<answer>(.*?)</answer>"
FORMAT_PATTERN = r"(?s)<think>.*?</think>\s*<answer>.*?</answer>"
FENCE_PATTERN = r"(?is)```(?:res)?\s*(.*?)\s*```"
JSON_FENCE_PATTERN = r"(?s)```json\s*(.*?)\s*```"
JSON_OBJECT_FENCE_PATTERN = r"(?s)```json\s*(\{.*?\})\s*```"
OUTER_OBJECT_PATTERN = r"(?s)\{.*\}"
ARROW_SQL_PATTERN = r"(?id)SQL\s*->\s*(SELECT[\s\S]+?)(?:\n\n|$)"
SQL_FENCE_PATTERN = r"(?i)```sql\s*([\s\S]+?)\s*```"
BARE_SQL_PATTERN = r"(?id)(SELECT[\s\S]+?)(?:\n\n|$)"


def _group(c: Column, pattern: str) -> Column:
    """Stripped first group of the first match; null without a match.

    The match is drawn out to the end of the text, so the pattern is tried once, and matches once at most.
    """
    return strip(F.get(F.regexp_extract_all(c, F.lit(rf"(?:{pattern})[\s\S]*"), 1), F.lit(0)))


def occurrences(c: Column, text: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


# --- tags --------------------------------------------------------------------

def first_answer(c: Column) -> Column:
    return _group(c, ANSWER_PATTERN)


def first_think(c: Column) -> Column:
    return F.coalesce(_group(c, THINK_PATTERN), F.lit(""))


def sole_answer(c: Column) -> Column:
    """Answer of a text with exactly one opening and one closing answer tag, else null."""
    once = (occurrences(c, "<answer>") == 1) & (occurrences(c, "</answer>") == 1)
    return F.when(once, first_answer(c))


def strict_answer(c: Column) -> Column:
    """Answer of a text with exactly one of each of the four tags, else null."""
    once = F.lit(True)
    for tag in S.EMPTY_ANSWER_TAGS:
        once = once & (occurrences(c, tag) == 1)
    return F.when(once & c.rlike(THINK_PATTERN), first_answer(c))


def has_reply_format(c: Column) -> Column:
    return c.rlike(FORMAT_PATTERN)


def think_and_answer(c: Column, strip_lang: bool = False) -> Column:
    """Tags first, then a fenced block, then the whole text as the answer."""
    think, answer = _group(c, THINK_PATTERN), first_answer(c)
    fenced = _group(c, FENCE_PATTERN)
    if strip_lang:
        fenced = F.regexp_replace(fenced, r"(?i)\Asql\s+", "")
    tagged = think.isNotNull() | answer.isNotNull()
    empty = F.lit("")
    return F.struct(
        F.when(tagged, F.coalesce(think, empty))
        .when(fenced.isNotNull(), strip(F.substring_index(c, "```", 1)))
        .otherwise(empty).alias("think"),
        F.when(tagged, F.coalesce(answer, empty))
        .when(fenced.isNotNull(), fenced)
        .otherwise(F.coalesce(c, empty)).alias("answer"),
    )


def trained_think_and_answer(c: Column, base_model: bool = False) -> Column:
    """Tags only; a base model's answer is its text without the think block."""
    answer = F.coalesce(first_answer(c), F.lit(""))
    if base_model:
        answer = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    return F.struct(first_think(c).alias("think"), answer.alias("answer"))


def tagged_blocks(c: Column, second_tag: str, must_contain: str | None = None) -> Column:
    """Thought block and the block after ``second_tag``: struct of thought, block, status."""
    pattern = r"(?s)\[思考过程\](.*?)\[" + second_tag.strip("[]") + r"\](.*)"
    hit = c.rlike(pattern)
    thought = F.when(hit, strip(F.regexp_extract(c, pattern, 1)))
    block = F.when(hit, strip(F.regexp_extract(c, pattern, 2)))
    status = F.when(~F.coalesce(hit, F.lit(False)), F.lit("no_tags"))
    if must_contain is not None:
        status = status.when(~block.contains(must_contain), F.lit("wrong_block"))
    return F.struct(thought.alias("thought"), block.alias("block"),
                    status.otherwise(F.lit("ok")).alias("status"))


# --- SQL and replacement messages ---------------------------------------------

def sql_in_reply(c: Column) -> Column:
    """SQL of a free text: after an arrow, else in a fence, else from a bare SELECT."""
    return F.coalesce(F.when(c.contains("->"), _group(c, ARROW_SQL_PATTERN)),
                      F.when(c.contains("```"), _group(c, SQL_FENCE_PATTERN)), _group(c, BARE_SQL_PATTERN))


def replacement_target(c: Column) -> Column:
    """New value of a message ``kind:old -> new`` (``''`` without an arrow)."""
    return F.when(c.contains("->"), strip(F.get(F.split(c, "->"), F.lit(1)))).otherwise(F.lit(""))


# --- JSON ----------------------------------------------------------------------

def strict_json(c: Column) -> Column:
    """``c`` if it is one complete JSON value, else null.

    The JSON functions ignore text after the first value, so the text is checked as a
    member between two known keys of an object.
    """
    def checked(text: Column) -> Column:
        wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"end":0}'))
        whole = F.array_join(F.json_object_keys(wrapped), ",") == "v,end"
        return F.when(whole & ~is_blank(text), text)

    return bind(c, checked)


def without_fences(c: Column) -> Column:
    no_json = F.replace(strip(c), F.lit("```json"), F.lit(""))
    return F.replace(no_json, F.lit("```"), F.lit(""))


def json_fields(c: Column, fields: Sequence[str], required: Sequence[str] | None = None) -> Column:
    """Struct of the wanted fields as text plus a status.

    A required key must be present; a null value passes. Status is ``ok``,
    ``missing_keys`` or ``not_json``.
    """
    required = fields if required is None else required
    wanted = F.array(*[F.lit(k) for k in required])

    def read(doc: Column) -> Column:
        present = F.size(F.array_intersect(F.json_object_keys(doc), wanted)) == len(required)
        status = (
            F.when(doc.isNull(), F.lit("not_json"))
            .when(F.coalesce(present, F.lit(False)), F.lit("ok"))
            .otherwise(F.lit("missing_keys"))
        )
        parsed = F.from_json(doc, ", ".join(f"`{f}` string" for f in fields))
        return bind(parsed, lambda r: F.struct(*[r[f].alias(f) for f in fields], status.alias("status")))

    return bind(strict_json(c), read)


def fenced_json_fields(c: Column, fields: Sequence[str], required: Sequence[str] | None = None) -> Column:
    return json_fields(without_fences(c), fields, required)


def json_flag(doc: Column, name: str) -> Column:
    """A JSON boolean; anything else, the text "true" included, is null."""
    return F.from_json(doc, f"`{name}` boolean")[name]


def vote_flag(c: Column, name: str = "is_correct") -> Column:
    """True only if the fenced (or last) object of a vote holds the boolean true."""
    fenced = F.when(c.rlike(JSON_OBJECT_FENCE_PATTERN),
                    F.regexp_extract(c, JSON_OBJECT_FENCE_PATTERN, 1))
    tail = F.when(c.contains("{"), F.concat(F.lit("{"), F.substring_index(c, "{", -1)))
    doc = strict_json(F.coalesce(fenced, tail))
    return F.coalesce(json_flag(doc, name), F.lit(False))


def constraint_met(c: Column) -> Column:
    """Flag of a conflict check: met unless a readable reply says otherwise."""
    doc = strict_json(without_fences(c))
    return F.coalesce(json_flag(doc, "constraint_satisfied"), F.lit(True))


def result_judgement(c: Column) -> Column:
    """Verdict and reason; first readable fence part, unreadable replies count as false."""
    parts = F.transform(F.split(strip(c), "```"), lambda p: strip(p))
    usable = F.filter(parts, lambda p: p.startswith("json") | p.startswith("{"))
    first = F.get(usable, F.lit(0))
    inner = F.when(first.startswith("json"), F.substr(first, F.lit(5))).otherwise(first)
    doc = F.coalesce(strict_json(c), strict_json(F.when(c.contains("```"), inner)))
    return F.struct(
        F.coalesce(json_flag(doc, "is_equivalent"), F.lit(False)).alias("verdict"),
        F.when(doc.isNull(), F.lit("format error"))
        .otherwise(F.coalesce(F.get_json_object(doc, "$.reason"), F.lit("no reason"))).alias("reason"),
    )


def sql_judgement(c: Column) -> Column:
    """Verdict of a statement judge after removing a leading and a trailing fence."""
    body = F.regexp_replace(c, r"\A```(?:json)?", "")
    body = strip(F.regexp_replace(body, r"```\z", ""))
    return json_flag(strict_json(body), "is_equivalent")


def sentence_judgement(c: Column) -> Column:
    """Verdict, reason and status of a sentence judge: whole text, else first { to last }."""
    outer = F.when(c.rlike(OUTER_OBJECT_PATTERN), F.regexp_extract(c, OUTER_OBJECT_PATTERN, 0))
    doc = F.coalesce(strict_json(c), strict_json(outer))
    return F.struct(
        json_flag(doc, "is_identical").alias("verdict"),
        F.when(doc.isNotNull(),
               F.coalesce(F.get_json_object(doc, "$.reason"), F.lit("no reason"))).alias("reason"),
        F.when(doc.isNull(), F.lit("not_json")).otherwise(F.lit("ok")).alias("status"),
    )


FAULT_SCHEMA = "array<struct<error_type_applied string, modified_sql string>>"


def fault_pairs(c: Column) -> Column:
    """The two broken statements of a reply; null unless the array has exactly two items."""
    body = F.when(c.rlike(JSON_FENCE_PATTERN), F.regexp_extract(c, JSON_FENCE_PATTERN, 1)).otherwise(c)
    doc = strict_json(strip(body))
    items = F.from_json(doc, FAULT_SCHEMA)
    return F.when(doc.startswith("[") & (F.json_array_length(doc) == 2), items)


def explode_faults(df: DataFrame, reply: str, *keep: str) -> DataFrame:
    """One row per broken statement; unusable replies and empty statements drop out."""
    return (
        df.select(*keep, F.posexplode(fault_pairs(F.col(reply))).alias("fault_no", "f"))
        .select(*keep, "fault_no",
                F.coalesce(F.col("f.error_type_applied"), F.lit("")).alias("error_type"),
                F.col("f.modified_sql").alias("error_sql"))
        .filter(F.coalesce(F.col("error_sql"), F.lit("")) != "")
    )
