"""Column functions over structured prompts: find, cut, replace and extend parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge import settings as S

# Patterns of the prompt layout.
KNOWLEDGE_PATTERN = r"(?sU)---\s*3\.knowledge graph\s*(.*?)---\s*4\.domain kg"
DOMAIN_PATTERN = r"(?sU)---\s*4\.domain kg\s*(.*?)---\s*5\.data kg"
DATA_PATTERN = r"(?sU)---\s*5\.data kg\s*(.*?)---\s*6\.few shot"
QUESTION_PATTERN = r"(?s).*问题：(.*?)，写出对应的SQL语句"
FORMULA_LINE_PATTERN = r"(?smdU)\A(.*?)(^[^\S\n]*计算逻辑：.*)\z"
CONSTRAINT_PATTERN = r"必备约束：([^\n]*)"


# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` needs it."""
    return F.transform(F.array(value), use)[0]


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def between_markers(c: Column, start: str, end: str) -> Column:
    """Text between the first ``start`` and the first ``end``; ``''`` when out of order."""
    a, b = F.locate(start, c), F.locate(end, c)
    begin = a + F.lit(len(start))
    found = (a > 0) & (b > 0) & (b >= begin)
    return F.when(found, strip(F.substr(c, begin, b - begin))).otherwise(F.lit(""))


def schema_section(c: Column) -> Column:
    return between_markers(c, S.SCHEMA_MARKER, S.KNOWLEDGE_MARKER)


def knowledge_section(c: Column) -> Column:
    return strip(F.regexp_extract(c, KNOWLEDGE_PATTERN, 1))


def domain_section(c: Column) -> Column:
    return strip(F.regexp_extract(c, DOMAIN_PATTERN, 1))


def data_section(c: Column) -> Column:
    """Data knowledge; hyphens are list bullets there and are dropped."""
    return F.translate(strip(F.regexp_extract(c, DATA_PATTERN, 1)), "-", "")


def question_text(c: Column) -> Column:
    """The last question that is followed by the closing phrase."""
    return strip(F.regexp_extract(c, QUESTION_PATTERN, 1))


def replace_question(c: Column, new: Column) -> Column:
    """Swap the *first* question for ``new``, taken literally; no question, no change."""
    a = F.locate(S.QUESTION_OPEN, c)
    after = a + F.lit(len(S.QUESTION_OPEN))
    b = F.when(a > 0, F.locate(S.QUESTION_CLOSE, F.substr(c, after)))
    swapped = F.concat(
        F.substr(c, F.lit(1), after - F.lit(1)), new, F.substr(c, after + b - F.lit(1))
    )
    return F.when(b > 0, swapped).otherwise(c)


def context_before_examples(c: Column) -> Column:
    return strip(F.substring_index(c, S.FEW_SHOT_MARKER, 1))


SECTIONS = {
    "schema": schema_section,
    "knowledge": knowledge_section,
    "domain": domain_section,
    "data": data_section,
    "question": question_text,
}


def with_sections(df: DataFrame, prompt: str = "query") -> DataFrame:
    """Add one column per prompt section."""
    return df.withColumns({name: cut(F.col(prompt)) for name, cut in SECTIONS.items()})


def missing_sections(required: Sequence[str]) -> Column:
    """Names of the required sections that are empty, joined by commas (``''`` if none)."""
    names = [F.when(F.col(n) == "", F.lit(n)) for n in required]
    return F.array_join(F.array_compact(F.array(*names)), ",")


def section_rows(df: DataFrame, key: str, prompt: str = "query") -> DataFrame:
    """Long form ``(key, section, text)`` of every prompt."""
    parts = [F.struct(F.lit(n).alias("section"), cut(F.col(prompt)).alias("text"))
             for n, cut in SECTIONS.items()]
    return df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.section", "p.text")


def insert_constraint(c: Column, constraint: Column) -> Column:
    """Put a constraint line above the first formula line; null when there is none."""
    head = F.regexp_extract(c, FORMULA_LINE_PATTERN, 1)
    tail = F.regexp_extract(c, FORMULA_LINE_PATTERN, 2)
    line = F.concat(F.lit(S.CONSTRAINT_LABEL), constraint, F.lit("\n"))
    return F.when(tail != "", F.concat(head, line, tail))


def constraint_line(c: Column) -> Column:
    """The constraint named in a reply; null when none was named."""
    found = strip(F.regexp_extract(c, CONSTRAINT_PATTERN, 1))
    return F.when((found != "") & (found != S.NO_CONSTRAINT), found)


def mentions_time(c: Column) -> Column:
    return strip(c) == S.YES_WORD


def prompt_key(c: Column) -> Column:
    """Fixed-width key of a long text: joins shuffle 64 characters, not the text."""
    return F.sha2(c, 256)


def join_key(c: Column, *row: str) -> Column:
    """``prompt_key`` for the kept side of a left join.

    Rows without a text match nothing, but may be most of the rows; they get keys spread by a
    hash of the row instead of meeting as nulls in one task.
    """
    return F.coalesce(prompt_key(c), _no_key(*row))


def _no_key(*row: str) -> Column:
    return F.concat(F.lit("none-"), F.pmod(F.xxhash64(*row), F.lit(4096)).cast("string"))


def join_bytes(c: Column, *row: str) -> Column:
    """``join_key`` to be joined with ``key_bytes``: half as much to shuffle."""
    return F.coalesce(F.unhex(prompt_key(c)), _no_key(*row).cast("binary"))


def key_bytes(key: Column) -> Column:
    """The 32 bytes that a ``prompt_key`` spells; null for any other text."""
    return F.when(key.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(key))


def hash_bucket(c: Column, n: Column | int) -> Column:
    """Reproducible bucket in ``[0, n)`` from the first 60 bits of an MD5."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint") % n
