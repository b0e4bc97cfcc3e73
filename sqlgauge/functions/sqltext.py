"""SQL text as data: canonical form, coarse features, simple predicates.

Everything is token lists and patterns inside Spark expressions. A statement is never
parsed here; whether it is valid is told by the SQL engine (see ``sources.runner``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sqlgauge import settings as S
from sqlgauge.functions.text import bind, strip

KEYWORDS = (
    "ALL AND ANTI ANY AS ASC BETWEEN BY CASE CAST CROSS CURRENT DATE DESC DISTINCT ELSE END ESCAPE EXCEPT "
    "EXISTS FALSE FETCH FIRST FOLLOWING FROM FULL GROUP HAVING ILIKE IN INNER INTERSECT INTERVAL IS "
    "JOIN LATERAL LEFT LIKE LIMIT NATURAL NOT NULL NULLS OFFSET ON OR ORDER OUTER OVER PARTITION PRECEDING "
    "QUALIFY RANGE RECURSIVE RIGHT RLIKE ROW ROWS SELECT SEMI SET THEN TRUE UNBOUNDED UNION USING VALUES "
    "WHEN WHERE WITH"
).split()

_COMMENT = r"--[^\n]*|/\*[\s\S]*?\*/"
_STRING = r"'[^']*+(?:''[^']*+)*+'"
_QUOTED = r"`[^`]*`|\"[^\"]*\""
_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*(?:\s*\.\s*[\p{L}_$][\p{L}\p{N}_$]*)*"
_NUMBER = r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_OTHER = r"<=|>=|<>|!=|\|\||\S"
TOKEN_PATTERN = f"({_COMMENT}|{_STRING}|{_QUOTED}|{_WORD}|{_NUMBER}|{_OTHER})"

# First letter of a lower-case identifier in canonical text (keywords are upper case).
_ID = r"[\p{Ll}\p{Lo}_$][\p{L}\p{N}_$.]*"


def contains_select(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)select"), F.lit(False))


def is_sql_answer(c: Column) -> Column:
    return F.upper(c).contains("SELECT")


def is_sql_gold(c: Column) -> Column:
    return is_sql_answer(c) & ~c.contains(S.UNSUPPORTED_PHRASE)


def _canonical_token(t: Column) -> Column:
    upper = F.upper(t)
    first = F.substring(t, 1, 1)
    return (
        F.when(first.isin("'", '"', "`"), t)
        .when(upper.isin(*KEYWORDS), upper)
        .when(t.contains("."), F.lower(F.regexp_replace(t, r"\s+", "")))  # blanks are in dotted names only
        .otherwise(F.lower(t))
    )


def tokens_of(c: Column) -> Column:
    """Tokens of a statement without comments: upper keywords, lower names."""
    tokens = F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 1)
    kept = F.filter(tokens, lambda t: ~(t.startswith("--") | t.startswith("/*")))
    return F.transform(kept, _canonical_token)


def token_text(c: Column) -> Column:
    """Statement without comments, single blanks, upper keywords, lower names."""
    return F.array_join(tokens_of(c), " ")


def changed_tokens(old: Column, new: Column) -> Column:
    """``lost`` and ``added`` tokens between the longest common beginning and end of two statements."""
    def shared(a: Column, b: Column) -> Column:
        """Number of tokens that two arrays begin with alike."""
        differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
        first = F.array_position(differs, True)
        return F.when(first > 0, first - 1).otherwise(F.size(differs)).cast("int")

    def between(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        # the common end lies behind the common beginning in both
        room = lambda head: F.least(F.size(a), F.size(b)) - head
        tail = lambda head: F.least(shared(F.reverse(a), F.reverse(b)), room(head))
        cut = lambda c, n: F.slice(c, n["head"] + 1, F.size(c) - n["head"] - n["tail"])
        return bind(shared(a, b), lambda h: bind(
            F.struct(h.alias("head"), tail(h).alias("tail")),
            lambda n: F.struct(cut(a, n).alias("lost"), cut(b, n).alias("added"))))

    return bind(F.struct(tokens_of(old).alias("a"), tokens_of(new).alias("b")), between)


def canonical_sql(c: Column) -> Column:
    """One spelling per statement: ``token_text`` from the first SELECT or WITH on.

    Closing semicolons are dropped as well.
    """
    begin = r"(?s)\A.*?(?<![\p{L}\p{N}_.$'\"`])(?=(?:SELECT|WITH)\b)"
    text = F.regexp_replace(token_text(c), begin, "")
    return strip(F.regexp_replace(text, r"[\s;]+\z", ""))


def masked(canonical: Column) -> Column:
    """Canonical text with string literals replaced by ``?``."""
    return F.regexp_replace(canonical, _STRING, "?")


# Where a token stands: in a list of expressions, in the arguments of a call, before and after a relation of a FROM,
# behind ON or USING, in the list of a WITH, or in a list of names that are no columns.
_LIST, _CALL, _RELATION, _JOINED, _ON, _WITH, _NAMES = "q", "c", "f", "r", "o", "w", "x"
_CLAUSES = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "QUALIFY", "OFFSET", "FETCH")


def _scoped_names(tokens: Column) -> Column:
    """``tables``, ``columns`` and ``listed`` (is there a FROM list with a comma?) of masked tokens.

    One pass with a stack: an opening bracket puts the place aside, a closing one takes it back. So a comma behind
    ON belongs to the FROM list of its own level, FROM inside a call is a part of the call, and names are told by
    where they stand: tables, aliases, functions, common tables, units and columns.
    """
    # what a token is by itself is worked out once for each
    is_name = tokens_are(tokens, r"\A[\p{Ll}\p{Lo}_$`\"]")
    is_operand = tokens_are(tokens, r"\A(?:[\p{Ll}\p{Lo}_$`\"\d?)]|(?:END|NULL|TRUE|FALSE)\z)")
    told = F.zip_with(F.zip_with(tokens, is_name, lambda t, n: F.struct(t.alias("t"), n.alias("name"))), is_operand,
                      lambda x, o: F.struct(x["t"].alias("t"), x["name"].alias("name"), o.alias("operand")))

    def run(kinds: Column) -> Column:
        matters = lambda x, i: x["name"] | x["t"].isin(
            "(", ")", ",", "SELECT", "WITH", "FROM", "JOIN", "ON", "USING", *_CLAUSES)
        places = F.filter(F.transform(kinds, lambda x, i: F.when(matters(x, i), i)), lambda i: i.isNotNull())
        return F.aggregate(places, start, lambda s, i: step(kinds, s, i))

    def step(kinds: Column, s: Column, i: Column) -> Column:
        here, previous = F.get(kinds, i), F.get(kinds, i - 1)
        t, before = here["t"], F.coalesce(previous["t"], F.lit(""))
        after = F.coalesce(F.get(kinds, i + 1)["t"], F.lit(""))
        follows_name = F.coalesce(previous["name"], F.lit(False))
        place, stack = s["place"], s["stack"]
        opens, closes = t == "(", t == ")"
        back = F.coalesce(F.element_at(stack, -1), F.lit(_LIST))
        is_from = (t == "FROM") & (place != _CALL) & (before != "DISTINCT")
        whole = here["name"] & (after != ".")
        comma = (t == ",") & place.isin(_JOINED, _ON)
        moved = (
            F.when(whole, F.when(place == _RELATION, _JOINED).otherwise(place))
            .when(opens, F.when(place == _RELATION, _RELATION)
                  .when(place.isin(_JOINED, _NAMES) | (place == _WITH) & (before != "AS"), _NAMES)
                  .when((place != _WITH) & follows_name, _CALL).otherwise(_LIST))
            .when(closes, F.when(back == _RELATION, _JOINED).otherwise(back))
            .when(place == _NAMES, place)
            .when(t == "SELECT", _LIST).when(t == "WITH", _WITH)
            .when(is_from | (t == "JOIN") | comma, _RELATION)
            .when(t.isin("ON", "USING") & (place == _JOINED), _ON)
            .when(t.isin(*_CLAUSES) & place.isin(_RELATION, _JOINED, _ON), _LIST)
            .otherwise(place))
        is_table = whole & (place == _RELATION) & (after != "(")
        alias = (before == "AS") | F.coalesce(previous["operand"], F.lit(False))
        call = F.coalesce(F.get(kinds, i - 2)["t"], F.lit(""))
        unit = (before == "(") & ((call == "extract") | (call == "trim") & t.isin("both", "leading", "trailing"))
        is_column = (whole & place.isin(_LIST, _CALL, _ON) & ~after.isin("(", "?") & ~alias & (before != ":") & ~unit)
        add = lambda names, yes: F.when(yes, F.array_append(names, t)).otherwise(names)
        return F.struct(
            moved.alias("place"),
            F.when(opens, F.array_append(stack, place)).when(
                closes, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack).alias("stack"),
            add(s["tables"], is_table).alias("tables"), add(s["columns"], is_column).alias("columns"),
            (s["listed"] | comma).alias("listed"))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(_LIST).alias("place"), none.alias("stack"), none.alias("tables"), none.alias("columns"),
                     F.lit(False).alias("listed"))
    return bind(told, run)


def tokens_are(tokens: Column, pattern: str) -> Column:
    return F.transform(tokens, lambda t: t.rlike(pattern))


def _bare_names(names: Column) -> Column:
    """Last parts of dotted names without quotes, each once."""
    bare = F.transform(names, lambda n: F.lower(F.substring_index(F.regexp_replace(n, "[`\"]", ""), ".", -1)))
    return F.array_distinct(bare)


CLAUSE_PATTERNS = {
    "GROUP BY": r"\bGROUP BY\b",
    "ORDER BY": r"\bORDER BY\b",
    "LIMIT": r"\bLIMIT\b",
    "WHERE": r"\bWHERE\b",
    "JOIN": r"\bJOIN\b",
    "DISTINCT": r"\bDISTINCT\b(?! FROM\b)",
    "CTE": r"\bWITH\b.* AS \(",
}


def _clause_names(text: Column, listed: Column) -> Column:
    """Clauses of a statement; a list of tables is a join."""
    has = lambda name, p: text.rlike(p) | listed if name == "JOIN" else text.rlike(p)
    return F.array_compact(F.array(*[F.when(has(n, p), F.lit(n)) for n, p in CLAUSE_PATTERNS.items()]))


def _literal_values(canonical: Column, text: Column) -> Column:
    """Text of all string and number literals, without quotes."""
    strings = F.regexp_extract_all(canonical, F.lit(f"({_STRING})"), 1)
    numbers = F.regexp_extract_all(
        text,
        F.lit(r"(?<![\p{L}\p{N}_$.])(\d+(?:\.\d+)?(?:e[+-]?\d+)?)(?![\p{L}\p{N}_])"), 1)
    bare = F.transform(strings, lambda s: F.regexp_replace(s, "['\"]", ""))
    return F.array_distinct(F.concat(bare, numbers))


def sql_features(c: Column) -> Column:
    """Struct of tables, columns, keywords, literals and ``parsable``."""
    def from_texts(t: Column) -> Column:
        return F.struct(
            _bare_names(t["names"]["tables"]).alias("tables"),
            _bare_names(t["names"]["columns"]).alias("columns"),
            _clause_names(t["masked"], t["names"]["listed"]).alias("keywords"),
            _literal_values(t["canonical"], t["masked"]).alias("literals"),
            _looks_parsable(t["masked"]).alias("parsable"),
        )

    def with_names(t: Column) -> Column:
        tokens = F.regexp_extract_all(t["masked"], F.lit(TOKEN_PATTERN), 1)
        return bind(tokens, lambda k: F.struct(
            t["canonical"].alias("canonical"), t["masked"].alias("masked"), _scoped_names(k).alias("names")))

    both = bind(canonical_sql(c), lambda t: F.struct(t.alias("canonical"), masked(t).alias("masked")))
    return bind(bind(both, with_names), from_texts)


def _looks_parsable(text: Column) -> Column:
    """Fallback where no engine verdict is at hand: a SELECT with balanced brackets."""
    opened = F.length(text) - F.length(F.translate(text, "(", ""))
    closed = F.length(text) - F.length(F.translate(text, ")", ""))
    return F.coalesce(text.rlike(r"\A(?:SELECT\b|WITH\b.* AS \()") & (opened == closed)
                      & ~text.contains("'"), F.lit(False))


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) > S.TABLE_RATIO for x, y in zip(a, b)], dtype="bool")


def _may_be_near(a: Column, b: Column) -> Column:
    """Can two names be near? Their ratio is twice the letters they share in order over both lengths, and no more
    than with all letters they have in common (``sim`` of their letter counts)."""
    both = F.length(a) + F.length(b)
    letters = lambda c: F.split(c, "")
    in_common = F.aggregate(F.array_distinct(F.array_intersect(letters(a), letters(b))), F.lit(0), lambda n, x: n + F.least(
        F.size(F.filter(letters(a), lambda y: y == x)), F.size(F.filter(letters(b), lambda y: y == x))))
    limit = F.lit(S.TABLE_RATIO) * both
    return (2 * F.least(F.length(a), F.length(b)) > limit) & (2 * in_common > limit)


def near_names(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Different pairs ``(gold_name, pred_name)`` of near names, over the unmatched names of all rows.

    Equal pairs are one before their letters are compared, so the ratio is worked out once for each pair of names
    that the corpus holds and whose lengths and letters allow it.
    """
    open_names = rows.select(F.array_except(gold, pred).alias("g"), F.col(pred).alias("p"))
    pairs = open_names.select(F.explode("g").alias("gold_name"), "p").select(
        "gold_name", F.explode("p").alias("pred_name")).distinct()
    likely = pairs.where(_may_be_near(F.col("gold_name"), F.col("pred_name")))
    return likely.where(_similar("gold_name", "pred_name"))


def with_table_score(rows: DataFrame, gold: str, pred: str, name: str) -> DataFrame:
    """Add the share of gold tables found: 1 per exact name, fixed credit per near name.

    ``gold`` and ``pred`` are arrays of different names. Rows whose names all match are not compared.
    """
    exact = F.size(F.array_intersect(gold, pred))
    keyed = rows.withColumns({"_open": F.array_except(gold, pred), "_key": F.xxhash64(gold, pred), "_also": F.xxhash64(pred, gold)})
    asked = keyed.where((F.size("_open") > 0) & (F.size(pred) > 0)).dropDuplicates(["_key", "_also"])
    met = asked.select("_key", "_also", F.explode("_open").alias("gold_name"), F.col(pred).alias("_pred")).select(
        "_key", "_also", "gold_name", F.explode("_pred").alias("pred_name"))
    near = met.join(near_names(asked, gold, pred), ["gold_name", "pred_name"]).groupBy("_key", "_also").agg(
        F.count_distinct("gold_name").alias("_near"))
    score = (
        F.when(F.size(gold) == 0, F.lit(1.0))
        .when(F.size(pred) == 0, F.lit(0.0))
        .otherwise((exact + F.coalesce("_near", F.lit(0)) * S.TABLE_RATIO_CREDIT) / F.size(gold)))
    return keyed.join(near, ["_key", "_also"], "left").withColumn(name, score).drop("_open", "_key", "_also", "_near")
