"""Compare query result sets.

Result rows are held as ``(case_id, side, row_no, cells)`` with ``side`` 'gold' or 'pred' and
``cells`` an array of ``(col, val)`` sorted by column name, values as text. A row is one
record, so comparing needs no shuffle to put rows together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sqlgauge import settings as S
from sqlgauge.functions.scores import NUMBER_PATTERN, cells_close, f1_score, numeric
from sqlgauge.functions.text import strip
from sqlgauge.session import materialize
from sqlgauge.operators.matching import CELL_CLOSENESS, VALUE_CLOSENESS, first_fit_hits


def cells_of(*columns: str) -> Column:
    """Cells of a result row from named columns."""
    return F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val"))
                     for c in sorted(columns)])


def to_result_rows(df: DataFrame, case_id: Column, side: str) -> DataFrame:
    """Any query result as result rows in its own order; repeated names get a position."""
    names = [c if df.columns.count(c) == 1 else f"{c}#{i}" for i, c in enumerate(df.columns)]
    cells = [F.struct(F.lit(n).alias("col"), F.col(f"`{n}`").cast("string").alias("val"))
             for n in sorted(names)]
    return df.toDF(*names).select(
        case_id.alias("case_id"), F.lit(side).alias("side"),
        F.monotonically_increasing_id().alias("row_no"), F.array(*cells).alias("cells"))


def row_text(cells: Column) -> Column:
    """Canonical text of a row: a null reads 'None'."""
    return F.to_json(F.transform(cells, lambda c: F.struct(
        c["col"].alias("col"), F.coalesce(c["val"], F.lit("None")).alias("val"))))


def row_key(cells: Column) -> Column:
    return F.sha2(row_text(cells), 256)


def _is(side: str) -> Column:
    return F.col("side") == side


def strict_equality(rows: DataFrame) -> DataFrame:
    """``(case_id, n_gold, n_pred, strict_equal)``: equality as multisets of canonical rows."""
    per_row = rows.groupBy("case_id", row_key(F.col("cells")).alias("row_key")).agg(
        F.count_if(_is("gold")).alias("g"), F.count_if(_is("pred")).alias("p"))
    return per_row.groupBy("case_id").agg(
        F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"),
        F.bool_and(F.col("g") == F.col("p")).alias("strict_equal"))


def only_in_gold(rows: DataFrame) -> DataFrame:
    """Multiset difference per case: number of surplus gold rows and the first of them."""
    per_row = rows.groupBy("case_id", row_text(F.col("cells")).alias("row")).agg(
        F.count_if(_is("gold")).alias("g"), F.count_if(_is("pred")).alias("p"),
        F.min(F.when(_is("gold"), F.col("row_no"))).alias("first_row"))
    surplus = per_row.filter(F.col("g") > F.col("p"))
    return surplus.groupBy("case_id").agg(
        F.sum(F.col("g") - F.col("p")).alias("n_only_gold"),
        F.min_by("row", "first_row").alias("sample_row"))


def rows_close(gold: Column, pred: Column) -> Column:
    """Same column names and every cell close."""
    names = lambda cells: F.transform(cells, lambda c: c["col"])
    pairs = F.zip_with(gold, pred, lambda a, b: cells_close(a["val"], b["val"]))
    return (names(gold) == names(pred)) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def _fuzzy_items(rows: DataFrame) -> DataFrame:
    """Split rows into exact part and numbers."""
    is_number = lambda c: F.coalesce(c["val"].rlike(NUMBER_PATTERN), F.lit(False))
    exact = F.transform(F.col("cells"), lambda c: F.struct(
        c["col"].alias("col"), is_number(c).alias("num"),
        F.when(~is_number(c), c["val"]).alias("val")))
    numbers = F.transform(F.filter("cells", is_number), lambda c: numeric(c["val"]))
    return rows.select(
        "case_id", F.when(_is("gold"), "left").otherwise("right").alias("side"),
        F.col("row_no").alias("pos"),
        F.sha2(F.to_json(exact), 256).alias("block"), numbers.alias("vec"))


def fuzzy_matches(rows: DataFrame, dims: int | None = None, **limits: int | bool) -> DataFrame:
    """``(case_id, n_matched)``: gold rows that first-fit matching pairs with a close row.

    ``dims`` is the largest number of numeric cells in a row, counted if not given. With ``complete`` only
    cases in which all rows match are counted in full; others show less than their rows.
    """
    hits = first_fit_hits(_fuzzy_items(rows), ["case_id"], CELL_CLOSENESS, dims, **limits)
    return hits.select("case_id", F.col("hits").alias("n_matched"))


def staged_verdict(pairs: DataFrame, outcomes: DataFrame, rows: DataFrame,
                   dims: int | None = None) -> DataFrame:
    """Verdict and deciding stage per case; cheap tests first, later ones on what is left.

    ``pairs``: case_id, gold_sql, pred_sql. ``outcomes``: case_id, gold_ok, pred_ok (null:
    the run gave no result). ``rows``: result rows. Equal texts are never compared by rows;
    only cases with equally many rows that differ strictly are matched with tolerance.
    """
    same_text = F.col("gold_sql") == F.col("pred_sql")
    runs = pairs.join(outcomes, "case_id", "left").select(
        "case_id", F.coalesce(same_text, F.lit(False)).alias("same_text"), "gold_ok", "pred_ok")
    ran = runs.filter(~F.col("same_text") & F.col("gold_ok") & F.col("pred_ok"))
    todo = rows.join(ran.select("case_id"), "case_id", "left_semi")
    strict = materialize(strict_equality(todo), "strict")
    undecided = strict.filter(~F.col("strict_equal") & (F.col("n_gold") == F.col("n_pred")))
    # undecided cases are among those that ran
    matched = fuzzy_matches(rows.join(undecided.select("case_id"), "case_id", "left_semi"), dims, complete=True)
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_gold, n_pred = count("n_gold"), count("n_pred")
    stage = (
        F.when(F.col("same_text"), "same_text")
        .when(~F.col("gold_ok"), "gold_failed")
        .when(~F.col("pred_ok"), "pred_failed")
        .when(F.col("gold_ok").isNull() | F.col("pred_ok").isNull(), "no_result")
        .when((n_gold == 0) & (n_pred == 0), "both_empty")
        .when(F.col("strict_equal"), "strict")
        .when((n_gold == n_pred) & (count("n_matched") == n_gold), "fuzzy")
        .when(n_gold != n_pred, "row_count_mismatch")
        .otherwise("value_mismatch")
    )
    return (
        runs.join(strict, "case_id", "left").join(matched, "case_id", "left")
        .select("case_id", n_gold.alias("n_gold"), n_pred.alias("n_pred"), stage.alias("stage"))
        .withColumn("verdict", F.col("stage").isin("same_text", "both_empty", "strict", "fuzzy"))
    )


def result_preview(rows: DataFrame, n: int = S.PREVIEW_ROWS) -> DataFrame:
    """``(case_id, side, n_rows, preview)``: row count and the first rows as JSON lines."""
    first = Window.partitionBy("case_id", "side").orderBy("row_no")
    head = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    row_map = F.map_from_arrays(F.transform("cells", lambda c: c["col"]),
                                F.transform("cells", lambda c: c["val"]))
    lines = head.groupBy("case_id", "side").agg(
        F.array_sort(F.collect_list(F.struct("row_no", F.to_json(row_map).alias("line")))).alias("ls"))
    counts = rows.groupBy("case_id", "side").agg(F.count("*").alias("n_rows"))
    text = F.concat(
        F.lit("rows: "), F.col("n_rows").cast("string"), F.lit("\n"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
        F.when(F.col("n_rows") > n, F.lit("\n(more rows not shown)")).otherwise(F.lit("")))
    return counts.join(lines, ["case_id", "side"]).select(
        "case_id", "side", "n_rows", text.alias("preview"))


EMPTY_PREVIEW = "rows: 0"


def value_scores(rows: DataFrame, mapping: DataFrame, n_gold_cols: DataFrame, **limits: int) -> DataFrame:
    """``(case_id, value_score)``: mean over gold columns of the F1 of matched values.

    ``mapping``: case_id, true_col, pred_col. ``n_gold_cols``: case_id, n_gold_cols; gold
    columns without a partner count 0.
    """
    cells = rows.select("case_id", "side", "row_no", F.inline("cells").alias("col", "val"))
    val = strip(F.coalesce(F.col("val"), F.lit("None")))
    sides = [("gold", "true_col", "right"), ("pred", "pred_col", "left")]
    mapped = [
        cells.filter(_is(side)).withColumnRenamed("col", name).join(mapping, ["case_id", name])
        .select("case_id", "true_col", F.lit(role).alias("side"), F.col("row_no").alias("pos"),
                val.alias("val"))
        for side, name, role in sides
    ]
    values = reduce(DataFrame.unionByName, mapped)
    number = numeric(F.col("val"))
    # texts meet equal texts only, numbers only numbers; an empty text is a text
    kind = F.when(number.isNull(), F.concat(F.lit("t:"), F.col("val"))).otherwise(F.lit("n"))
    block = F.when(F.col("val") != "NaN", kind)
    items = values.select(
        "case_id", "true_col", "side", "pos", block.alias("block"),
        F.when(number.isNull(), F.array().cast("array<double>")).otherwise(F.array(number)).alias("vec"))
    hits = first_fit_hits(items, ["case_id", "true_col"], VALUE_CLOSENESS, 1, **limits)
    f1 = f1_score(F.col("hits"), F.col("n_left"), F.col("n_right"))
    per_case = hits.groupBy("case_id").agg(F.sum(f1).alias("f1_sum"))
    return n_gold_cols.join(per_case, "case_id", "left").select(
        "case_id",
        F.coalesce(F.try_divide("f1_sum", "n_gold_cols"), F.lit(0.0)).alias("value_score"))
