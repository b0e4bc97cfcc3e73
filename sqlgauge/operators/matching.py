"""First-fit matching of two unordered collections under a tolerance, per key.

Items of the left side are taken in order of position; each takes the free item of the
right side with the lowest position that is close enough. The result depends on the order,
so in general it has to be played through. The work is cut down first:

* Items only match inside one ``block`` (their exact part), and numbers that are close lie
  in the same or in neighbouring cells of a logarithmic grid. Counting items per occupied
  cell and joining neighbouring cells to runs gives independent components. A key has at
  most about 1.5 million occupied cells per block, whatever its number of items, so no
  window ever sees an unbounded group.
* A component that lacks one side, or in which everything is close to everything, is decided
  by its two counts.
* Only the remaining components are played through: small ones as a fold inside Spark, middle
  ones in one bounded Arrow group, larger ones in distributed rounds. All three are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.session import materialize

FOLD_LIMIT = 256
GROUP_LIMIT = 200_000


@dataclass(frozen=True)
class Closeness:
    """A tolerance: relative part, absolute part, the test and a test for whole ranges."""

    rel: float
    tol: float
    near: Callable[[Column, Column], Column]
    all_near: Callable[[Column, Column], Column]
    near_np: Callable[[float, np.ndarray], np.ndarray]

    def cell(self, v: Column) -> Column:
        """Grid cell; the cells of two close numbers differ by at most one."""
        knee, width = self.tol / self.rel, -math.log(1 - self.rel)
        far = F.signum(v) * (1 / self.rel + F.log(F.abs(v) / knee) / width)
        steps = F.when(F.abs(v) <= knee, v / self.tol).otherwise(far) * (1 - self.rel)
        return F.coalesce(F.floor(steps), F.lit(0)).cast("bigint")


def _cell_near(x: Column, y: Column) -> Column:
    bound = F.greatest(F.lit(S.CELL_REL_TOL) * F.greatest(F.abs(x), F.abs(y)), F.lit(S.CELL_ABS_TOL))
    return (x == y) | (F.abs(x - y) <= bound)


def _cell_near_np(x: float, y: np.ndarray) -> np.ndarray:
    bound = np.maximum(S.CELL_REL_TOL * np.maximum(abs(x), np.abs(y)), S.CELL_ABS_TOL)
    return (x == y) | (np.abs(x - y) <= bound)


def _value_near(pred: Column, gold: Column) -> Column:
    return F.when(gold == 0, F.abs(pred - gold) < S.VALUE_ZERO_TOL).otherwise(
        F.abs(pred - gold) / F.abs(gold) < S.VALUE_REL_TOL)


def _value_near_np(pred: float, gold: np.ndarray) -> np.ndarray:
    gap = np.abs(pred - gold)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(gold == 0, gap < S.VALUE_ZERO_TOL, gap / np.abs(gold) < S.VALUE_REL_TOL)


def _value_all_near(low: Column, high: Column) -> Column:
    floor = F.least(F.abs(low), F.abs(high))
    return (low == high) | ((low * high > 0) & (high - low < S.VALUE_REL_TOL * floor))


CELL_CLOSENESS = Closeness(S.CELL_REL_TOL, S.CELL_ABS_TOL, _cell_near, _cell_near, _cell_near_np)
VALUE_CLOSENESS = Closeness(S.VALUE_REL_TOL, S.VALUE_ZERO_TOL, _value_near, _value_all_near,
                            _value_near_np)


def first_fit_hits(items: DataFrame, keys: Sequence[str], closeness: Closeness, dims: int | None,
                   fold_limit: int = FOLD_LIMIT, group_limit: int = GROUP_LIMIT,
                   complete: bool = False) -> DataFrame:
    """``(keys, n_left, n_right, hits)``: items per side and left items that find a partner.

    ``items`` has the keys, ``side`` ('left' or 'right'), ``pos`` (order within the side),
    ``block`` (exact part, text) and ``vec`` (numbers, at most ``dims`` of them, counted if not given). An item
    that can match nothing has a null block.

    ``complete``: the caller only asks which keys match item for item. A component with unequal sides leaves
    an item over, so its key is settled and not played through: its hits are a lower bound, below its items.
    """
    keys = list(keys)
    stored = materialize(items.withColumnRenamed("block", "grp"), "first-fit")
    if dims is None:
        dims = stored.agg(F.max(F.size("vec"))).first()[0] or 0
    counts = stored.groupBy(*keys).agg(F.count_if(F.col("side") == "left").alias("n_left"),
                                       F.count_if(F.col("side") == "right").alias("n_right"))
    solved, todo = [], stored.filter("grp is not null")
    for dim in range(max(dims, 1)):
        marked = materialize(_mark_components(todo, keys, closeness, dim, max(dims, 1)), "components")
        solved.append(marked.filter("decided and cell = run").select(
            *keys, F.least("n_left", "n_right").alias("hits")))
        left = _undecided(todo, marked, keys, closeness, dim)
        if complete:
            uneven = marked.filter("cell = run and n_left <> n_right").select(*keys).distinct()
            left = left.join(uneven, keys, "left_anti")
        todo = materialize(left, "first-fit")
        largest = todo.agg(F.max("n_items")).first()[0] or 0
        if largest <= fold_limit:  # nothing left, or small enough without further splitting
            break
    n = F.col("n_items")
    if largest:
        solved.append(_fold(todo.filter(n <= fold_limit), keys, closeness))
    if largest > fold_limit:
        solved.append(_arrow_groups(todo.filter(n.between(fold_limit + 1, group_limit)), keys, closeness))
    if largest > group_limit:
        solved.extend(_rounds(todo.filter(n > group_limit), keys, closeness))
    hits = reduce(DataFrame.unionByName, solved).groupBy(*keys).agg(F.sum("hits").alias("hits"))
    return counts.join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def _mark_components(todo: DataFrame, keys: list[str], closeness: Closeness, dim: int,
                     dims: int) -> DataFrame:
    """Occupied cells along one number with their component: its first cell (``run``), its
    counts, and whether these decide it."""
    part = [*keys, "grp"]
    number = lambda d: F.get("vec", F.lit(d))
    cells = todo.groupBy(*part, closeness.cell(number(dim)).alias("cell")).agg(
        F.count_if(F.col("side") == "left").alias("n_left"),
        F.count_if(F.col("side") == "right").alias("n_right"),
        *[F.min(number(d)).alias(f"lo{d}") for d in range(dims)],
        *[F.max(number(d)).alias(f"hi{d}") for d in range(dims)],
    )
    along = Window.partitionBy(*part).orderBy("cell")
    starts = F.coalesce(F.col("cell") - F.lag("cell").over(along) > 1, F.lit(True))
    runs = cells.withColumn("start", F.when(starts, F.col("cell"))).withColumn(
        "run", F.last("start", ignorenulls=True).over(along))
    whole = Window.partitionBy(*part, "run")
    tight = reduce(lambda a, b: a & b, [
        F.coalesce(closeness.all_near(F.min(f"lo{d}").over(whole), F.max(f"hi{d}").over(whole)), F.lit(True))
        for d in range(dims)])
    marked = runs.withColumns({
        "tight": tight, "n_left": F.sum("n_left").over(whole), "n_right": F.sum("n_right").over(whole)})
    one_sided = (F.col("n_left") == 0) | (F.col("n_right") == 0)
    return marked.select(*part, "cell", "run", "n_left", "n_right",
                         (one_sided | F.col("tight")).alias("decided"))


def _undecided(todo: DataFrame, marked: DataFrame, keys: list[str], closeness: Closeness,
               dim: int) -> DataFrame:
    """Items of the components that their counts do not decide, grouped by component."""
    part = [*keys, "grp"]
    cells = marked.filter("not decided").select(
        *part, "cell", "run", (F.col("n_left") + F.col("n_right")).alias("n_items"))
    here = todo.select(*part, "side", "pos", "vec", closeness.cell(F.get("vec", F.lit(dim))).alias("cell"))
    return here.join(cells, [*part, "cell"]).select(
        *keys, "side", "pos", "vec", "n_items",
        F.concat_ws("/", "grp", F.col("run").cast("string")).alias("grp"))


def _vectors_near(closeness: Closeness, left: Column, right: Column) -> Column:
    return F.forall(F.zip_with(left, right, closeness.near), lambda ok: ok)


def _fold(rows: DataFrame, keys: list[str], closeness: Closeness) -> DataFrame:
    """Play small components through inside Spark: take the first close item off the list."""
    item = F.struct("pos", "vec")
    lists = rows.groupBy(*keys, "grp").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "left", item))).alias("lefts"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "right", item))).alias("rights"),
    )

    def take(state: Column, left: Column) -> Column:
        free = state["free"]
        near = F.transform(free, lambda r: _vectors_near(closeness, left["vec"], r["vec"]))
        at = F.array_position(near, True).cast("int")

        def drop(i: Column) -> Column:
            shorter = F.concat(F.slice(free, F.lit(1), i - 1), F.slice(free, i + 1, F.size(free)))
            return F.struct(F.when(i > 0, shorter).otherwise(free).alias("free"),
                            (state["hits"] + (i > 0).cast("bigint")).alias("hits"))

        return F.transform(F.array(at), drop)[0]

    start = F.struct(F.col("rights").alias("free"), F.lit(0).cast("bigint").alias("hits"))
    return lists.select(*keys, F.aggregate("lefts", start, take)["hits"].alias("hits"))


def _arrow_groups(rows: DataFrame, keys: list[str], closeness: Closeness) -> DataFrame:
    """Play components of bounded size through on sorted arrays."""
    near, rel, tol = closeness.near_np, closeness.rel, closeness.tol
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in rows.select(*keys).schema) + ", hits bigint"

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        lefts = np.stack(pdf.loc[pdf["side"] == "left", "vec"].to_list())
        rights = np.stack(pdf.loc[pdf["side"] == "right", "vec"].to_list())
        order = np.argsort(rights[:, 0], kind="stable")
        sorted_first, free, hits = rights[order, 0], np.ones(len(rights), dtype=bool), 0
        reach = np.maximum(rel * np.abs(lefts[:, 0]) / (1 - rel), tol) * (1 + 1e-9)
        begins = np.searchsorted(sorted_first, lefts[:, 0] - reach, "left")
        ends = np.searchsorted(sorted_first, lefts[:, 0] + reach, "right")
        for vec, begin, end in zip(lefts, begins, ends):
            among = order[begin:end]
            among = among[free[among]]
            for d in range(lefts.shape[1]):
                among = among[near(vec[d], rights[among, d])]
            if len(among):
                free[among.min()] = False
                hits += 1
        return pdf[keys].iloc[:1].assign(hits=hits)

    return rows.groupBy(*keys, "grp").applyInPandas(play, schema)


def _rounds(rows: DataFrame, keys: list[str], closeness: Closeness) -> list[DataFrame]:
    """Play components of any size through in rounds.

    A pair is final as soon as each is the first free candidate of the other; taking such
    pairs away and repeating ends in the same matching as going item by item.
    """
    part = [*keys, "grp"]
    free = rows.withColumn("cell", closeness.cell(F.get("vec", F.lit(0))))
    hits = []
    while True:
        around = F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)]))
        left = free.filter(F.col("side") == "left").select(
            *part, F.col("pos").alias("left_pos"), F.col("vec").alias("left_vec"), around.alias("cell"))
        right = free.filter(F.col("side") == "right").select(
            *part, F.col("pos").alias("right_pos"), F.col("vec").alias("right_vec"), "cell")
        pairs = left.join(right, [*part, "cell"]).filter(
            _vectors_near(closeness, F.col("left_vec"), F.col("right_vec")))
        by_left = pairs.groupBy(*part, "left_pos").agg(F.min("right_pos").alias("right_pos"))
        by_right = pairs.groupBy(*part, "right_pos").agg(F.min("left_pos").alias("left_pos"))
        taken = materialize(by_left.join(by_right, [*part, "left_pos", "right_pos"]), "taken")
        if taken.isEmpty():
            return hits
        hits.append(taken.groupBy(*keys).agg(F.count("*").alias("hits")))
        gone = taken.select(*part, F.lit("left").alias("side"), F.col("left_pos").alias("pos")).unionByName(
            taken.select(*part, F.lit("right").alias("side"), F.col("right_pos").alias("pos")))
        free = materialize(free.join(gone, [*part, "side", "pos"], "left_anti"), "free")
