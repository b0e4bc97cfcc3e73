"""Business-analysis patterns over facts.

``facts`` has entity columns, a period column (a date) and numeric measures. Every pattern
first reduces the facts to one row per entity and period, combined before the shuffle;
windows then run over that small series: one partition holds the periods of an entity. The
entities of a period may be any number: their total is an aggregate that is joined back, their
ranks are counted in ranges of values and shifted by the ranges before. Figures of the whole
(means, totals, maxima) are scalar subqueries, never windows over everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.session import materialize

Entity = Sequence[str]


def totals(facts: DataFrame, entity: Entity, period: str, *measures: str) -> DataFrame:
    """One row per entity and period with summed measures."""
    return facts.groupBy(*entity, period).agg(*[F.sum(m).alias(m) for m in measures])


def _series(entity: Entity, period: str):
    return Window.partitionBy(*entity).orderBy(period)


def _change(now: Column, before: Column) -> Column:
    """Relative change, null unless the base is positive."""
    now, before = now.cast("double"), before.cast("double")
    return F.when(before > 0, (now - before) / before)


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _between(c: Column, start: str, end: str) -> Column:
    """``start <= c < end`` on dates."""
    return (c >= F.lit(start).cast("date")) & (c < F.lit(end).cast("date"))


def totals_above(facts: DataFrame, entity: Entity, period: str, measure: str, threshold: float) -> DataFrame:
    return totals(facts, entity, period, measure).filter(F.col(measure) > threshold)


def period_growth(facts: DataFrame, entity: Entity, period: str, measure: str,
                  min_growth: float | None = None) -> DataFrame:
    """Growth over the previous period on record."""
    series = totals(facts, entity, period, measure).withColumn(
        "previous", F.lag(measure).over(_series(entity, period)))
    grown = series.withColumn("growth", _change(F.col(measure), F.col("previous")))
    return grown if min_growth is None else grown.filter(F.col("growth") > min_growth)


def year_on_year(facts: DataFrame, entity: Entity, period: str, measure: str) -> DataFrame:
    """Growth over the same period a year before; joined by date, so gaps do no harm."""
    now = totals(facts, entity, period, measure)
    before = now.select(*entity, F.add_months(period, 12).alias(period), F.col(measure).alias("year_before"))
    return now.join(before, [*entity, period], "left").withColumn(
        "growth", _change(F.col(measure), F.col("year_before")))


def shares(facts: DataFrame, entity: Entity, period: str, measure: str,
           within: Entity = ()) -> DataFrame:
    """Share of each entity in the total of its period (and of ``within``).

    The totals are a row for each period and group, summed from the series before they meet it.
    """
    series = totals(facts, [*within, *entity], period, measure)
    part = [period, *within]
    whole = series.groupBy(*[F.col(c).alias(f"_{c}") for c in part]).agg(F.sum(measure).alias("_whole"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part])
    joined = series.join(whole, same)
    return joined.select(*series.columns, _share(F.col(measure), F.col("_whole")).alias("share"))


def share_gain(facts: DataFrame, entity: Entity, period: str, measure: str, min_points: float) -> DataFrame:
    """Entities whose share rose by more than ``min_points`` percentage points in a year."""
    now = shares(facts, entity, period, measure).select(*entity, period, "share")
    before = now.select(*entity, F.add_months(period, 12).alias(period), F.col("share").alias("share_before"))
    return now.join(before, [*entity, period]).withColumn(
        "points", (F.col("share") - F.col("share_before")) * 100).filter(F.col("points") > min_points)


def top_growth(facts: DataFrame, entity: Entity, period: str, measure: str, n: int) -> DataFrame:
    """The ``n`` fastest-growing entities of each period; ties by entity name."""
    grown = period_growth(facts, entity, period, measure).filter("growth is not null")
    best = Window.partitionBy(period).orderBy(F.desc("growth"), *entity)
    return grown.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def top_share(facts: DataFrame, entity: Entity, period: str, measure: str, n: int) -> DataFrame:
    """Entities with the ``n`` largest shares per period; equal shares share a place."""
    best = Window.partitionBy(period).orderBy(F.desc("share"))
    return shares(facts, entity, period, measure).withColumn(
        "place", F.rank().over(best)).filter(F.col("place") <= n)


def distributed_rank(rows: DataFrame, within: Entity, by: str, name: str) -> DataFrame:
    """Add ``name``: the rank of a row by falling ``by`` among the rows with the same ``within``, ties alike,
    nulls last.

    Rows are dealt to ranges of ``(within, by)``, so equal values share a range. A rank is counted inside the
    range and shifted by the rows of the same group in the ranges before: no task holds a group, only a range.
    """
    order = [*[F.col(c).asc_nulls_first() for c in within], F.col(by).desc_nulls_last()]
    ranged = materialize(
        rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_{c}") for c in within],
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *within).orderBy(F.col(by).desc_nulls_last())
    counted = ranged.withColumn("_place", F.rank().over(inside))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within],
                  F.col("_range") == F.col("_r"))
    return counted.join(starts, same).select(
        *rows.columns, (F.col("_start") + F.col("_place")).cast("int").alias(name))


def rank_moves(facts: DataFrame, entity: Entity, period: str, measure: str) -> DataFrame:
    """Rank per period and its change (positive: moved up)."""
    ranked = distributed_rank(totals(facts, entity, period, measure), [period], measure, "place")
    return ranked.withColumn("move", F.lag("place").over(_series(entity, period)) - F.col("place"))


def rank_summary(facts: DataFrame, entity: Entity, period: str, measure: str,
                 big_move: int = 5, top: int = 3) -> DataFrame:
    """Rank changes, largest rise, number of big moves and 'always in the top' per entity."""
    move = F.col("move")
    return rank_moves(facts, entity, period, measure).groupBy(*entity).agg(
        F.count_if(move != 0).alias("n_changes"),
        F.coalesce(F.max(move), F.lit(0)).alias("largest_rise"),
        F.count_if(F.abs(move) > big_move).alias("n_big_moves"),
        F.bool_and(F.col("place") <= top).alias("always_top"))


def below_overall_growth(facts: DataFrame, entity: Entity, day: str, measure: str,
                         first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Entities that grew less from the first to the second span than all together."""
    spans = [F.sum(F.when(_between(F.col(day), *s), F.col(measure))).alias(n)
             for n, s in (("first_sum", first), ("second_sum", second))]
    needed = facts.filter(_between(F.col(day), *first) | _between(F.col(day), *second))
    local = needed.groupBy(*entity).agg(*spans).withColumn(
        "growth", _change(F.col("second_sum"), F.col("first_sum")))
    overall = needed.agg(*spans).select(_change(F.col("second_sum"), F.col("first_sum")))
    return local.withColumn("overall_growth", overall.scalar()).filter("growth < overall_growth")


def price_bands(facts: DataFrame, price: str, bounds: Sequence[float], qty: str, amount: str) -> DataFrame:
    """Volume and quantity-weighted average price per price band."""
    band = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        band = F.when(F.col(price) < bounds[i], F.lit(i)).otherwise(band)
    sums = facts.groupBy(band.alias("band")).agg(F.sum(qty).alias(qty), F.sum(amount).alias(amount))
    return sums.withColumn("avg_price", _share(F.col(amount), F.col(qty)))


def average_price(facts: DataFrame, entity: Entity, period: str, qty: str, amount: str) -> DataFrame:
    return totals(facts, entity, period, qty, amount).withColumn(
        "avg_price", _share(F.col(amount), F.col(qty)))


def price_against_first(facts: DataFrame, entity: Entity, period: str, qty: str, amount: str,
                        min_rise: float) -> DataFrame:
    """Periods whose average price is more than ``min_rise`` above the first period's."""
    priced = average_price(facts, entity, period, qty, amount)
    base = F.first_value("avg_price").over(_series(entity, period))
    return priced.withColumn("base_price", base).withColumn(
        "rise", F.try_divide(F.col("avg_price") - F.col("base_price"), F.col("base_price"))
    ).filter(F.col("rise") > min_rise)


def dearer_yet_larger(facts: DataFrame, entity: Entity, category: Entity, period: str, qty: str,
                      amount: str) -> DataFrame:
    """Entities that outsell a cheaper rival of their category.

    There is such a rival exactly if the smallest volume among cheaper entities is below the
    own volume, so a running minimum along the price is enough; no pairs are formed.
    """
    priced = average_price(facts, [*category, *entity], period, qty, amount).withColumnRenamed(
        "avg_price", "price")
    group = [*category, period]
    steps = priced.groupBy(*group, "price").agg(F.min(qty).alias("least"))
    cheaper = Window.partitionBy(*group).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    floor = steps.withColumn("least_cheaper", F.min("least").over(cheaper)).drop("least")
    return priced.join(floor, [*group, "price"]).filter(F.col(qty) > F.col("least_cheaper"))


def cut_without_gain(facts: DataFrame, entity: Entity, period: str, qty: str, amount: str) -> DataFrame:
    """Periods in which the average price fell and the volume did not rise."""
    along = _series(entity, period)
    priced = average_price(facts, entity, period, qty, amount).withColumns({
        "price_before": F.lag("avg_price").over(along), "qty_before": F.lag(qty).over(along)})
    return priced.filter((F.col("avg_price") < F.col("price_before")) & (F.col(qty) <= F.col("qty_before")))


def volatility(facts: DataFrame, entity: Entity, period: str, measure: str, min_ratio: float = 0.0,
               sample: bool = True) -> DataFrame:
    """Spread of the period totals: range, low/high ratio, deviation over mean."""
    v = F.col(measure).cast("double")
    deviation = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return totals(facts, entity, period, measure).groupBy(*entity).agg(
        (F.max(v) - F.min(v)).alias("spread"), F.try_divide(F.min(v), F.max(v)).alias("low_high"),
        F.try_divide(deviation, F.avg(v)).alias("variation"),
    ).filter(F.col("variation") > min_ratio)


def first_reaching(facts: DataFrame, entity: Entity, period: str, measure: str, threshold: float) -> DataFrame:
    """First period at or above a threshold, per entity."""
    hits = totals(facts, entity, period, measure).filter(F.col(measure) >= threshold)
    return hits.groupBy(*entity).agg(F.min(period).alias(period), F.min_by(measure, period).alias(measure))


def first_above_earlier_best(facts: DataFrame, entity: Entity, period: str, measure: str,
                             earlier: tuple[str, str], later: tuple[str, str]) -> DataFrame:
    """First period of the later span above the best period of the earlier one."""
    series = totals(facts.filter(_between(F.col(period), earlier[0], later[1])), entity, period, measure)
    best = F.max(F.when(_between(F.col(period), *earlier), F.col(measure))).over(Window.partitionBy(*entity))
    hits = series.withColumn("earlier_best", best).filter(
        _between(F.col(period), *later) & (F.col(measure) > F.col("earlier_best")))
    return hits.groupBy(*entity).agg(
        F.min(period).alias(period), F.min_by(measure, period).alias(measure),
        F.first("earlier_best").alias("earlier_best"))


def growth_runs(facts: DataFrame, entity: Entity, period: str, measure: str, min_length: int) -> DataFrame:
    """Runs of at least ``min_length`` growing periods in a row and the first fall behind."""
    along = _series(entity, period)
    series = totals(facts, entity, period, measure)
    up = F.coalesce(F.col(measure) > F.lag(measure).over(along), F.lit(False))
    marked = series.withColumn("up", up).withColumn("next_period", F.lead(period).over(along))
    numbered = marked.withColumn("run", F.sum(F.when(~F.col("up"), 1).otherwise(0)).over(along))
    runs = numbered.filter("up").groupBy(*entity, "run").agg(
        F.count("*").alias("n_periods"), F.min(period).alias("run_start"), F.max(period).alias("run_end"),
        F.max_by("next_period", period).alias("first_fall"))
    return runs.filter(F.col("n_periods") >= min_length).drop("run")


def count_above_earlier_mean(facts: DataFrame, entity: Entity, period: str, measure: str,
                             earlier: tuple[str, str], later: tuple[str, str]) -> DataFrame:
    """Number of later periods above the mean of the earlier ones, per entity."""
    series = totals(facts.filter(_between(F.col(period), earlier[0], later[1])), entity, period, measure)
    v = F.col(measure).cast("double")
    mean = F.avg(F.when(_between(F.col(period), *earlier), v)).over(Window.partitionBy(*entity))
    return series.withColumn("earlier_mean", mean).groupBy(*entity).agg(
        F.first("earlier_mean").alias("earlier_mean"),
        F.count_if(_between(F.col(period), *later) & (v > F.col("earlier_mean"))).alias("n_above"))


def coverage(facts: DataFrame, entity: Entity, period: str, place: str, places: DataFrame) -> DataFrame:
    """Share of all places active per period and its growth over the period before."""
    active = facts.select(*entity, period, place).distinct().groupBy(*entity, period).agg(
        F.count("*").alias("n_active"))
    ratio = _share(F.col("n_active"), places.agg(F.count("*")).scalar())
    along = _series(entity, period)
    return active.withColumn("coverage", ratio).withColumn(
        "growth", _change(F.col("coverage"), F.lag("coverage").over(along)))


def fastest_coverage_gain(facts: DataFrame, entity: Entity, period: str, place: str,
                          places: DataFrame) -> DataFrame:
    """Per entity the period with the largest coverage growth; earliest on a tie."""
    best = Window.partitionBy(*entity).orderBy(F.desc_nulls_last("growth"), period)
    covered = coverage(facts, entity, period, place, places).filter("growth is not null")
    return covered.withColumn("place_no", F.row_number().over(best)).filter("place_no = 1").drop("place_no")


def share_high_and_rising(facts: DataFrame, entity: Entity, group: Entity, day: str, measure: str,
                          before: tuple[str, str], now: tuple[str, str], min_share: float) -> DataFrame:
    """Entities holding more than ``min_share`` of their group now, and more than before."""
    needed = facts.filter(_between(F.col(day), *before) | _between(F.col(day), *now))
    spans = {"before": before, "now": now}
    sums = needed.groupBy(*group, *entity).agg(*[
        F.sum(F.when(_between(F.col(day), *s), F.col(measure)).otherwise(F.lit(0))).alias(n)
        for n, s in spans.items()])
    whole = Window.partitionBy(*group)
    out = sums.withColumns({f"share_{n}": _share(F.col(n), F.nullif(F.sum(n).over(whole), F.lit(0)))
                            for n in spans})
    return out.filter((F.col("share_now") > min_share) & (F.col("share_now") > F.col("share_before")))


def double_growth(facts: DataFrame, entity: Entity, period: str, qty: str, amount: str) -> DataFrame:
    """Second of two periods in a row in which volume and average price both grew."""
    along = _series(entity, period)
    priced = average_price(facts, entity, period, qty, amount)
    both = (F.col(qty) > F.lag(qty).over(along)) & (F.col("avg_price") > F.lag("avg_price").over(along))
    marked = priced.withColumn("both", F.coalesce(both, F.lit(False)))
    return marked.withColumn("twice", F.col("both") & F.lag("both", 1, False).over(along)).filter("twice").drop(
        "both", "twice")


def distinct_share_above_mean(facts: DataFrame, group: Entity, ident: str, condition: Column,
                              min_count: int) -> DataFrame:
    """Groups whose share of distinct members meeting a condition exceeds the mean share.

    Members are made distinct first, so a large group is counted by many tasks.
    """
    members = facts.groupBy(*group, ident).agg(F.max(condition.cast("int")).alias("hit"))
    counted = members.groupBy(*group).agg(
        F.sum("hit").alias("n_hit"), F.count("*").alias("n_members")).filter(F.col("n_hit") >= min_count)
    with_share = counted.withColumn("share", F.col("n_hit") / F.col("n_members"))
    mean = with_share.agg(F.avg("share")).scalar()
    return with_share.withColumn("mean_share", mean).withColumn(
        "diff", F.col("share") - F.col("mean_share")).filter("diff > 0")


def local_mean_above_overall(facts: DataFrame, unit: Entity, tier: Entity, entity: Entity,
                             measure: Column) -> DataFrame:
    """Mean over units by (tier, entity) against the mean over all units by entity."""
    per_unit = facts.groupBy(*tier, *entity, *unit).agg(F.sum(measure).cast("double").alias("unit_total"))
    sums = [F.sum("unit_total").alias("s"), F.count("*").alias("n")]
    local = per_unit.groupBy(*tier, *entity).agg(*sums)
    overall = local.groupBy(*entity).agg((F.sum("s") / F.sum("n")).alias("overall_mean"))
    return local.withColumn("local_mean", F.col("s") / F.col("n")).join(overall, list(entity)).withColumn(
        "diff", F.col("local_mean") - F.col("overall_mean")).filter("diff > 0").drop("s", "n")


def trailing_days(facts: DataFrame, day: str, as_of: str, n_days: int) -> DataFrame:
    """Facts of the ``n_days`` days before ``as_of``; that day itself is not included."""
    today = F.lit(as_of).cast("date")
    d = F.col(day)
    return facts.filter((d >= F.date_sub(today, n_days)) & (d < today))


def best_and_worst(facts: DataFrame, entity: Entity, period: str, measure: str) -> DataFrame:
    """Best and worst period of each entity, with all ties and one fixed pick among them."""
    v = F.col(measure)
    high = Window.partitionBy(*entity).orderBy(v.desc())
    low = Window.partitionBy(*entity).orderBy(v.asc())
    placed = totals(facts, entity, period, measure).withColumns({
        "from_top": F.rank().over(high), "from_bottom": F.rank().over(low),
        "pick_top": F.row_number().over(high.orderBy(v.desc(), period)),
        "pick_bottom": F.row_number().over(low.orderBy(v.asc(), period))})
    best = placed.filter("from_top = 1").select(
        *entity, F.lit("best").alias("kind"), period, measure, (F.col("pick_top") == 1).alias("picked"))
    worst = placed.filter("from_bottom = 1").select(
        *entity, F.lit("worst").alias("kind"), period, measure, (F.col("pick_bottom") == 1).alias("picked"))
    return best.unionByName(worst)
