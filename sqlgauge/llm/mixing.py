"""Mixing sources to target weights by a time-varying curriculum (DataFrame expressions only).

Every source has a weight that changes over the training time 0 to 1. Integrated, it says how many of the
source's words have been asked for at each time. The words of a source stand in a fixed order (by a hash of
``doc_id`` and text), repeated as often as needed; a document's training position is the time at which the demand
reaches its first word: the integral inverted. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm.common import WORD, materialize, table

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: How the weights change over the training time, likewise: factor at the start and at the end, 2 in sum,
#: so that the integral over the whole time is the weight.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: No source is taken more often than this.
MOST_REPEATS = 3
#: Documents in a bucket of a source's order, on average, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256


def measured(docs: DataFrame) -> DataFrame:
    """``_doc`` (the row), ``_id``, ``_source``, ``_size`` in words (null text: 0) and ``_order``."""
    return docs.select(
        F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64("doc_id", "text").alias("_order"))


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def _targets(sizes: DataFrame, weights, ramps, most: float) -> DataFrame:
    """Target of each source: one level times its weight, at most ``most`` times its size, all sizes in sum.

    One row per source; the order of names and the level need sources, not documents, in one window.
    """
    by_name, whole = Window.orderBy(F.col("_source").asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    s = s.select("_source", "source_size", _cycle(weights, F.col("_rank")).alias("_w"),
                 _cycle([a for a, _ in ramps], F.col("_rank")).alias("_a"),
                 _cycle([b for _, b in ramps], F.col("_rank")).alias("_b"),
                 F.sum("source_size").over(whole).cast("double").alias("_all"),
                 (F.col("source_size") * float(most)).alias("_cap"))
    # in the order in which a rising level meets the caps, the sum at the level that meets this one
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(1, Window.unboundedFollowing)
    at = F.sum("_cap").over(before) + F.col("_cap") / F.col("_w") * F.coalesce(F.sum("_w").over(after), F.lit(0.0))
    s = s.withColumn("_full", at <= F.col("_all"))
    rest = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0.0))
    level = rest / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(level * F.col("_w"), F.col("_cap")))
    return s.select("_source", "source_size", "_a", "_b", target.alias("target"))


def curriculum(rows: DataFrame, n_rows: int, weights=WEIGHTS, ramps=RAMPS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows of ``measured`` with ``size, source_size, target, taken`` and ``occurrences``, an array of
    (``position`` 0 to 1, ``words`` taken) for each time that the document is used.

    Words are taken whole: ``taken`` sums to the rounded target of the source, so the last document used may
    be taken in part. Null sources are one source, the last in order; documents without words are never taken.
    The order is a hash of ``doc_id`` and text, so rows without ``doc_id`` are spread too, and only rows that are
    alike in both can change places. Prefix sums are made in buckets of a source's order, then
    over the buckets, so a source may hold any share of the rows.
    """
    buckets = max(LEAST_BUCKETS, n_rows // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    parts = materialize(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-buckets")
    targets = _targets(parts.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, ramps, most)
    in_order = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(in_order), F.lit(0))).drop("_sum")
    t = targets.withColumnRenamed("_source", "_ts")
    starts = starts.join(t, F.col("_source").eqNullSafe(F.col("_ts"))).drop("_ts")
    starts = starts.withColumnsRenamed({"_source": "_ss", "_bucket": "_sb"})
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_in", F.sum("_size").over(inside) - F.col("_size"))
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_ss")) & (F.col("_bucket") == F.col("_sb")))
    goal = F.round("target").cast("long")

    def use(k: int) -> Column:
        start = F.col("_before") + F.col("_in") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), goal - start))
        asked = F.least(start / F.col("target"), F.lit(1.0))
        # the time at which the integral of the ramp reaches this share of the target
        time = 2 * asked / (F.col("_a") + F.sqrt(F.col("_a") ** 2 + 2 * (F.col("_b") - F.col("_a")) * asked))
        return F.struct(F.when(words > 0, time).alias("position"), words.cast("long").alias("words"))

    uses = F.filter(F.array(*[use(k) for k in range(most)]), lambda u: u["words"] > 0)
    rows = rows.withColumn("occurrences", uses)
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    return rows.select("_doc", "_id", F.col("_size").alias("size"), "source_size", "target",
                       taken.alias("taken"), "occurrences", "_order")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: columns of ``docs``, a row for each use, range-sorted by training position.

    A use of a whole document has its text as it is; the one that a source's target cuts has its first words.
    """
    mix = curriculum(measured(docs), docs.count(), **options)
    uses = mix.select("_doc", "size", F.explode("occurrences").alias("_use"))
    words = F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1)),
                    F.lit(1), F.col("_use.words").cast("int"))
    text = F.when(F.col("_use.words") == F.col("size"), F.col("_doc.text")).otherwise(F.array_join(words, ""))
    uses = uses.withColumn("_doc", F.col("_doc").withField("text", text))
    ranged = uses.repartitionByRange("_use.position").sortWithinPartitions("_use.position")
    return ranged.select("_doc.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(measured(docs).drop("_doc").withColumn("_doc", F.lit(None).cast("string")), "mix-sizes")
    mix = curriculum(rows, rows.count())
    mix = mix.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken",
                     F.try_element_at("occurrences", F.lit(1))["position"].alias("position"), "_order")
    # documents that are not taken have no position: they come last, by identifier, in ranges like the others
    by = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("_order")]
    return mix.repartitionByRange(*by).sortWithinPartitions(*by).drop("_order")
