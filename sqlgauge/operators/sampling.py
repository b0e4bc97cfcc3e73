"""Skip finished work, draw rows reproducibly, swap metric names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.text import bind, hash_bucket, prompt_key

INDEX_BUCKETS = 1024
#: Keys that picks from a pool are spread over at least; a smaller pool is copied under salts.
PICK_KEYS = 4096


def not_yet_done(todo: DataFrame, done: DataFrame, key: str = "query",
                 done_key: str = "original_prompt") -> DataFrame:
    """Rows whose prompt is not among the finished ones. Joins on hashes, null equals null."""
    text = lambda c: F.coalesce(prompt_key(F.col(c)), F.lit("null"))
    finished = done.select(text(done_key).alias("_done")).distinct()
    return todo.join(finished, text(key) == F.col("_done"), "left_anti")


def dense_index(df: DataFrame, key: str, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Add ``row_index`` 0..n-1 in an order that depends on the key only.

    Rows are numbered inside hash buckets and shifted by the sizes of the buckets before, so
    no task sees more than one bucket; ``key`` must be unique.
    """
    key_text = F.col(key).cast("string")
    spread = df.withColumn("_bucket", hash_bucket(key_text, buckets))
    inside = Window.partitionBy("_bucket").orderBy(key)
    sizes = spread.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        spread.withColumn("_i", F.row_number().over(inside)).join(starts, "_bucket")
        .withColumn("row_index", F.col("_start") + F.col("_i") - 1)
        .drop("_bucket", "_i", "_start")
    )


def draw_with_replacement(seeds: DataFrame, key: str, n_wanted: int, n_present: int) -> DataFrame:
    """Exactly the missing number of draws, each a reproducible pick of one seed row."""
    missing = max(n_wanted - n_present, 0)
    indexed = dense_index(seeds, key)
    n = seeds.count()
    if n == 0 or missing == 0:
        return indexed.drop("row_index").withColumn("draw_no", F.lit(0).cast("bigint")).limit(0)
    draws = seeds.sparkSession.range(missing).select(
        F.col("id").alias("draw_no"),
        hash_bucket(F.col("id").cast("string"), n).alias("row_index"))
    return draws.join(indexed, "row_index").drop("row_index")


def attach_example(rows: DataFrame, key: Column, pool: DataFrame, pool_key: str) -> DataFrame:
    """One reproducible pick from ``pool`` for every row, by an equi-join on its index.

    In a small pool an index is picked by a large share of the rows. Such a pool is copied under salts until
    there are ``PICK_KEYS`` keys, so at most twice as many rows are copied and a key has its share of the picks.
    Whether the pool is small enough to be broadcast is left to the sizes that are measured when it runs.
    """
    n = pool.count()
    if n == 0:
        raise ValueError("the example pool is empty")
    copies = -(-PICK_KEYS // n)
    salted = F.concat(key, F.lit("/salt"))
    picked = rows.withColumns({"row_index": hash_bucket(key, n), "_salt": hash_bucket(salted, copies)})
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))
    offered = dense_index(pool, pool_key).withColumn("_salt", salts)
    return picked.join(offered, ["row_index", "_salt"]).drop("row_index", "_salt")


def fault_for(key: Column) -> Column:
    """One reproducible fault type per row, as a struct of category, name, instruction."""
    faults = F.array(*[
        F.struct(F.lit(f.category).alias("category"), F.lit(f.name).alias("name"),
                 F.lit(f.instruction).alias("instruction")) for f in S.FAULT_TYPES])
    return F.get(faults, hash_bucket(key, len(S.FAULT_TYPES)).cast("int"))


def swap_metric(question: Column, key: Column, metrics: Sequence[str]) -> Column:
    """Replace the first known metric name by a different one: struct of question, metric.

    Longer names win over names they contain. Null when no name is found or nothing changes.
    ``metrics`` is the metric dictionary, a configuration list.
    """
    ordered = sorted(metrics, key=lambda m: (-len(m), m))
    names = F.array(*[F.lit(m) for m in ordered])
    pattern = "(" + "|".join("\\Q" + m + "\\E" for m in ordered) + ")"
    step = hash_bucket(key, len(ordered) - 1) + 1

    def other(hit: Column) -> Column:
        metric = F.get(names, ((F.array_position(names, hit) - 1 + step) % len(ordered)).cast("int"))
        return F.when(hit != "", F.struct(hit.alias("hit"), F.instr(question, hit).alias("at"), metric.alias("metric")))

    def swapped(o: Column) -> Column:
        text = F.concat(F.substr(question, F.lit(1), o["at"] - 1), o["metric"],
                        F.substr(question, o["at"] + F.length(o["hit"])))
        return F.struct(text.alias("question"), o["metric"].alias("metric"))

    none = F.lit(None).cast("string")
    return bind(bind(bind(F.regexp_extract(question, pattern, 1), other), swapped), lambda s: F.struct(
        F.when(s["question"] != question, s["question"]).otherwise(none).alias("question"),
        F.when(s["question"] != question, s["metric"]).otherwise(none).alias("metric")))
