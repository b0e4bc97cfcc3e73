"""Exact search for the greatest inner products by norm-bucketed retrieval.

Vectors are range-sorted by length, longest first, and cut into buckets of ``BUCKET`` rows; queries into blocks
of ``BLOCK`` rows. Rounds take buckets in order of length, four times as many each time. A query that has ``k``
results wants more than the worst of them, so against a bucket it has a local cosine threshold: that result over
its length and the length of the bucket's longest vector. Blocks meet only buckets in which some query's threshold
is at most 1. There each query chooses, by exact counts, the cheaper of

* length pruning: the bucket's rows long enough to reach the result, a prefix of the bucket;
* coordinate pruning: the rows whose largest coordinates of the query lie where the threshold allows them.

What is left is verified by its product. Components are integers, so products are exact.

A block and a bucket are all that a task holds, whatever the table's size; nothing is broadcast, results travel as
``k`` rows for a query and bucket. Where lengths are alike and thresholds low nothing can be pruned: then every
block of queries meets every bucket, once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sqlgauge.llm.common import materialize, table

BUCKET = 8_192
BLOCK = 2_048
#: Rows of a range of the sort; a range is cut into buckets.
RANGE = 16 * BUCKET
#: Each round takes so many times as many buckets as the one before.
GROWTH = 4
#: Copies of a bucket's summary, so that blocks of queries meet it in several tasks.
SALTS = 16

#: Coordinates of the query that prune a bucket.
FOCUS = 3
#: Pairs of a query and a row, and products, that a task looks at once.
PAIRS, PRODUCTS = 1 << 18, 1 << 22
#: Below this bound sums of products of integers are exact as floating-point numbers.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Bounds are floating-point numbers: what they prune is short of the threshold by more than their error.
SLACK = 1e-9

_FOUND = "q bigint, query_id string, r bigint, vec_id string, score bigint"


def finite(vector: Column) -> Column:
    """True where a vector is neither null nor holds a component that is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """Components as integers: the floor of ``factor`` times each, kept as doubles."""
    # from 2^52 on a double is an integer already, and a floor would end at the limits of a long
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    return F.transform(vector, lambda x: whole(F.lit(float(factor)) * x))


def by_length(vectors: DataFrame, factor: int, bucket: int, span: int) -> DataFrame:
    """Usable vectors as ``r, vec_id, e, dim, norm, place``: longest first in each dimension, and their place."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e")).where(finite(F.col("e")))
    rows = rows.select("vec_id", scaled(F.col("e"), factor).alias("e")).where(finite(F.col("e")))
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.select("vec_id", "e", F.size("e").alias("dim"), F.sqrt(square).alias("norm"))
    n = rows.count()
    order = [F.col("dim"), F.col("norm").desc(), F.col("vec_id"), F.xxhash64("e")]
    placed = materialize(
        rows.repartitionByRange(max(1, -(-n // span)), *order).sortWithinPartitions(*order)
        .withColumn("r", F.monotonically_increasing_id()), "by-length")
    part, nth = F.shiftright("r", 33), F.floor(F.col("r").bitwiseAND((1 << 33) - 1) / bucket)
    # places rise as lengths fall: the part, counted from the dimension's first, and the bucket in it
    most = (placed.agg(F.max(nth)).first()[0] or 0) + 1
    first = placed.groupBy("dim").agg(F.min(part).alias("first"))
    return placed.join(first, "dim").withColumn("place", (part - F.col("first")) * most + nth).drop("first")


# --- in a task -------------------------------------------------------------------------------

def _products(q: np.ndarray, c: np.ndarray, pairs: bool = False) -> np.ndarray:
    """Exact products of all rows of ``q`` and ``c``, or of their rows one by one; cut to longs."""
    most = max(np.abs(q).max(initial=0.0), 1.0) * max(np.abs(c).max(initial=0.0), 1.0) * max(q.shape[1], 1)
    if most < EXACT:
        return np.einsum("ij,ij->i", q, c) if pairs else q @ c.T
    q, c = (np.frompyfunc(int, 1, 1)(x) for x in (q, c))  # integers without bound
    long = lambda x: max(-LONG, min(LONG, x))
    return np.frompyfunc(long, 1, 1)((q * c).sum(axis=1) if pairs else q @ c.T).astype(np.int64)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["e"].tolist(), float).reshape(len(frame), int(frame["dim"].iloc[0]))


def _range(x, t):
    """Where a coordinate of a unit vector lies whose cosine with a query is at least ``t`` (above 0), if the
    query's own coordinate is ``x``.

    The vector's angle to the axis is the query's, more or less by at most the angle whose cosine is t. The root
    of a small error is not small, hence what is added.
    """
    reach = np.sqrt(np.maximum((1 - x * x) * (1 - t * t), 0)) + 1e-6
    return np.where(x <= -t, -2.0, x * t - reach), np.where(x >= t, 2.0, x * t + reach)


class _Bucket:
    """A bucket's rows, longest first, with the orders by coordinate that queries ask for."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("r", ignore_index=True)
        self.r = frame["r"].to_numpy(np.int64)
        self.ids = frame["vec_id"].to_numpy(object)
        self.norm = frame["norm"].to_numpy(float)
        self.e = _matrix(frame)
        self.unit = self.e / np.where(self.norm > 0, self.norm, 1)[:, None]
        # how early a row comes among equal scores: smaller identifier first, none last
        none = frame["vec_id"].isna().to_numpy()
        number = np.array([0 if x is None else int(x) for x in self.ids], np.int64)
        self.rank = np.empty(len(frame), np.int64)
        self.rank[np.lexsort((self.r, number, none))] = np.arange(len(frame))
        self._orders: dict[int, np.ndarray] = {}

    def order(self, f: int) -> np.ndarray:
        if f not in self._orders:
            self._orders[f] = np.argsort(self.unit[:, f], kind="stable")
        return self._orders[f]


def _candidates(q, norm, worst, bucket):
    """For each query: its way to prune (-1: by length) and where the rows to verify lie in that order."""
    n = len(bucket.r)
    low, high, way = np.zeros(len(q), np.int64), np.full(len(q), n), np.full(len(q), -1)
    known = ~np.isnan(worst) & (norm > 0)
    need = np.where(known, worst, 0) / np.where(norm > 0, norm, 1)
    long_enough = np.searchsorted(-bucket.norm, -(need - np.abs(need) * SLACK - SLACK), "right")
    high[known] = long_enough[known]
    top = bucket.norm[0] if n else 0.0
    t = need / top if top > 0 else np.zeros(len(q))
    steep = np.flatnonzero(known & (t > 0) & (t <= 1 + SLACK) & (high > 0))
    unit = q / np.where(norm > 0, norm, 1)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    for f in range(q.shape[1]) if len(steep) else ():
        mine = steep[(focus[steep] == f).any(axis=1)]
        if not len(mine):
            continue
        values = bucket.unit[bucket.order(f), f]
        a, b = _range(unit[mine, f], np.minimum(t[mine], 1))
        a, b = np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")
        fewer = b - a < high[mine] - low[mine]
        mine, a, b = mine[fewer], a[fewer], b[fewer]
        low[mine], high[mine], way[mine] = a, np.maximum(a, b), f
    return low, high, way, unit, focus, t


def _best(i, j, score, bucket, k):
    """Of verified pairs (query ``i``, row ``j``) the ``k`` best of each query."""
    order = np.lexsort((bucket.rank[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[nth < k], j[nth < k], score[nth < k]


def _best_of_all(mine, score, allowed, bucket, k):
    """The same for a matrix of products; equal scores, however many, are decided in one step."""
    n = score.shape[1]
    if n <= k or float(np.abs(score).max(initial=0)) * len(bucket.r) >= float(1 << 62):
        i, j = np.nonzero(allowed)
        return _best(mine[i], j, score[i, j], bucket, k)
    none = np.iinfo(np.int64).min
    key = np.where(allowed, score.astype(np.int64) * len(bucket.r) + (len(bucket.r) - 1 - bucket.rank[:n]), none)
    j = np.argpartition(key, n - k, axis=1)[:, n - k:]
    i = np.repeat(np.arange(len(mine)), k)
    j = j.ravel()
    some = key[i, j] > none
    return _best(mine[i[some]], j[some], score[i[some], j[some]], bucket, k)


def _search(queries: pd.DataFrame, frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a bucket for each query of a block, less those that cannot enter its results."""
    empty = pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in _FOUND.split(", ")})
    if queries.empty or frame.empty:
        return empty
    bucket, q = _Bucket(frame), _matrix(queries)
    norm, worst = queries["norm"].to_numpy(float), queries["worst"].to_numpy(float)
    own = queries["r"].to_numpy(np.int64)
    low, high, way, unit, focus, t = _candidates(q, norm, worst, bucket)
    out = []

    by_length = np.flatnonzero((way < 0) & (high > 0))
    step = max(1, PRODUCTS // len(bucket.r))
    for start in range(0, len(by_length), step):
        mine = by_length[start:start + step]
        n = int(high[mine].max())
        allowed = (np.arange(n)[None, :] < high[mine][:, None]) & (bucket.r[:n][None, :] != own[mine][:, None])
        out.append(_best_of_all(mine, _products(q[mine], bucket.e[:n]), allowed, bucket, k))

    for f in np.unique(way[way >= 0]):
        group = np.flatnonzero((way == f) & (high > low))
        order, sizes = bucket.order(f), (high - low)[group]
        for part in np.split(group, np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, sizes.sum(), PAIRS))):
            sizes = (high - low)[part]
            i = np.repeat(part, sizes)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[part], sizes)]
            keep = bucket.r[j] != own[i]
            for c in range(focus.shape[1]):
                least, most = _range(unit[i, focus[i, c]], np.minimum(t[i], 1))
                value = bucket.unit[j, focus[i, c]]
                keep &= (value >= least) & (value <= most)
            i, j = i[keep], j[keep]
            if len(i):
                out.append(_best(i, j, _products(q[i], bucket.e[j], True), bucket, k))
    if not out:
        return empty
    i, j, score = (np.concatenate(x) for x in zip(*out))
    enters = np.isnan(worst[i]) | (score >= worst[i] - np.abs(worst[i]) * SLACK)
    i, j, score = i[enters], j[enters], score[enters]
    return pd.DataFrame({"q": own[i], "query_id": queries["vec_id"].to_numpy(object)[i], "r": bucket.r[j],
                         "vec_id": bucket.ids[j], "score": score.astype(np.int64)})


# --- rounds ----------------------------------------------------------------------------------

def _kept(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vec_id").cast("bigint").asc_nulls_last(), F.col("r")]
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, bucket: int = BUCKET,
                 block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of greatest inner product for each query.

    ``vectors``: ``vec_id, embedding``; ``is_query`` is a condition on ``vec_id``. Components become
    ``floor(factor x)``. A query's own row is no result, another row with its identifier or vector is. Ties go
    to the smaller ``vec_id`` (null last, then any row: they look the same). Vectors that are null or hold null
    or non-finite components take no part; vectors of different length are not compared; empty ones have
    product 0. Scores beyond plus or minus the greatest long count as that, and are ties. A
    query without any other row has no result; an empty table gives an empty one. Other columns are not read.
    """
    rows = by_length(vectors.select("vec_id", "embedding"), factor, bucket, span)
    buckets = materialize(rows.groupBy("dim", "place").agg(F.max("norm").alias("longest")), "buckets")
    last = buckets.agg(F.max("place")).first()[0]
    asked = rows.where(is_query).select("r", "vec_id", "e", "dim", "norm")
    n = asked.count()
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("r"), F.lit(max(1, -(-n // block))))), "queries")

    found = materialize(asked.sparkSession.createDataFrame([], _FOUND + ", rank int"), "found")
    low, width = 0, 1
    while n and last is not None and low <= last:
        high = low + width
        now = buckets.where((F.col("place") >= low) & (F.col("place") < high))
        worst = found.where(F.col("rank") == k).select(F.col("q").alias("r"), F.col("score").cast("double").alias("worst"))
        ready = asked.join(worst, "r", "left")
        # a block wants a bucket if the longest row could enter the results of one of its queries
        want = F.when(F.col("worst").isNull() | (F.col("norm") == 0), F.lit(float("-inf"))).otherwise(
            F.col("worst") / F.col("norm"))
        blocks = ready.groupBy("dim", "block").agg(F.min(want).alias("want")).withColumn(
            "salt", F.pmod("block", F.lit(SALTS)))
        met = now.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(blocks, ["dim", "salt"]).where(
            F.col("longest") >= F.col("want") - F.abs("want") * SLACK - SLACK)
        met = materialize(met.select("dim", "place", "block"), "met")
        left = ready.join(met, ["dim", "block"]).withColumn("vec_id", F.col("vec_id").cast("string"))
        right = rows.join(met, ["dim", "place"]).withColumn("vec_id", F.col("vec_id").cast("string"))
        keys = ["dim", "place", "block"]
        new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            lambda a, b: _search(a, b, k), _FOUND)
        found = materialize(_kept(found.drop("rank").unionByName(new), k), "found")
        low, width = high, width * GROWTH
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("vec_id").cast("bigint").alias("vec_id"), "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""
