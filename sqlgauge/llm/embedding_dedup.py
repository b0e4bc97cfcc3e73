"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. First neighbour lists come from orders of the nodes along random directions; then
rounds of neighbours-of-neighbours joins improve them: nodes that share a neighbour are compared with each
other, and lists keep the nearest. Planes and orders follow the number of nodes, so that a pair at the threshold
meets with a set probability in the first lists alone. Recall is audited against brute force over as many nodes
as it takes to see enough links. The rounds go on until the lists settle. While recall is short, more orders are
tried, twice as many each time, and lists are lengthened; if it stays short, the job fails. Links are the pairs found at the threshold or
above, in double precision. A list that is full of links is saturated: it may have cut some off, to nodes that
are saturated too. Saturated nodes therefore look for neighbours outside their component, in lists of their own,
and components are joined by the links found until there are no more. The lists of a component with such a node
are then enlarged to the whole component, which is compared with itself tile by tile; only counts leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm.common import attach_spread, materialize, table, with_place
from sqlgauge.llm.components import components

THRESHOLD = 0.95
#: Length of a neighbour list, least orders for the first lists, neighbours to each side in an order.
LIST, ORDERS, REACH = 8, 8, 8
#: Part of the pairs at the threshold that are to stand in one side of an order, and most orders made at once.
MET, MOST_ORDERS = 0.99, 64
#: Rounds at most, least recall, nodes that the audit compares with all at first, true links it wants to see,
#: comparisons it may make for them.
ROUNDS, RECALL, AUDITED, AUDIT_LINKS, AUDIT_PAIRS = 12, 0.99, 400, 400, 4e9
#: Share of list places that may still change in the last round, and share of links that may be new.
STILL, STILL_LINKS = 0.05, 0.002
#: Times that orders are added when recall is short.
ATTEMPTS = 5
#: Nodes in a tile.
TILE = 512
#: Nodes kept at both ends of a stretch of one component in an order, where only other components are looked for.
ENDS = 2
SEED = 42


def _matrix(raw) -> np.ndarray:
    """Unit vectors in double precision from the bytes of single ones."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if len(raw) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``vec_id, _key, _part`` (``_key`` null where the vector can have no link), and the nodes: one row
    ``u, raw, copies`` for each different vector, ``u`` being a number made for it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = []
            for v in b["v"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], "<f8")
                if x is not None and len(x) and np.isfinite(x).all() and x.any():
                    # scaled so that no square overflows, -0.0 made 0.0
                    raws.append((x / np.abs(x).max() + 0.0).tobytes())
                else:
                    raws.append(None)
            yield pd.DataFrame({"vec_id": b["vec_id"], "raw": raws})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).mapInPandas(run, f"vec_id {kind}, raw binary")
    rows = rows.withColumn("_key", F.sha2("raw", 256))
    rows = materialize(with_place(rows).drop("_rid"), "vectors")
    groups = rows.where("_key IS NOT NULL").groupBy("_key").agg(
        F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    return rows, materialize(groups.withColumn("u", F.monotonically_increasing_id()), "vector-nodes")


def _edges(u, v, s) -> pd.DataFrame:
    return pd.DataFrame({"u": np.asarray(u, np.int64), "v": np.asarray(v, np.int64), "s": np.asarray(s, float)})


_EDGES = "u long, v long, s double"


def orders_for(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes, so many that a side holds about as many nodes as an order reaches, and orders, so many that a
    pair at the threshold is on one side in one of them with probability ``MET``."""
    planes = int(np.clip(np.ceil(np.log2(max(n, 1) / (2 * REACH))), 0, 40))
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** planes
    return planes, int(np.clip(np.ceil(np.log(1 - MET) / np.log1p(-together)) if together < 1 else 1, ORDERS, MOST_ORDERS))


def first_lists(points: DataFrame, width: int, planes: int, orders: int, seed: int = SEED) -> DataFrame:
    """Candidates from orders: nodes sorted by the sides of random hyperplanes they lie on, and by a random
    direction within, are compared with the next ones that have another ``c``; each keeps the best ``width``."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for width_now in sorted({len(r) for r in b["raw"]}):
                mine = b[b["raw"].map(len) == width_now]
                x, rng = _matrix(mine["raw"].tolist()), np.random.default_rng(seed)
                for t in range(orders):
                    across, line = rng.standard_normal((x.shape[1], planes)), rng.standard_normal(x.shape[1])
                    side = (x @ across > 0) @ (1 << np.arange(planes, dtype=np.int64))
                    yield pd.DataFrame({"t": t * 65536 + width_now // 8 % 65536, "side": side, "at": x @ line,
                                        "u": mine["u"].to_numpy(), "c": mine["c"].to_numpy(), "raw": mine["raw"].to_numpy()})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            # of a long stretch of one component only the ends: what lies beyond comes into reach
            new = np.r_[True, b["c"].to_numpy()[1:] != b["c"].to_numpy()[:-1]][:len(b)]
            begin = np.flatnonzero(new)
            many = np.diff(np.r_[begin, len(b)])
            k = np.arange(len(b)) - np.repeat(begin, many)
            b = b[(k < ENDS) | (k >= np.repeat(many, many) - ENDS)]
            sizes = b["raw"].map(len)
            for w in sorted(set(sizes)):
                mine = b[sizes == w]
                x, u, c = _matrix(mine["raw"].tolist()), mine["u"].to_numpy(), mine["c"].to_numpy()
                n = len(u)
                sims = np.full((n, 2 * REACH), -2.0)
                who = np.zeros((n, 2 * REACH), np.int64)
                for k in range(1, min(REACH, n - 1) + 1):
                    s = np.where(c[:-k] != c[k:], (x[:-k] * x[k:]).sum(axis=1), -2.0)
                    sims[:-k, k - 1], who[:-k, k - 1] = s, u[k:]
                    sims[k:, REACH + k - 1], who[k:, REACH + k - 1] = s, u[:-k]
                best = np.argsort(-sims, axis=1)[:, :width]
                s, v = np.take_along_axis(sims, best, 1).ravel(), np.take_along_axis(who, best, 1).ravel()
                us = np.repeat(u, width)
                ok = (s > -2.0) & (us != v)
                yield _edges(us[ok], v[ok], s[ok])
            rest = b.tail(REACH)

    kept = points.select("u", "c", "raw").mapInPandas(keyed, "t int, side long, at double, u long, c long, raw binary")
    # neighbours are not met over the end of a range; ranges that are no divisor of the orders end elsewhere in each
    ranges = orders * (int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) // orders + 1) + 3
    return kept.repartitionByRange(ranges, "t", "side", "at").sortWithinPartitions("t", "side", "at").mapInPandas(near, _EDGES)


def _best(edges: DataFrame, length: int) -> DataFrame:
    """The nearest ``length`` of each node; an edge that was there before stays old."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    nearest = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
    return one.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= length).drop("r")


def _round(lists: DataFrame, points: DataFrame, length: int, around: DataFrame | None = None) -> DataFrame:
    """Candidates among the neighbours of each node: pairs with different ``c`` of which one edge is new and that
    would enter a list. Neighbours in ``around`` are met with the others, but it gets no candidates.

    Reverse neighbours count too, as many as a list has, chosen by hash.
    """
    far = lists.groupBy("u").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n"))
    far = far.select("u", F.when(F.col("n") < length, F.lit(-2.0)).otherwise(F.col("least")).alias("least"))
    if around is not None:
        lists = lists.unionByName(around.withColumn("new", F.lit(False)))
    back = lists.select(F.col("v").alias("w"), F.col("u").alias("a"), "new")
    pick = Window.partitionBy("w").orderBy(F.xxhash64("a", "w"))
    back = back.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= length).drop("r")
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("a"), "new").union(back)
    around = around.groupBy("w", "a").agg(F.max("new").alias("new"))
    known = points.join(far, "u", "left").select(F.col("u").alias("a"), "c", "raw", F.coalesce("least", F.lit(-2.0)).alias("least"))
    met = around.join(known, "a").repartition("w").sortWithinPartitions("w")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b["w"].iloc[-1] if len(b) else None
            rest = b[b["w"] == last]
            yield compare(b[b["w"] != last])
        if rest is not None:
            yield compare(rest)

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        out_u, out_v, out_s = [], [], []
        w, a = b["w"].to_numpy(), b["a"].to_numpy()
        new, least, c = b["new"].to_numpy(), b["least"].to_numpy(), b["c"].to_numpy()
        raws = b["raw"].tolist()
        bounds = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True]) if len(w) else [0]
        for i, j in zip(bounds, bounds[1:]):
            if j - i < 2 or len({len(r) for r in raws[i:j]}) > 1:
                continue
            x = _matrix(raws[i:j])
            s = x @ x.T
            ok = (new[i:j, None] | new[None, i:j]) & (s > least[i:j, None]) & (c[i:j, None] != c[None, i:j])
            p, q = np.nonzero(ok)
            out_u.append(a[i:j][p])
            out_v.append(a[i:j][q])
            out_s.append(s[p, q])
        none = [np.zeros(0)]
        return _edges(np.concatenate(out_u or none), np.concatenate(out_v or none), np.concatenate(out_s or none))

    return met.mapInPandas(local, _EDGES)


def _links_of(asked: list, points: DataFrame, threshold: float) -> DataFrame:
    """All links of the nodes ``asked``, by brute force."""
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["raw"]) for r in asked}:
        mine = [r for r in asked if len(r["raw"]) == size]
        queries[size] = (np.array([r["u"] for r in mine]), _matrix([bytes(r["raw"]) for r in mine]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["raw"].map(len)
            for size in set(sizes) & set(queries):
                mine, (who, q) = b[sizes == size], queries[size]
                x, u = _matrix(mine["raw"].tolist()), mine["u"].to_numpy()
                for k in range(0, len(u), 512):
                    s = q @ x[k:k + 512].T
                    i, j = np.nonzero(s >= threshold)
                    v = u[k:k + 512][j]
                    yield _edges(who[i][who[i] != v], v[who[i] != v], s[i, j][who[i] != v])

    return materialize(points.select("u", "raw").mapInPandas(run, _EDGES).select("u", "v"), "audit")


def true_links(points: DataFrame, threshold: float, audited: int) -> tuple[DataFrame, int]:
    """Links found by brute force for the recall audit, and their number: those of ``audited`` nodes, and of more,
    up to a number of comparisons, while they have fewer than ``AUDIT_LINKS``. The nodes are chosen by hash."""
    n = points.count()
    most = max(audited, int(min(AUDIT_PAIRS / max(n, 1), 20_000)))
    while True:
        asked = points.orderBy(F.xxhash64("u"), "u").limit(audited).select("u", "raw").collect()
        truth = _links_of(asked, points, threshold)
        found = truth.count()
        if found >= AUDIT_LINKS or audited >= min(most, n):
            return truth, found
        audited = min(most, 8 * audited)


def _saturated(lists: DataFrame, threshold: float, length: int) -> DataFrame:
    return lists.where(F.col("s") >= threshold).groupBy("u").count().where(F.col("count") >= length).select("u")


def _grouped(points: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes with the component ``c`` that ``links`` give them."""
    met = components(links, "u", "v").select(F.col("node").alias("u"), F.col("component").alias("c"))
    return materialize(points.drop("c").join(met, "u", "left").withColumn("c", F.coalesce("c", "u")), "vector-components")


def joined_components(lists: DataFrame, points: DataFrame, threshold: float, length: int, seed: int = SEED) -> DataFrame:
    """The nodes with their component ``c``.

    A link that no list holds has two saturated ends. Those nodes get lists of the nearest nodes of other
    components, improved in rounds; components that a link joins become one, and the search begins anew.
    """
    links = materialize(lists.where(F.col("s") >= threshold).select("u", "v"), "vector-links")
    full = materialize(_saturated(lists, threshold, length), "saturated")
    known = _grouped(points, links)
    while True:
        crowded = materialize(known.join(full, "u", "left_semi"), "saturated-nodes")
        if crowded.select("c").distinct().limit(2).count() < 2:
            return known
        n_places, more = crowded.count() * length, None
        first = first_lists(crowded, length, *orders_for(n_places // length, threshold), seed)
        apart = materialize(_best(first.withColumn("new", F.lit(True)), length), "apart")
        for _ in range(ROUNDS):
            more = apart.where(F.col("s") >= threshold).select("u", "v")
            if more.limit(1).count():
                break
            more = None
            fresh = _round(apart, crowded, length, lists).withColumn("new", F.lit(True))
            apart = materialize(_best(apart.withColumn("new", F.lit(False)).unionByName(fresh), length), "apart")
            if apart.where("new").count() <= STILL * n_places and not apart.where(F.col("s") >= threshold).limit(1).count():
                break
        if more is None:
            more = apart.where(F.col("s") >= threshold).select("u", "v")
            if not more.limit(1).count():
                return known
        links = materialize(links.union(more), "vector-links")
        known = _grouped(points, links)


def neighbour_graph(points: DataFrame, threshold: float = THRESHOLD, length: int = LIST,
                    audited: int = AUDITED) -> tuple[DataFrame, DataFrame, int, float]:
    """Neighbour lists ``u, v, s`` of all nodes, the nodes with their component ``c``, the length of the lists, and
    the audited recall of links (1 where the audit has seen none)."""
    alone, n = points.withColumn("c", F.col("u")), points.count()
    planes, orders = orders_for(n, threshold)
    truth, n_true = true_links(points, threshold, audited)
    lists, recall = None, 0.0
    for attempt in range(ATTEMPTS):
        seed = SEED + attempt
        fresh = first_lists(alone, length, planes, min(orders << attempt, MOST_ORDERS << attempt), seed).withColumn("new", F.lit(True))
        fresh = fresh if lists is None else lists.withColumn("new", F.lit(False)).unionByName(fresh)
        lists = materialize(_best(fresh, length), "knn")
        lists = _settled(lists, alone, threshold, length, max(n * length, 1))
        known = joined_components(lists, points, threshold, length, seed)
        recall = _recall(lists, truth, threshold, length, known) if n_true else 1.0
        if recall >= RECALL:
            return lists, known, length, recall
        length += LIST
    raise RuntimeError(f"recall of links stays at {recall:.4f} of {n_true} audited ones, {RECALL} are asked for")


def _settled(lists: DataFrame, points: DataFrame, threshold: float, length: int, n_places: int) -> DataFrame:
    """The lists after rounds until few places change and few links are new."""
    for _ in range(ROUNDS):
        fresh = _round(lists, points, length).withColumn("new", F.lit(True))
        lists = materialize(_best(lists.withColumn("new", F.lit(False)).unionByName(fresh), length), "knn")
        new, linked = F.col("new"), F.col("s") >= threshold
        changed, found, links = lists.agg(F.count_if(new), F.count_if(new & linked), F.count_if(linked)).first()
        if changed <= STILL * n_places and found <= STILL_LINKS * links:
            break
    return lists


def _recall(lists: DataFrame, truth: DataFrame, threshold: float, length: int, known: DataFrame) -> float:
    """Share of true links that are in a list of either end, or whose ends have saturated lists and are in one
    component of ``known``: such lists are enlarged, and compared with the whole component."""
    links = lists.where(F.col("s") >= threshold)
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    full = known.join(_saturated(lists, threshold, length), "u", "left_semi").select("u", "c")
    found = truth.join(both.withColumn("f", F.lit(1)), ["u", "v"], "left")
    found = found.join(full.withColumnRenamed("c", "x"), "u", "left")
    found = found.join(full.select(F.col("u").alias("v"), F.col("c").alias("y")), "v", "left")
    ok = F.col("f").isNotNull() | F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return found.agg(F.avg(ok.cast("double"))).first()[0]


def _tile_counts(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``u, near``: rows (copies) linked with each member of a component, counted tile by tile."""
    sizes = members.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    cut = members.join(sizes, "c").withColumn("t", F.pmod(F.xxhash64("u"), F.col("tiles")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    left = cut.select("c", F.col("t").alias("i"), others.alias("j"), "u", "raw")
    right = cut.select(F.col("c").alias("rc"), others.alias("ri"), F.col("t").alias("rj"), F.col("u").alias("v"),
                       F.col("raw").alias("other"), F.col("copies").alias("n"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            same = a["u"].to_numpy()[:, None] == b["v"].to_numpy()[None, :]
            s = _matrix(a["raw"].tolist()) @ _matrix(b["other"].tolist()).T
            near = ((s >= threshold) & ~same) @ b["n"].to_numpy(np.int64)
        return pd.DataFrame({"u": a["u"], "near": near})

    tiles = left.groupBy("c", "i", "j").cogroup(right.groupBy("rc", "ri", "rj")).applyInPandas(count, "u long, near long")
    return tiles.groupBy("u").agg(F.sum("near").alias("near"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, length: int = LIST, tile: int = TILE) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold a null or non-finite number have no link; their component is
    their own ``vec_id``. Vectors of different length have none with each other. Repeated vectors are linked to
    each other. Fails where the audited recall of links stays short. An empty table stays empty; other columns are not read.
    """
    rows, points = nodes(vectors)
    lists, known, length, _ = neighbour_graph(points, threshold, length)
    links = lists.where(F.col("s") >= threshold).select("u", "v")
    both = links.union(links.select("v", "u")).distinct()
    crowded = _saturated(lists, threshold, length).join(known, "u").select("c").distinct()
    tiled = _tile_counts(known.join(crowded, "c", "left_semi").select("c", "u", "raw", "copies"), threshold, tile)
    listed = both.join(known.join(crowded, "c", "left_anti").select(F.col("u")), "u")
    listed = listed.join(known.select(F.col("u").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("near"))
    near = tiled.union(listed)
    firsts = known.groupBy("c").agg(F.min("first").alias("component_id"))
    answer = known.join(firsts, "c").join(near, "u", "left").select(
        "_key", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = attach_spread(rows, materialize(answer, "vector-answers"), ["_key"])
    own: Column = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
                      F.col("vec_id").eqNullSafe(own).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
