"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints are reduced to distinct ones. Bits that go together are grouped into one partition, so that the
partitions are as independent as the bits allow. If two fingerprints differ in at most t bits and every
partition i has a threshold t_i with sum(t_i + 1) = t + 1, at least one partition differs in at most t_i bits
(t_i = -1: the partition is not looked at). A dynamic programme gives thresholds to partitions by the number
of candidates that counts of the values promise. Probing: a fingerprint looks up all values within t_i of its
own; what it meets is verified in the join itself, so only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm.common import attach_spread, materialize, table, whole_texts, with_place
from sqlgauge.llm.components import components

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: Numbers of partitions that are tried.
PARTITIONS = (1, 2, 3, 4)
#: Distinct fingerprints with one value of a partition from which on pairs are not compared but meet at what
#: they have in common: each then makes 2,016 rows, whatever the size of the group.
CROWD = 131_072

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; zero where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    k = min(shingle, len(words))
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(joined[i:j], SEED) for i, j in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                    np.uint64, len(words) - k + 1)
    columns = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int((1 << np.flatnonzero(2 * set_bits > len(h)).astype(object)).sum())


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed) and the part that read the row, written once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = whole_texts(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")
    return materialize(with_place(rows).drop("_rid"), "simhash")


def correlations(fps: DataFrame) -> np.ndarray:
    """How far each two bits go together over all fingerprints, 0 to 1; tasks send one matrix each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            one = np.hstack([np.ones((len(bits), 1)), bits])
            total += one.T @ one
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    total = np.zeros((BITS + 1) ** 2)
    for r in fps.select("fp").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    total = total.reshape(BITS + 1, BITS + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 1e-12)
    return np.abs(cov) / np.sqrt(np.outer(var, var))


def grouped(together: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits: each grows by the free bit that goes most with what it has."""
    free, out = list(range(len(together))), []
    for k in range(m):
        width = len(free) // (m - k)
        part: list[int] = []
        while len(part) < width:
            gain = together[np.ix_(free, part)].sum(axis=1) if part else together[np.ix_(free, free)].sum(axis=1)
            part.append(free.pop(int(np.argmax(gain))))
        out.append(sorted(part))
    return out


def _mask(part: Sequence[int]) -> int:
    mask = sum(1 << b for b in part)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def thresholds(costs: Sequence[Sequence[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) of least cost with sum(t + 1) = distance + 1; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for units in range(distance + 2 - used):
                option = (c + cost[units], [*chosen, units - 1])
                if used + units not in new or option < new[used + units]:
                    new[used + units] = option
        best = new
    return best[distance + 1]


def plan(fps: DataFrame, distance: int = DISTANCE, tried: Sequence[int] = PARTITIONS) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds. Costs: candidates (rows that share a value, counted over all distinct
    fingerprints, times the values looked up) and look-ups."""
    together = correlations(fps)
    options = [grouped(together, m) for m in tried]
    parts = [p for o in options for p in o]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("v"))
                               for i, p in enumerate(parts)]))
    counts = fps.select(keys.alias("k")).groupBy("k.i", "k.v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = {r["i"]: (r["pairs"], r["rows"]) for r in counts.groupBy("i").agg(
        F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).collect()}

    def cost(i: int, part: list[int]) -> list[float]:
        pairs, rows = met.get(i, (0.0, 0.0))
        near = [sum(comb(len(part), d) for d in range(t + 1)) for t in range(distance + 1)]
        return [0.0, *[pairs * k + 20.0 * rows * k for k in near]]

    best, at = None, 0
    for option in options:
        c, chosen = thresholds([cost(at + i, p) for i, p in enumerate(option)], distance)
        at += len(option)
        if best is None or c < best[0]:
            best = (c, [(p, t) for p, t in zip(option, chosen) if t >= 0])
    return best[1]


def _near(fp: Column, i: int, part: list[int], t: int) -> Column:
    """``(i, v)`` for all values ``v`` of partition ``i`` that differ from the fingerprint's in at most ``t`` bits."""
    own = fp.bitwiseAND(F.lit(_mask(part)))
    flips = F.array(*[F.lit(_mask(c)).cast("long") for d in range(t + 1) for c in combinations(part, d)])
    return F.transform(flips, lambda f: F.struct(F.lit(i).alias("i"), own.bitwiseXOR(f).alias("v")))


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD, parts=None) -> DataFrame:
    """``a, b``: links that join every two of the distinct fingerprints at most ``distance`` bits apart,
    directly or, in crowds, over others that are linked likewise."""
    parts = parts or plan(fps, distance)
    own, asked = [], []
    for i, (part, t) in enumerate(parts):
        own.append(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("v")))
        asked.append(_near(F.col("fp"), i, part, t))
    index = fps.select(F.explode(F.array(*own)).alias("k"), "fp").select("k.i", "k.v", F.col("fp").alias("b"))
    probes = fps.select(F.explode(F.flatten(F.array(*asked))).alias("k"), "fp").select(
        F.col("k.i").alias("pi"), F.col("k.v").alias("pv"), F.col("fp").alias("a"))
    crowds = materialize(index.groupBy("i", "v").count().where(F.col("count") > crowd).select("i", "v"), "simhash-crowds")
    pair = (F.col("pi") == F.col("i")) & (F.col("pv") == F.col("v")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # a partition looked up in a radius meets each pair from both sides, as does one looked up exactly
    pair &= F.col("a") > F.col("b")
    if crowds.isEmpty():
        return probes.join(index, pair).select("a", "b").distinct()
    index = index.join(crowds, ["i", "v"], "left_anti")
    found = probes.join(index, pair).select("a", "b")
    in_crowd = probes.join(crowds, (F.col("pi") == F.col("i")) & (F.col("pv") == F.col("v")), "left_semi")
    masks = [_mask([b for b in range(BITS) if b not in c]) for c in combinations(range(BITS), distance)]
    shared = in_crowd.select("a").distinct().select(
        "a", F.posexplode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("a").bitwiseAND(m))))
    # at most 2 ** distance fingerprints have all but these bits in common
    met = shared.groupBy("pos", "col").agg(F.min("a").alias("b"), F.collect_set("a").alias("all"))
    met = met.select(F.explode("all").alias("a"), "b").where("a != b")
    return found.union(met).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint`` (hex) and ``component_id``, the smallest
    ``doc_id`` that links of at most ``distance`` bits reach.

    Null and wordless texts have fingerprint zero and are linked like any other. A null ``doc_id`` is never the
    smallest unless there is no other. Repeated rows stay; an empty table stays empty; other columns are not
    read.
    """
    rows = fingerprints(docs)
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    met = components(links(distinct.select("fp"), distance, crowd), "a", "b")
    named = distinct.join(met, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("_c"))
    named = materialize(named, "simhash-components")
    firsts = materialize(named.groupBy("_c").agg(F.min("first").alias("component_id")), "simhash-firsts")
    out = attach_spread(rows, named.join(firsts, "_c").select("fp", "component_id"), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component; rows with a null or the same id all stay."""
    firsts = near_duplicates(docs, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"))
    return rows.join(firsts, F.col("_doc.doc_id").eqNullSafe(F.col("_id")), "left_semi").select("_doc.*")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
