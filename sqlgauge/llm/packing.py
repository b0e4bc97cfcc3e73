"""Best-fit packing of token sequences, bulk-synchronous.

Documents of one length are alike, and so are open sequences with one gap. Both are kept as sorted runs
(size, how many); a round takes the documents of the largest length left, and sweeps the gaps upwards for the
successor: the smallest gap that fits. The documents of a run compete for the sequences of that gap by rank;
the first ranks get them, the others go on to the next gap, and to new sequences where no gap fits. Then the
gaps are updated and the next round begins. There are at most ``limit`` rounds and ``limit`` runs of either
kind, whatever the corpus holds, so the sweep needs no row of it. Lengths are counted, ranked and turned into
places by all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sqlgauge.llm.common import materialize, table, whole_texts
from sqlgauge.llm.tokens import batches_of_text, default_tokenizer, encoder

LIMIT, END_ID = 2048, 0

_PIECES = "piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def pieces(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece, and its rank among the pieces of its length
    that the same task read (``_part, _rank``). Write the result before use.

    A document is its ids and the end id; null text counts as empty, so each row has a piece at least. One that
    is longer than ``limit`` is cut into pieces of ``limit``, of which the first may be shorter.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            texts, ids = [t or "" for t in b["text"]], b["doc_id"].tolist()
            for s, e in batches_of_text(texts):
                rows = []
                for doc, raw in zip(ids[s:e], encoder(path).encode(texts[s:e])):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % limit or limit, n, limit), n]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, i, j - i, zlib.crc32(raw[4 * i:4 * j]), part, seen[j - i]))
                        seen[j - i] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64") if kind == "bigint" else out["doc_id"]
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole_texts(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {_PIECES}")


def sweep(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Best fit over runs: rows ``(length, first rank, first sequence, ranks in each sequence, offset)``.

    From its first rank on (until the next row's), ranks of this length go to sequences from the first on, so
    many in each, one behind the other from the offset. Runs of sequences with one gap are ``(first, how
    many)`` intervals.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # sorted keys of gaps
    plan, used = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = limit, used, -(-left // (limit // length))
                used += n
            each = gap // length  # best fit stays with a sequence until it is full
            full = min(n, left // each)
            plan.append((length, rank, first, each, limit - gap))
            rest = left - full * each if full < n else 0  # the last sequence of the run gets fewer
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return plan


def placed(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (written) with ``sequence_id`` and ``offset``."""
    parts = materialize(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-runs")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = sweep(counts, limit)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.join(bases, ["length", "_part"])
    ranked = ranked.select(*[c for c in rows.columns if c != "_rank"], (F.col("_base") + F.col("_rank")).alias("_rank"))
    steps = np.array(plan, np.int64).reshape(-1, 5)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = rows.sparkSession.sparkContext.broadcast(steps[order])  # O(limit) rows, see sweep

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, n, r = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.zeros(len(n), np.int64)
        for size in np.unique(n):
            mine, low = n == size, np.searchsorted(p[:, 0], size)
            high = np.searchsorted(p[:, 0], size, side="right")
            at[mine] = low + np.searchsorted(p[low:high, 1], r[mine], side="right") - 1
        step, k = p[at], r - p[at, 1]
        return pd.DataFrame({"sequence_id": step[:, 2] + k // step[:, 3], "offset": step[:, 4] + k % step[:, 3] * n})

    return ranked.withColumn("_at", place("length", "_rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of ``docs``, packed into sequences of at most ``limit`` ids.

    An empty table gives no rows; repeated rows are packed each; other columns are not read.
    """
    return placed(materialize(pieces(docs, limit, tokenizer), "pack-pieces"), limit)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
