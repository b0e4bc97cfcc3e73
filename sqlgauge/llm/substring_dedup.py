"""Repeated windows of 50 words by level-wise doubling.

The hash of a window of twice the length is made from the hashes of its two halves (one word less than twice
where the length is odd): 1, 2, 4, 7, 13, 25, 50 words. At 13, 25 and 50 words it is counted which windows occur
in more than one document; only where such windows are is a text looked at with the next length. Of the windows
that are left, the document with the smallest identifier keeps its own, all others lose theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm.common import table
from sqlgauge.llm.windows import (
    GATHERED, WINDOW, covered, dealt_bits, documents, in_filter, mixed, pieces, ranges, raw_texts, repeated_values,
    sliding_min, text_bytes, text_keys, without_spans,
)

#: Lengths in words, each at most twice the one before.
LENGTHS = (1, 2, 4, 7, 13, 25, 50)
#: Lengths at which repeated windows are counted before the next length is tried.
COUNTED = (13, 25, 50)


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def doubled(units: np.ndarray, seed: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length, each from two windows of the length before."""
    level = {1: mixed(units + np.uint64(seed))}
    for short, long in zip(LENGTHS, LENGTHS[1:]):
        h = level[short]
        level[long] = mixed(h[:len(h) - (long - short)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[long - short:])
    return level


def _candidates(texts: list[bytes], filters: list[np.ndarray]) -> Iterator[tuple]:
    """Windows whose shorter windows are repeated at each length counted so far: the piece, its hashes, their
    starts, and the smallest hashes at the next length."""
    for p in pieces(texts, word_hashes):
        level = doubled(p.units)
        left = np.arange(len(p.at))
        for length, whole in zip(COUNTED, filters):
            least = sliding_min(level[length], WINDOW - length + 1)
            left = left[in_filter(whole, least[p.at[left]])]
        if len(left):
            yield p, level, left


def _values(filters: list[np.ndarray]):
    length = COUNTED[len(filters)]

    def run(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, level, left in _candidates(texts, filters):
            yield p.doc[left], sliding_min(level[length], WINDOW - length + 1)[p.at[left]]

    return run


_FOUND = "h long, h2 int, doc_id long, th int, pos int, n int"


def _decided(h, h2, doc, pos, ids, keys) -> Iterator[pd.DataFrame]:
    """Of the windows gathered by a task, those of the smallest identifier go on to the others; the rest is
    removed here, so a window shared by any share of the corpus goes on once per task and not per document."""
    order = np.lexsort((ids[doc], h2, h))
    h, h2, doc, pos = h[order], h2[order], doc[order], pos[order]
    new = np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
    owner = ids[doc][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else ids[:0]
    on = ids[doc] == owner
    d, first, n = ranges(doc[~on], pos[~on])
    if len(d):
        yield pd.DataFrame({"h": None, "h2": None, "doc_id": ids[d], "th": keys[d], "pos": first, "n": n})
    yield pd.DataFrame({"h": h[on].view(np.int64), "h2": (h2[on] >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[doc[on]],
                        "th": keys[doc[on]], "pos": pos[on], "n": 1})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, th, pos, n``: runs of windows that also start in a document with a smaller ``doc_id``."""
    context = docs.sparkSession.sparkContext
    filters: list = []
    dealt = dealt_bits(text_bytes(docs))
    for length in COUNTED:
        shared = [f for f in filters]

        def values(texts: list[bytes], shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            return _values([f.value for f in shared])(texts)

        filters.append(context.broadcast(repeated_values(docs, values, f"words-{length}", dealt)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f.value for f in filters]
        held, ids, keys, size, base = [], [], [], 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            yield from _decided(*(np.concatenate(x) for x in zip(*held)), np.concatenate(ids), np.concatenate(keys))

        for b in batches:
            texts = raw_texts(b)
            ids.append(b["doc_id"].to_numpy(np.int64))
            keys.append(text_keys(texts))
            for p, level, left in _candidates(texts, whole):
                at = p.at[left]
                held.append((level[WINDOW][at], doubled(p.units, 1)[WINDOW][at], p.doc[left] + base, p.pos[left]))
                size += len(left)
                if size > GATHERED:
                    yield from flush()
                    held, size = [], 0
            base += len(b)
            if not held:  # nothing refers to the rows so far
                ids, keys, base = [], [], 0
        if held:
            yield from flush()

    found = documents(docs).mapInPandas(find, _FOUND)
    # what is removed already goes along under keys of its own
    key = F.coalesce("h", F.xxhash64("doc_id", "pos"))
    least = F.min("doc_id").over(Window.partitionBy("_k", "h2"))
    found = found.withColumn("_k", key).withColumn("least", least)
    return found.where("h IS NULL OR doc_id > least").select("doc_id", "th", "pos", "n")


def cut_words(raw: bytes, pos: np.ndarray, n: np.ndarray) -> tuple[int, int, str]:
    words = raw.split()
    if not len(pos):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = covered(len(words), pos, n)
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    A null or empty text has no word. A row without ``doc_id`` loses nothing and costs no other row anything;
    rows with one ``doc_id`` do not remove from each other. An empty table stays empty; other columns are not
    read. Windows are equal if 96 bits of two hashes are.
    """
    return without_spans(docs, repeated_windows(docs), cut_words, "n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
