"""What both substring operators share: pieces of text as arrays, repeated values, a filter of fixed size, and
the removal of spans.

A window is ``WINDOW`` units (words or bytes) of one document. Each window is known by the smallest hash of the
shorter windows inside it, so equal windows have the same value, and neighbours mostly share theirs. Values that
occur in one document alone cannot belong to a repeated window. The repeated ones are counted by a shuffle of
their hashes, and kept as one bit each in a filter of bounded size. A value that is in the filter by chance only
makes a candidate more; nothing is lost however full it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm.common import materialize, text_or_empty, whole_texts

WINDOW = 50
#: Units worked on at once; values a task gathers before it sends them.
UNITS, GATHERED = 500_000, 1_000_000
#: Bits by which values are dealt to groups, at least, bytes of text for each group, and bits of an address in the
#: filter, at most (256 MB).
DEALT, GROUP_BYTES, FILTER_BITS = 8, 1 << 22, 31

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each ``k`` neighbours."""
    w = 1
    while 2 * w <= k:
        x, w = np.minimum(x[:-w], x[w:]), 2 * w
    return np.minimum(x[:len(x) - (k - w)], x[k - w:]) if w < k else x


@dataclass
class Piece:
    """Units of some documents in a row. Windows start at ``at`` (units) in document ``doc`` (row of the batch),
    at ``pos`` there. A document longer than ``UNITS`` is spread over pieces that overlap by a window less one."""

    units: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    pos: np.ndarray


def pieces(texts: list[bytes], units_of: Callable[[bytes], np.ndarray]) -> Iterator[Piece]:
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def made() -> Piece:
        units = np.concatenate([p[2] for p in parts])
        n = np.array([len(p[2]) for p in parts], np.int64)
        first = np.cumsum(n) - n
        starts = n - WINDOW + 1
        doc = np.repeat(np.array([p[0] for p in parts], np.int64), starts)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
        return Piece(units, np.repeat(first, starts) + inside, doc,
                     np.repeat(np.array([p[1] for p in parts], np.int64), starts) + inside)

    for d, raw in enumerate(texts):
        units = units_of(raw)
        for s in range(0, max(len(units) - WINDOW + 1, 0), UNITS):
            part = units[s:s + UNITS + WINDOW - 1]
            if parts and size + len(part) > UNITS:
                yield made()
                parts, size = [], 0
            parts.append((d, s, part))
            size += len(part)
    if parts:
        yield made()


def raw_texts(b: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]


def _turned(b: np.ndarray, width: int) -> bytes:
    """Rows of so many bytes as columns."""
    return b.reshape(-1, width).T.tobytes()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0


def dealt_bits(size: int) -> int:
    """Bits by which the values of so many bytes of text are dealt: a group is as large in a large corpus as in a
    small one."""
    return max(DEALT, (max(size - 1, 0) // GROUP_BYTES).bit_length())


def _deal(values: np.ndarray, twice: bool, dealt: int) -> pd.DataFrame:
    """Sorted values as one row per bucket: 32 bits of each, the bucket being the ones before. Their first bytes
    come first, then their second ones and so on: the first are in order and compress well."""
    v = np.sort(values)
    if twice:  # more than two of a value say no more than two
        v = v[np.r_[np.ones(min(2, len(v)), bool), v[2:] != v[:-2]]]
    bucket = (v >> np.uint64(64 - dealt)).astype(np.int64)
    low = (v >> np.uint64(32 - dealt)).astype("<u4")
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(v) else np.zeros(1, int)
    return pd.DataFrame({"bucket": bucket[cut[:-1]], "v": [_turned(low[i:j].view(np.uint8), 4) for i, j in zip(cut, cut[1:])]})


def documents(docs: DataFrame) -> DataFrame:
    """Rows that take part; a document without an identifier neither removes nor loses anything."""
    return whole_texts(docs).select("doc_id", "text").where("doc_id IS NOT NULL AND length(text) > 0")


def repeated_values(docs: DataFrame, values_of: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]],
                    name: str, dealt: int = DEALT) -> np.ndarray:
    """The filter of all values that occur in two documents at least (few others may pass).

    ``values_of`` yields rows of the batch and values, piece by piece. ``dealt``: of ``dealt_bits``.
    """
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for doc, v in values_of(raw_texts(b)):
                new = np.r_[np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])]
                doc, v = doc[new], v[new]
                order = np.lexsort((v, doc))
                doc, v = doc[order], v[order]
                new = np.r_[np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])]
                held.append(v[new])
                size += len(held[-1])
                if size > GATHERED:
                    yield _deal(np.concatenate(held), True, dealt)
                    held, size = [], 0
        if size:
            yield _deal(np.concatenate(held), True, dealt)

    def again(key, b: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(np.concatenate([np.frombuffer(_turned(np.frombuffer(x, np.uint8), len(x) // 4), "<u4") for x in b["v"]]))
        v = v[1:][v[1:] == v[:-1]]
        v = v[np.r_[np.ones(min(1, len(v)), bool), v[1:] != v[:-1]]]
        return pd.DataFrame({"bucket": [key[0]], "n": [len(v)], "v": [v.tobytes()]})

    sent = documents(docs).mapInPandas(gather, "bucket long, v binary")
    found = materialize(sent.groupBy("bucket").applyInPandas(again, "bucket long, n long, v binary"), name)
    n = found.agg(F.sum("n")).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(16 * max(n, 1))), dealt + 6, FILTER_BITS))

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["v"]:
                flags = np.zeros(1 << (bits - dealt), np.uint8)
                flags[np.frombuffer(v, "<u4") >> np.uint32(32 - (bits - dealt))] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pd.DataFrame({"bucket": b["bucket"], "s": out})

    whole = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (bits - dealt - 3)
    for r in found.select("bucket", "v").mapInPandas(segment, "bucket long, s binary").toLocalIterator():
        whole[r["bucket"] * step:(r["bucket"] + 1) * step] = np.frombuffer(r["s"], np.uint8)
    return whole


def in_filter(whole: np.ndarray, v: np.ndarray) -> np.ndarray:
    at = v >> np.uint64(64 - (len(whole).bit_length() - 1 + 3))
    return (whole[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ranges(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions that follow each other: document, first, how many."""
    if not len(doc):
        return doc, pos, pos
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    cut = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)])
    last = np.r_[cut[1:], len(doc)] - 1
    return doc[cut], pos[cut], pos[last] - pos[cut] + 1


def text_keys(texts: list[bytes]) -> np.ndarray:
    """Second part of a row's name, so that rows with one ``doc_id`` keep their own spans."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).astype(np.uint32).view(np.int32)


def without_spans(docs: DataFrame, spans: DataFrame, remove: Callable[[bytes, np.ndarray, np.ndarray], tuple],
                  schema: str) -> DataFrame:
    """Apply ``remove(text, first window starts, how many)`` to every row of ``docs``; ``spans`` has rows
    ``doc_id, th, pos, n`` in any number. Rows without a span get empty arrays. Texts go to their spans compressed."""
    of = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        small = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = raw_texts(b)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": text_keys(texts), "text": [small.compress(t) for t in texts]})

    rows = whole_texts(docs).select("doc_id", text_or_empty().alias("text")).mapInPandas(
        pressed, f"doc_id {kind}, th int, text binary")
    met = rows.join(of, ["doc_id", "th"], "left").select(
        "doc_id", "text", F.col("spans.pos").alias("pos"), F.col("spans.n").alias("n"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none, small = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for b in batches:
            out = [remove(small.decompress(t), none if p is None else np.asarray(p, np.int64), none if n is None else np.asarray(n, np.int64))
                   for t, p, n in zip(b["text"], b["pos"], b["n"])]
            out = pd.DataFrame(out, columns=names)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return met.mapInPandas(run, f"doc_id {kind}, {schema}")


def covered(size: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Units inside a window that starts in one of the runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + n + WINDOW - 1, -1)
    return np.cumsum(edge[:size]) > 0
