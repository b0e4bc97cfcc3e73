"""Repeated strings of 50 bytes by a hash-compared suffix sort.

Each window of 50 bytes has an anchor: the short string in it whose hash is smallest. Equal windows have equal
anchors at the same place. Suffixes are sorted where they start at an anchor that several documents have: to the
right from the anchor, and, read backwards, to the left. A merge sort compares two suffixes by a binary search
over prefix polynomial hashes for their common extension, and then by one byte. Extensions of neighbours are
verified byte by byte after the sort; an order that a hash collision spoilt is made anew from the bytes. From
the extensions to both sides follows which windows around the anchors are equal.

Runs of windows with one anchor are dealt to buckets by its hash. A task sends what it has for a bucket as one
compressed row; the number of buckets follows the size of the texts, and a task sorts one bucket at a time.

The suffixes of one anchor are sorted in one task. An anchor with very many runs is found by a sample of the
documents; its runs are taken apart into their windows, of which a task sends each different one once, and which
meet by a hash of all their bytes. Such a window has at most one row for each batch of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm.common import table
from sqlgauge.llm.windows import (
    GATHERED, UNITS, WINDOW, _turned, covered, dealt_bits, documents, in_filter, mixed, pieces, ranges, raw_texts,
    repeated_values, sliding_min, text_bytes, text_keys, without_spans,
)

#: Bytes of an anchor; lengths of which the repeated strings are counted before windows are looked at.
ANCHOR, COUNTED = 16, (25, 40)
#: The low bits of an anchor's key hold its place, so that the first of equal ones counts.
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes of text for each bucket; rows of suffixes sorted at once, anchors being kept together.
BUCKET_BYTES, SORTED = 1 << 23, 60_000
#: Runs of one anchor above which it is taken apart; one of so many documents is looked at to find such anchors.
HOT, SAMPLE = 15_000, 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(b: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all prefixes."""
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:len(b)], out=s[1:])
    return s


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


class Anchors:
    """Smallest short strings of the windows of a piece."""

    def __init__(self):
        self.up = self.back = np.zeros(0, np.uint64)

    def keys(self, s: np.ndarray, length: int) -> np.ndarray:
        """For each window the hash of its smallest string of a length above, the place of that below."""
        h = mixed((s[length:] - s[:-length]) * self.back[:len(s) - length])
        h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        return sliding_min(h, WINDOW - length + 1)

    def candidates(self, texts: list[bytes], filters: list[np.ndarray]) -> Iterator[tuple]:
        """Windows whose smallest strings are repeated at each length counted so far; the prefix hashes."""
        for p in pieces(texts, _bytes):
            if len(self.up) <= len(p.units):
                self.up, self.back = _powers(_BASE, UNITS + WINDOW), _powers(_BACK, UNITS + WINDOW)
            s, left = prefix_hashes(p.units, self.up), np.arange(len(p.at))
            for length, whole in zip(COUNTED, filters):
                left = left[in_filter(whole, self.keys(s, length)[p.at[left]])]
            if len(left):
                yield p, s, left

    def values(self, texts: list[bytes], filters: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, s, left in self.candidates(texts, filters):
            yield p.doc[left], self.keys(s, length)[p.at[left]] & ~_PLACE


_PACKED = "bucket long, known boolean, packed binary"
#: Columns of a packed row: kind of number, and whether neighbours are alike in all their bytes but the last ones.
_COLUMNS = (("v", "<u8"), ("a", "<u2"), ("doc_id", "<i8"), ("th", "<i4"), ("pos", "<i4"), ("n", "<u2"))
_FROM_BYTES = np.uint64(0xD6E8FEB86659FD93)


def _pack(small: zstandard.ZstdCompressor, columns: list[np.ndarray], text: bytes) -> bytes:
    """Columns and the bytes of their runs one after another, compressed; bytes of one weight stand together."""
    held = [_turned(np.ascontiguousarray(x.astype(kind)).view(np.uint8), np.dtype(kind).itemsize)
            for x, (_, kind) in zip(columns, _COLUMNS)]
    return small.compress(len(columns[0]).to_bytes(8, "little") + b"".join(held) + text)


def _unpack(large: zstandard.ZstdDecompressor, packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = large.decompress(packed)
    n, at, columns = int.from_bytes(raw[:8], "little"), 8, []
    for _, kind in _COLUMNS:
        width = np.dtype(kind).itemsize
        columns.append(np.frombuffer(_turned(np.frombuffer(raw, np.uint8, n * width, at), n), kind))
        at += n * width
    return columns, raw[at:]


def _runs(p, left: np.ndarray, key: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """First of each run of windows with one anchor; windows in ``apart`` are runs of their own."""
    at, doc = p.at[left], p.doc[left]
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | apart[1:]])


def frequent_anchors(docs: DataFrame, filters: list, hot: int, sample: int) -> np.ndarray:
    """Sorted anchors of about ``hot`` runs at least, by a sample of the documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = Anchors()
        for b in batches:
            for p, s, left in anchors.candidates(raw_texts(b), [f.value for f in filters]):
                key = anchors.keys(s, ANCHOR)[p.at[left]]
                v, n = np.unique(key[_runs(p, left, key, np.zeros(len(left), bool))] & ~_PLACE, return_counts=True)
                yield pd.DataFrame({"v": v.view(np.int64), "n": n})

    some = documents(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE)), F.lit(sample)) == 0)
    counts = some.mapInPandas(count, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * sample >= hot).select("v").toPandas()["v"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _pieces_of(batches: Iterator[pd.DataFrame], filters: list[np.ndarray], frequent: np.ndarray,
               buckets: int) -> Iterator[pd.DataFrame]:
    """Runs of windows with one anchor that is repeated, with their bytes; single windows where the anchor is
    frequent. Of equal runs gathered by a task only those of the smallest identifier go on; the windows of the
    others are removed here. What goes to one bucket is one packed row."""
    anchors, small = Anchors(), zstandard.ZstdCompressor(level=1)
    held, size = [], 0

    def flush() -> Iterator[pd.DataFrame]:
        v, a, ids, keys, pos, n = (np.concatenate([h[i] for h in held]) for i in range(6))
        raws = [r for h in held for r in h[6]]
        same = pd.factorize(pd.Series(raws, dtype=object))[0]
        order = np.lexsort((ids, same, a, v))
        new = np.r_[True, (v[order][1:] != v[order][:-1]) | (a[order][1:] != a[order][:-1]) | (same[order][1:] != same[order][:-1])]
        owner = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        sent = ids[order] == owner
        # the smallest of strings is no even number, so its bits are spread again
        bucket = ((mixed(v) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        out = []
        gone = order[~sent]
        if len(gone):  # what is removed already goes along in a bucket of its own
            columns = [x[gone] for x in (v, a, ids, keys, pos, n)]
            out.append((int(bucket[gone[0]]), True, _pack(small, columns, b"")))
        on = order[sent]
        on = on[np.argsort(bucket[on], kind="stable")]
        cut = np.flatnonzero(np.r_[True, bucket[on][1:] != bucket[on][:-1], True])
        for i, j in zip(cut, cut[1:]):
            rows = on[i:j]
            out.append((int(bucket[rows[0]]), False, _pack(
                small, [x[rows] for x in (v, a, ids, keys, pos, n)], b"".join([raws[k] for k in rows.tolist()]))))
        yield pd.DataFrame(out, columns=["bucket", "known", "packed"])

    for b in batches:
        texts = raw_texts(b)
        ids, keys = b["doc_id"].to_numpy(np.int64), text_keys(texts)
        for p, s, left in anchors.candidates(texts, filters):
            at = p.at[left]
            key = anchors.keys(s, ANCHOR)[at]
            apart = np.isin(key & ~_PLACE, frequent)
            cut = _runs(p, left, key, apart)
            n = np.diff(np.r_[cut, len(left)])
            first, k = at[cut], left[cut]
            text = p.units.tobytes()
            raws = [text[i:j] for i, j in zip(first.tolist(), (first + n + WINDOW - 1).tolist())]
            # runs meet by their anchor, windows of a frequent one by all their bytes
            whole = mixed((s[first + WINDOW] - s[first]) * anchors.back[first]) ^ _FROM_BYTES
            v = np.where(apart[cut], whole, key[cut] & ~_PLACE)
            held.append((v, (key[cut] & _PLACE).astype(np.int64) - first, ids[p.doc[k]], keys[p.doc[k]],
                         p.pos[k], n, raws))
            size += len(cut)
            if size > GATHERED // 4:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


class Suffixes:
    """Suffixes of limited length in an array of bytes, to be sorted inside groups."""

    def __init__(self, b: np.ndarray, start: np.ndarray, size: np.ndarray, powers: np.ndarray):
        self.b, self.start, self.size, self.powers = b, start, size, powers
        self.s = prefix_hashes(b, powers)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes by binary search over equal hashes."""
        i, j = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.s[i + mid] - self.s[i]) * self.powers[j] == (self.s[j + mid] - self.s[j]) * self.powers[i]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x comes before y, is the same, or comes after."""
        n = self.common(x, y)
        end_x, end_y = n >= self.size[x], n >= self.size[y]
        c = self.b[np.where(end_x, 0, self.start[x] + n)].astype(np.int64)
        d = self.b[np.where(end_y, 0, self.start[y] + n)].astype(np.int64)
        return np.sign(np.where(end_x, -1, c) - np.where(end_y, -1, d))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Merge sort inside each group (rows of a group stand together): all merges of a level at once."""
        n = len(group)
        new = np.flatnonzero(np.r_[np.ones(min(1, n), bool), group[1:] != group[:-1]])
        sizes = np.diff(np.r_[new, n])
        first, many = np.repeat(new, sizes), np.repeat(sizes, sizes)
        order, width, most = np.arange(n), 1, int(sizes.max(initial=0))
        while width < most:
            at = np.flatnonzero(many > width)
            k = at - first[at]
            run = k // width
            low = np.minimum((run ^ 1) * width, many[at])
            high = np.minimum(low + width, many[at])
            begin, right = low.copy(), run % 2 == 1
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                mid = (low[todo] + high[todo]) >> 1
                c = self.compare(order[first[at[todo]] + mid], order[at[todo]])
                before = (c < 0) | (right[todo] & (c == 0))
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
            place = first[at] + (run & ~1) * width + (k - run * width) + (low - begin)
            merged = order.copy()
            merged[place] = order[at]
            order, width = merged, 2 * width
        return self.verified(order, group)

    def extensions(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each suffix with the one before it in the order, byte by byte."""
        n = np.zeros(len(order), np.int64)
        x, y = order[1:], order[:-1]
        most = np.minimum(self.size[x], self.size[y])
        live = np.arange(len(x))
        for t in range(WINDOW):
            live = live[most[live] > t]
            live = live[self.b[self.start[x[live]] + t] == self.b[self.start[y[live]] + t]]
            n[1 + live] = t + 1
        return n

    def verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order, with groups sorted anew from their bytes where two neighbours stand wrong."""
        n = self.extensions(order)[1:]
        x, y = order[1:], order[:-1]
        more = (n < self.size[x]) & (n < self.size[y])
        wrong = (group[x] == group[y]) & np.where(
            more, self.b[np.where(more, self.start[x] + n, 0)] < self.b[np.where(more, self.start[y] + n, 0)],
            self.size[x] < self.size[y])
        for g in np.unique(group[x[wrong]]):
            at = np.flatnonzero(group == g)
            order[at] = sorted(at.tolist(), key=lambda k: self.b[self.start[k]:self.start[k] + self.size[k]].tobytes())
        return order


def _classes(order: np.ndarray, extension: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Number of the class of suffixes of a group that agree in so many bytes, for each suffix."""
    new = np.r_[True, (extension[1:] < length) | (group[order][1:] != group[order][:-1])]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(v, a, ids, raws) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in them at which a window starts that a row with a smaller identifier also has.

    Rows are runs of windows with one anchor ``v`` at ``a``, sorted by ``v``.
    """
    none = np.zeros(0, np.int64)
    if not len(v):
        return none, none
    size = np.array([len(r) for r in raws], np.int64)
    # rows with the same bytes: the smallest identifier stands for all, the others lose all their windows
    same = pd.factorize(pd.Series(raws, dtype=object))[0]
    order = np.lexsort((ids, same, a, v))
    new = np.r_[True, (v[order][1:] != v[order][:-1]) | (a[order][1:] != a[order][:-1]) | (same[order][1:] != same[order][:-1])]
    owner = np.empty(len(v), np.int64)
    owner[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = ids[owner] < ids
    starts = size - WINDOW + 1
    rows = np.repeat(np.flatnonzero(gone), starts[gone])
    places = np.arange(len(rows)) - np.repeat(np.cumsum(starts[gone]) - starts[gone], starts[gone])
    # among the rest, anchors of two documents at least
    rest = np.flatnonzero(~gone)
    group = np.unique(v[rest], return_inverse=True)[1]
    low, high = np.full(len(rest), np.iinfo(np.int64).max), np.full(len(rest), np.iinfo(np.int64).min)
    np.minimum.at(low, group, ids[rest])
    np.maximum.at(high, group, ids[rest])
    rest = rest[(low < high)[group]]
    if not len(rest):
        return rows, places
    order = np.argsort(v[rest], kind="stable")
    rest = rest[order]
    group = np.unique(v[rest], return_inverse=True)[1]
    text = b"".join([raws[i] for i in rest.tolist()])
    b, n, left = np.frombuffer(text, np.uint8), size[rest], a[rest]
    first = np.cumsum(n) - n
    powers = _powers(_BASE, len(b))
    right = Suffixes(b, first + left, n - left, powers)
    back = Suffixes(b[::-1].copy(), len(b) - first - left, left, powers)
    by_right, by_left = right.order(group), back.order(group)
    ext_right, ext_left = right.extensions(by_right), back.extensions(by_left)
    out_rows, out_places, mine = [rows], [places], ids[rest]
    for o in range(WINDOW - ANCHOR + 1):  # windows that start o bytes before the anchor
        has = np.flatnonzero((left >= o) & (n - left >= WINDOW - o))
        if not len(has):
            continue
        r = _classes(by_right, ext_right, group, WINDOW - o)[has]
        x = _classes(by_left, ext_left, group, o)[has]
        order = np.lexsort((mine[has], x, r))
        new = np.r_[True, (r[order][1:] != r[order][:-1]) | (x[order][1:] != x[order][:-1])]
        least = mine[has][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        lost = has[order[mine[has][order] > least]]
        out_rows.append(rest[lost])
        out_places.append(left[lost] - o)
    return np.concatenate(out_rows), np.concatenate(out_places)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """``doc_id, th, pos, n``: runs of windows that also start in a document with a smaller ``doc_id``."""
    filters: list = []
    size = text_bytes(docs)
    for length in COUNTED:
        def values(texts: list[bytes], length=length, before=tuple(filters)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            return Anchors().values(texts, [f.value for f in before], length)

        found = repeated_values(docs, values, f"bytes-{length}", dealt_bits(size))
        filters.append(docs.sparkSession.sparkContext.broadcast(found))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs, filters, HOT, SAMPLE))
    buckets = max(1, -(-size // BUCKET_BYTES))
    found = documents(docs).mapInPandas(
        lambda batches: _pieces_of(batches, [f.value for f in filters], frequent.value, buckets), _PACKED)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        large, held, now = zstandard.ZstdDecompressor(), [], None

        def removed(ids, th, pos, n) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": ids, "th": th, "pos": pos, "n": n.astype(np.int32)})

        def done() -> Iterator[pd.DataFrame]:
            v, a, ids, th, pos, n = (np.concatenate([h[0][i] for h in held]) for i in range(len(_COLUMNS)))
            text, length = b"".join([h[1] for h in held]), n.astype(np.int64) + WINDOW - 1
            start, order = np.cumsum(length) - length, np.argsort(v, kind="stable")
            new = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1], True])
            i = 0
            while i < len(new) - 1:  # whole anchors, so many rows at once
                j = max(i + 1, int(np.searchsorted(new, new[i] + SORTED, "right")) - 1)
                rows, i = order[new[i]:new[j]], j
                raws = [text[x:y] for x, y in zip(start[rows].tolist(), (start[rows] + length[rows]).tolist())]
                row, place = repeated_starts(v[rows], a[rows].astype(np.int64), ids[rows], raws)
                k, first, many = ranges(row, place)
                yield removed(ids[rows][k], th[rows][k], pos[rows][k] + first, many)

        for b in batches:
            for bucket, known, packed in zip(b["bucket"], b["known"], b["packed"]):
                columns, text = _unpack(large, packed)
                if known:
                    yield removed(*columns[2:])
                    continue
                if held and bucket != now:
                    yield from done()
                    held = []
                now = bucket
                held.append((columns, text))
        if held:
            yield from done()

    found = found.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return found.mapInPandas(sort, "doc_id long, th int, pos int, n int")


def cut_bytes(raw: bytes, pos: np.ndarray, n: np.ndarray) -> tuple[int, int, int, str]:
    if not len(pos):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    gone = covered(len(raw), pos, n)
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text counts as empty. A row without ``doc_id`` loses nothing and costs no other row anything; rows
    with one ``doc_id`` do not remove from each other. An empty table stays empty; other columns are not read.
    """
    return without_spans(docs, repeated_strings(docs), cut_bytes,
                         "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
