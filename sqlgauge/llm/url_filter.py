"""URL filters by a cascade of Bloom filters over the corpus's complete key universe.

The rules that can fit a url are its keys: each suffix of the host with each path prefix that is as long as
some rule's path. The first filter of a cascade encodes the listed keys, the second those keys of the corpus
that pass the first without being listed, the third the listed ones that pass the second, and so on until no
key of the corpus is wrong at any level. Membership is then exact for each key of the corpus, and urls are
judged without a join. The first filter is sized for as many false positives as there are rules, so all
filters together take O(rules x log(keys / rules)) bits; that is what the tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm.common import materialize, table

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Verdict where no rule fits: the filters hold what is listed, so an unlisted url passes.
UNLISTED = "allow"


@dataclass
class Bloom:
    bits: np.ndarray  # bytes
    size: int
    hashes: int

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for i in range(self.hashes):
            at = (a + np.uint64(i) * b) % np.uint64(self.size)
            ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _shape(n: int, rate: float) -> tuple[int, int]:
    size = max(64, int(np.ceil(n * -np.log(rate) / np.log(2) ** 2)))
    return size, max(1, round(-np.log2(rate)))


def _unsigned(s) -> np.ndarray:
    return np.asarray(s, np.int64).view(np.uint64)


def _hashes(key: str | Column, level: int) -> list[Column]:
    """Two hashes of a key, other ones at every level."""
    return [F.xxhash64(F.lit(2 * level + i), key) for i in (0, 1)]


def _encoded(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A filter of all keys: tasks set bits, the driver receives the filter's bytes and nothing else."""
    size, hashes = _shape(n, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = _unsigned(b["a"]), _unsigned(b["b"])
            at = np.unique(np.concatenate([(x + np.uint64(i) * y) % np.uint64(size) for i in range(hashes)]))
            yield pd.DataFrame({"at": (at >> np.uint64(3)).astype(np.int64), "bit": (1 << (at & np.uint64(7)).astype(np.int64))})

    a, b = _hashes("key", level)
    got = keys.select(a.alias("a"), b.alias("b")).mapInPandas(run, "at long, bit long")
    bits = np.zeros(size // 8 + 1, np.uint8)
    for r in got.groupBy("at").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["at"]] = r["bit"]
    return Bloom(bits, size, hashes)


def _passing(keys: DataFrame, f: Bloom, level: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f.passes(_unsigned(a), _unsigned(b)))

    return keys.where(passes(*_hashes("key", level)))


def cascade(listed: DataFrame, n_listed: int, others: DataFrame, n_others: int) -> list[Bloom]:
    """Filters that tell ``listed`` from ``others`` (distinct ``key`` each) without an error."""
    filters: list[Bloom] = []
    inside, outside, n_in, n_out = listed, others, n_listed, n_others
    while n_in:
        # the first as exact as listed / others asks for, the rest one bit in two
        rate = min(0.5, max(1e-9, 0.7 * n_in / max(n_out, 1))) if not filters else 0.5
        filters.append(_encoded(inside, n_in, rate, len(filters)))
        wrong = materialize(_passing(outside, filters[-1], len(filters) - 1), "cascade")
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    return filters


def member(filters: list[Bloom], hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether each key is listed: the first level that it does not pass decides, odd ones for it."""
    n = len(hashes[0][0]) if hashes else 0
    out, left = np.zeros(n, bool), np.ones(n, bool)
    for level, f in enumerate(filters):
        ok = np.zeros(n, bool)
        ok[left] = f.passes(hashes[level][0][left], hashes[level][1][left])
        out[left & ~ok] = level % 2 == 1
        left &= ok
    out[left] = len(filters) % 2 == 1
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end. Both are empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int], labels: int) -> Column:
    """Rules that could fit, the longest first: suffixes of the host of up to ``labels`` labels (no rule has
    more), prefixes of the path of the ``lengths`` that rules have. Their number does not depend on the url."""
    parts = F.split(F.substring_index(host, ".", -labels), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.flatten(F.array(*[F.when(F.length(path) >= n, F.array(path.substr(F.lit(1), F.lit(n))))
                                   .otherwise(F.array().cast("array<string>")) for n in sorted(lengths, reverse=True)]))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_sort(F.array_distinct(keys), lambda x, y: F.length(y) - F.length(x))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, unlisted: str = UNLISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    Without rules, or where none fits, the rule is null and the verdict ``unlisted``; repeated rows stay, rows
    without ``page_id`` too; a host of any number of labels has no more keys than the longest rule; other
    columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = {h + p: v for h, p, v in rules}
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    universe = materialize(urls.select(F.explode("keys").alias("key")).distinct(), "url-keys")

    def listed(wanted: list[str]) -> DataFrame:
        return spark.createDataFrame([(k,) for k in wanted], "key string")

    rest = universe.join(listed(list(verdicts)), "key", "left_anti")
    known = cascade(listed(list(verdicts)), len(verdicts), rest, rest.count())
    split = {v: [k for k in verdicts if verdicts[k] == v] for v in ("block", "allow")}
    blocks = cascade(listed(split["block"]), len(split["block"]), listed(split["allow"]), len(split["allow"]))
    filters = spark.sparkContext.broadcast((known, blocks))  # O(rules x log(keys / rules)) bits

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(keys: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known, blocks = filters.value
        sizes = np.array([len(k) for k in keys], np.int64)
        flat = [k for row in keys for k in row]
        levels = max(len(known), len(blocks), 1)

        def hashes(col: pd.Series) -> np.ndarray:
            return _unsigned(np.concatenate([np.asarray(v, np.int64) for v in col]) if len(flat) else []).reshape(-1, levels)

        x, y = hashes(a), hashes(b)
        pairs = [(np.ascontiguousarray(x[:, i]), np.ascontiguousarray(y[:, i])) for i in range(levels)]
        hit, blocked = member(known, pairs), member(blocks, pairs)
        row = np.repeat(np.arange(len(sizes)), sizes)[hit]
        first = np.unique(row, return_index=True)
        rule, verdict = [None] * len(sizes), [unlisted] * len(sizes)
        at = np.flatnonzero(hit)
        for r, i in zip(*first):
            rule[r], verdict[r] = flat[at[i]], "block" if blocked[at[i]] else "allow"
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    levels = max(len(known), len(blocks), 1)

    def hashed(i: int) -> Column:
        return F.flatten(F.transform("keys", lambda k: F.array(*[_hashes(k, level)[i] for level in range(levels)])))

    return urls.withColumn("_said", judge("keys", hashed(0), hashed(1))).select(
        "page_id", "host", "path", F.col("_said.rule").alias("rule"), F.col("_said.verdict").alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    case = lambda i, e: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + f" ELSE {e} END"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s)
SELECT page_id, host, path, {case(1, "NULL")} AS rule, {case(2, f"'{UNLISTED}'")} AS verdict FROM h
"""


SQL = _sql()
