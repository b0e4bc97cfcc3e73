"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each document becomes a vector of statistics of its whole text. For either class of the labels the mean and
the covariance come from sums over all labelled rows outside the held-out fold; the covariance is shrunk
towards the pooled one and towards a multiple of the identity. The score of a document is the posterior from
the difference of the two Gaussian log densities: Mahalanobis distances by the cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm.common import materialize, table, text_or_empty, whole_texts

#: Share of the pooled covariance, and of the multiple of the identity, in a class covariance.
POOLED, SPHERE = 0.05, 0.02
#: Least mean variance (in units of the pooled one) that the identity is taken by: above the rounding of sums of
#: products, so that a class whose documents are all alike has a factor too.
LEAST_SPHERE = 1e-2
#: Documents with this score are accepted; one of so many folds is held out.
THRESHOLD, FOLDS = 0.3, 5

FEATURES = ("log_word_bytes", "upper", "digit", "mark", "symbol", "bar", "wide", "log_distinct",
            "repeats", "starts", "line_words", "top_word")

_KIND = np.zeros(256, np.int64)
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 4
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 5
_KIND[ord("|")] = 6
_KIND[128:] = 7
_KIND[[9, 10, 11, 12, 13, 32]] = 8

#: Words and bytes of plain text that every document starts from, and the shares of the kinds of bytes in them.
PLAIN_WORDS, PLAIN_BYTES = 10, 50
_PLAIN = np.array([0.0, 0.02, 0.9, 0.003, 0.02, 0.001, 0.0005, 0.05, 0.0])


def statistics(text: str | None) -> list[float]:
    """The vector of one text; null counts as empty, and an empty text has a vector like any other."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9)
    body = len(raw) - int(kinds[8])
    # every share starts from a few words of plain text, so that short texts look plain unless they are odd
    share = np.sqrt((kinds + PLAIN_BYTES * _PLAIN) / (body + PLAIN_BYTES))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    starts = sum(1 for w in words if w[:1].isupper())
    m = n + PLAIN_WORDS
    return [
        np.log((body + PLAIN_BYTES) / m), share[1], share[3], share[4], share[5], share[6], share[7],
        np.log((len(counts) + PLAIN_WORDS) / m ** 0.85), np.sqrt((again + 0.05) / m),
        np.sqrt((starts + 0.08 * PLAIN_WORDS) / m), np.log((n + 3 * PLAIN_WORDS) / (raw.count(b"\n") + 1.0)),
        np.sqrt((max(counts.values(), default=0) + 0.06 * PLAIN_WORDS) / m),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the vector ``x`` of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]})

    return whole_texts(docs).select("doc_id", "text").mapInPandas(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def held_out(c: str = "doc_id") -> Column:
    """True for the fold that training must not see; rows without an identifier are in no fold."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse of the Cholesky factor of each class
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.means:
            return np.full(len(x), 0.5)
        log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
               for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700.0, 700.0)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of the labelled rows outside the held-out fold.

    Every such row counts (a document with two different labels counts in both classes). Tasks send sums of
    products, one small matrix per class, not rows. Without rows of both classes every score is 0.5.
    """
    d = len(FEATURES)
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    rows = features.where(~held_out()).join(known, "doc_id").select("quality", "x")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(-1, d)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                mine = one[b["quality"].to_numpy() == k]
                total[k] += mine.T @ mine
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = rows.mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (d + 1) ** 2)
    for r in got:
        total[r["at"]] = r["v"]
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    if n.min() < 1:
        return Discriminant([], [], [])
    means = [total[k, 0, 1:] / n[k] for k in (0, 1)]
    covs = [total[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    factors, offsets = [], []
    for k in (0, 1):
        share = max(POOLED, min(1.0, d / n[k]))  # few rows lean on the pooled one
        c = ((1 - share) * covs[k] + share * pooled) / np.outer(scale, scale)
        c = (1 - SPHERE) * c + SPHERE * max(np.trace(c) / d, LEAST_SPHERE) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / scale)
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Discriminant(means, factors, offsets)


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``vectors``; an empty table stays empty. Repeated
    rows are scored each, and count each where they are labelled."""
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), float).reshape(-1, len(FEATURES))))

    return features.select("doc_id", held_out().alias("held_out"), score("x").alias("score")).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; every column stays, whatever its name."""
    model = fit(vectors(docs), labels)  # also sets the batch size

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.where(score(text_or_empty()) >= THRESHOLD)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialize(vectors(table(spark, sf_dir, "documents")), "quality-vectors")
    return scored(features, fit(features, table(spark, sf_dir, "labels")))
