"""Token ids of whole texts by a public tokenizer, and exact length histograms."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm.common import materialize, table, whole_texts

#: Lengths summed in one window.
SPAN = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The tokens as bytes. The vocabulary writes a byte as a character: itself where that can be printed, else
    the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


class Encoder:
    """Ids as little-endian unsigned 32-bit values.

    ``path`` is a file of the tokenizers library: a byte-level BPE whose ids are in the order of its merges. The
    ids come from tiktoken with the same vocabulary and splits; a text on which its splitter gives up (a million
    blanks in a row) goes to the tokenizers library, which is slower and has no such limit.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=_ranks(vocabulary), special_tokens=special)

    def _one(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def batches_of_text(texts, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` characters each, so that ids of few texts are held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row; null texts count as empty, with no token."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [len(ids) // 4 for s, e in batches_of_text(texts) for ids in encoder(path).encode(texts[s:e])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": pd.Series(n, dtype="int64")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole_texts(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length; whatever a context limit asks for is in the row of the largest length
    up to it.

    ``n_docs`` of this length; ``docs_up_to`` and ``tokens_up_to``: documents not longer; ``docs_over`` longer;
    ``truncated_total``: tokens left if every document is cut to this length; ``share_up_to``: the quantile.
    An empty table gives no rows. Documents are counted per length first; suffix sums are made inside spans of
    lengths, and over the spans, so no window holds more than ``SPAN`` lengths or one row per span.
    """
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = materialize(counts.withColumn("_span", F.floor(F.col("length") / SPAN)), "token-lengths")
    tokens = F.col("n_docs") * F.col("length")
    spans = counts.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    over = Window.orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spans = spans.select(
        "_span", F.coalesce(F.sum("_d").over(over), F.lit(0)).alias("_d_over"),
        F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t_over"),
        F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("_tokens"))
    inside = Window.partitionBy("_span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = counts.join(spans, "_span")
    h = h.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("_d_over"))
    h = h.withColumn("_longer", F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("_t_over"))
    return h.select(
        "length", "n_docs", (F.col("_docs") - F.col("docs_over")).alias("docs_up_to"),
        (F.col("_tokens") - F.col("_longer")).alias("tokens_up_to"), "docs_over",
        (F.col("_tokens") - F.col("_longer") + F.col("docs_over") * F.col("length")).alias("truncated_total"),
        ((F.col("_docs") - F.col("docs_over")) / F.col("_docs")).alias("share_up_to"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
