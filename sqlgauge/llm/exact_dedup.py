"""Exact duplicates by a tree merge of digest runs (DataFrame expressions only).

The task that reads a part of the corpus makes a run: one row for each digest, with the smallest identifier
and the number of rows. In rounds, ``fan_in`` neighbouring runs are merged into one (binomial rounds of three
steps for the default of 8), until one run is left. A run is dealt to tasks by its digests, so that the last
one is no single task either; a digest held by any share of the corpus has one row per run, and so at most
``fan_in`` rows in any merge. Keeping the smallest struct makes Spark sort and merge each run by its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm.common import SPACE, attach_spread, materialize, table, text_or_empty, with_place

#: Equal SHA-256 is checked at every level by the length and a second hash of the text.
DIGEST = ["text_sha256", "_bytes", "_check"]


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the digest of the normalised text (null: empty) and the row's place, written once."""
    text = F.regexp_replace(text_or_empty(), SPACE, " ")
    named = docs.select(F.col("doc_id"), text.alias("_text"))
    return materialize(with_place(named.select(
        "doc_id", F.sha2("_text", 256).alias("text_sha256"), F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_check"))), "digests")


def merged_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row for each digest: the row that stays (``_keep``) and how many rows there are."""
    # null identifiers come last, the place decides between rows with one identifier
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    runs = rows.groupBy(F.col("_part").alias("_run"), *DIGEST).agg(
        F.min(first).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    last = rows.agg(F.max("_part")).first()[0] or 0
    while last > 0:
        runs = runs.groupBy(F.floor(F.col("_run") / fan_in).alias("_run"), *DIGEST).agg(
            F.min("_keep").alias("_keep"), F.sum("group_size").alias("group_size"))
        last //= fan_in
    return runs.drop("_run")


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty and are equal to each other. Of rows with equal text the smallest ``doc_id``
    stays, a null one only where there is no other; of repeated rows with one ``doc_id`` exactly one is kept.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = digests(docs)
    groups = materialize(merged_runs(rows, fan_in), "digest-groups")
    out = attach_spread(rows, groups, DIGEST)
    return out.select("doc_id", F.col("_keep.id").alias("keep_id"), "group_size",
                      (F.col("_rid") == F.col("_keep.rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """``docs`` without the later copies; every column stays, whatever its name.

    The rows that stay are named by ``(doc_id, digest)``; where repeated rows share both, one of them stays.
    """
    text = F.regexp_replace(text_or_empty(), SPACE, " ")
    kept = exact_dedup(docs, fan_in).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), (F.col("group_size") > 1).alias("_copies"))
    rows = docs.select(F.struct("*").alias("_doc"), F.sha2(text, 256).alias("_mine"))
    met = rows.join(kept, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_sha")))
    alone = met.where(~F.col("_copies")).select("_doc.*")
    # of repeated rows with one identifier and one text, the first of a group
    again = met.where("_copies").groupBy("_id", "_sha").agg(F.first("_doc").alias("_doc")).select("_doc.*")
    return alone.unionByName(again)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
