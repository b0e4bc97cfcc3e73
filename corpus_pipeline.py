"""A training-data pipeline over ``documents``: good documents, no copies, no near copies, mixed, packed.

Each stage takes all that the stage before kept, and returns the columns of ``documents``; the last one returns
the places of the pieces in training sequences. Stage results are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlgauge.llm import exact_dedup, mixing, packing, quality, simhash
from sqlgauge.llm.common import materialize, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents it is given."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each use of a document, in training order; a document's text is cut where its source's
    target ends."""
    return mixing.training_order(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Tokens and SimHashes are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
