"""Read and write corpus tables with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.session import passing_shuffles


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SEED_SCHEMA = _text("query", "response", "index_name")
EXAMPLE_SCHEMA = _text("original_question", "response")
EVALUATION_SCHEMA = _text("query", "response", "answer", "type")

# Quoted line ends and doubled quotes stay inside their field.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


class MissingColumns(ValueError):
    """The input lacks columns that later steps need."""


def read_corpus(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                required: Sequence[str] = ()) -> DataFrame:
    """Read a corpus table; fields missing in the files are null unless required."""
    if fmt == "csv":
        found = spark.read.options(**CSV_OPTIONS).csv(path).columns
        by_position = _text(*found)
        raw = spark.read.options(**CSV_OPTIONS).schema(by_position).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return conform(raw, schema, required)


def conform(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Select the fields of ``schema`` with their types; fail early on missing required ones."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def read_seeds(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_corpus(spark, path, SEED_SCHEMA, fmt, required=("query", "response"))


def read_examples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_corpus(spark, path, EXAMPLE_SCHEMA, fmt, required=EXAMPLE_SCHEMA.names)


def read_evaluation(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_corpus(spark, path, EVALUATION_SCHEMA, fmt, required=("query",))


def append_rows(df: DataFrame, path: str) -> None:
    """Append a batch of finished rows; an empty batch writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def write_by_task(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Store a corpus in one folder for each task, and read it back: a reader of one task opens that folder only.

    Rows are dealt to files by task and prompt (those without one by all they hold), so a task that holds most rows
    is many files. With mode ``append`` a corpus can be stored family by family.
    """
    spark = df.sparkSession
    row = F.when(F.col("prompt").isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64("prompt"))
    dealt = df.repartition("task", row)
    with passing_shuffles(spark):
        dealt.write.mode(mode).option("compression", "zstd").partitionBy("task").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_annotated(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an annotated table. Row order is the ``row_id`` column, not the file order."""
    if "row_id" not in df.columns:
        raise MissingColumns("missing columns: row_id")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(fmt).save(path)
