"""Queries that score completions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.registry import query, rounded, table
from sqlgauge.querybook.rewards import _ROWS
from sqlgauge.session import scratch_path
from sqlgauge.streaming.scoring import completion_stream, score_stream


def _long(df: DataFrame) -> DataFrame:
    return I.as_completions(df).withColumn("n_tokens", F.col("n_tokens") * 20)


def _scores(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).select("key", "format_reward", rounded("length_reward").alias("length_reward"))


_BATCH = f"WITH {_ROWS} SELECT key, format_reward, round(length_reward, 6) AS length_reward FROM s"


@query("stream_scores", "Y1", _BATCH)
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations table, one file or a folder of them, read as a stream of files."""
    schema = table(spark, sf, "conversations").schema
    # a pattern may name a file or a folder, a plain path of a stream only a folder
    arriving = _long(completion_stream(spark, f"{sf}/conversations.parque[t]", schema))
    out = scratch_path(spark, "scores")
    score_stream(arriving, out, scratch_path(spark, "stream"), once_per_key=False).awaitTermination()
    return _scores(spark, out)


@query("stream_scores_once", "Y2", _BATCH)
def stream_scores_once(spark: SparkSession, sf: str) -> DataFrame:
    """Three drops that overlap, scored in two runs: every key is scored once."""
    talks = table(spark, sf, "conversations")
    drops, out, progress = (scratch_path(spark, n) for n in ("drops", "scores", "stream"))
    schema = talks.schema

    def run() -> None:
        arriving = _long(completion_stream(spark, f"{drops}/*", schema, files_per_batch=8))
        score_stream(arriving, out, progress).awaitTermination()

    talks.filter("turn < 2").write.parquet(f"{drops}/first")
    run()
    talks.filter("turn < 4").write.parquet(f"{drops}/second")
    talks.write.parquet(f"{drops}/third")
    run()
    return _scores(spark, out)
