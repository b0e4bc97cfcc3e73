"""Score completions as they arrive.

Every micro-batch goes to its own folder of the result table (run of the checkpoint, number
of the batch), written with overwrite, so a batch that is replayed after a failure replaces
itself and nothing else. Keys that this checkpoint has scored are held in Spark's state store,
spread by key: a batch looks up its own keys only, whatever was scored before. Results of other
checkpoints are listed once, when the stream starts, and joined only if there are any.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sqlgauge.functions.scores import format_reward, length_reward

Score = Callable[[DataFrame], DataFrame]


def basic_scores(rows: DataFrame) -> DataFrame:
    """The rewards that need nothing but the completion itself."""
    return rows.select("key", format_reward(F.col("content")).alias("format_reward"),
                       length_reward(F.col("n_tokens")).alias("length_reward"))


def completion_stream(spark: SparkSession, path: str, schema: StructType,
                      files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """New parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _scored_elsewhere(spark: SparkSession, out: str, run: str) -> DataFrame | None:
    """Keys in the results of other checkpoints, None if there are none."""
    try:
        done = spark.read.schema("key string, run string, batch bigint").parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    others = done.filter(F.col("run") != run).select("key")
    return None if others.isEmpty() else others


def score_stream(completions: DataFrame, out: str, checkpoint: str, score: Score = basic_scores,
                 once_per_key: bool = True) -> StreamingQuery:
    """Score everything available now, append to ``out`` and stop. Run again for more.

    With ``once_per_key`` streams of different checkpoints write to one ``out`` one after the other, not at once.
    """
    run = "r" + sha256(checkpoint.encode()).hexdigest()[:16]
    if once_per_key:
        elsewhere = _scored_elsewhere(completions.sparkSession, out, run)
        if elsewhere is not None:
            completions = completions.join(elsewhere, "key", "left_anti")
        completions = completions.dropDuplicates(["key"])

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    return (
        completions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
