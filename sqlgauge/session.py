"""Session helpers: local test session and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "sqlgauge") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="sqlgauge-")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


#: Folder of the tables written now, below ``sqlgauge``; see ``passing_tables``.
_PASSING: ContextVar[str] = ContextVar("passing", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sqlgauge/{_PASSING.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted on leaving: what comes of them must be stored outside.

    Gives a ``materialize_small`` that stores outside; a path made outside is another way.
    """
    outside = _PASSING.get()
    folder = f"{outside}passing-{uuid.uuid4().hex}/"

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _PASSING.set(outside)
        try:
            return materialize_small(df, name)
        finally:
            _PASSING.reset(inside)

    token = _PASSING.set(folder)
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sqlgauge/{folder}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside are deleted when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_small(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` where disk is what runs out: a smaller table, and no shuffle files left behind."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer files than cores over all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that ``dealt`` gives to a task.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A stored table dealt by keys to as many tasks as its rows need, so a task holds no more when the table grows."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are worked out once a row, however many filters and columns after it use them.

    A plain column is put into each place that names it. An array of one row that is unnested is not.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[
        c.alias(name) for name, c in columns.items()]))))
