"""The training corpus: what its families write on their way does not stay."""

import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from sqlgauge import session
from sqlgauge.functions.text import prompt_key
from sqlgauge.plans import mutate as M
from sqlgauge.querybook import corpus, mutations
from sqlgauge.session import materialize_small, passing_tables, scratch_path
from sqlgauge.sources.exchange import attach_responses
from sqlgauge.sources.tables import write_by_task

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    return tmp_path / "shared" / "sqlgauge"


@pytest.fixture
def sf(spark, tmp_path):
    tables = {
        "orders": ([(k, k % 30, "FOP"[k % 3], date(2024, 1 + k % 12, 1), PRIORITIES[k % 5]) for k in range(300)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date, o_orderpriority string"),
        "customer": ([(k,) for k in range(30)], "c_custkey bigint"),
        "nation": ([(k,) for k in range(3)], "n_nationkey bigint"),
        "conversations": ([(c, t, r, f"text {c} {t}") for c in range(60) for t, r in enumerate(("user", "assistant"))],
                          "conv_id bigint, turn int, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    return str(tmp_path / "sf")


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_only_the_corpus_is_left_of_all_tables(spark, sf, shared):
    got = corpus.training_corpus(spark, sf).collect()
    assert {r["task"] for r in got} == {
        "clarify", "metric_reject", "constraint_ask", "multi_step", "reflection", "sql", "degenerate_dim", "dim_reject"}
    assert [r["n_rows"] for r in got if r["task"] == "sql"] == [300]
    assert [name.split("-")[0] for name in os.listdir(shared)] == ["corpus"]


def test_a_stored_table_leaves_no_shuffle_files(spark, shared):
    before = shuffle_files(spark)
    stored = materialize_small(spark.range(1000).repartition(4, "id"), "rows")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and stored.count() == 1000


def test_tables_written_on_the_way_go_and_kept_ones_stay(spark, shared):
    with passing_tables(spark) as keep:
        first = materialize_small(spark.range(5), "first")
        with passing_tables(spark) as keep_inside:
            second = keep_inside(materialize_small(first, "gone").withColumn("a", F.lit(1)), "second")
        assert second.count() == 5
        third = keep(second, "third")
    assert [name.split("-")[0] for name in os.listdir(shared)] == ["third"] and third.count() == 5
    with pytest.raises(ZeroDivisionError), passing_tables(spark):
        materialize_small(spark.range(5), "first")
        1 / 0
    assert len(os.listdir(shared)) == 1


def test_a_corpus_is_stored_family_by_family(spark, shared):
    rows = spark.createDataFrame([("a", "p", "1"), ("a", None, "2"), ("b", "p", "3"), ("b", "p", "3")],
                                 "task string, prompt string, answer string")
    path = scratch_path(spark, "corpus")
    for task in ("a", "b"):
        stored = write_by_task(rows.where(F.col("task") == task), path, "append")
    assert sorted(map(str, stored.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert sorted(d for d in os.listdir(path) if d.startswith("task=")) == ["task=a", "task=b"]


def test_rows_without_a_prompt_are_many_files(spark, shared):
    rows = spark.range(200).select(F.lit("a").alias("task"), F.lit(None).cast("string").alias("prompt"),
                                   F.col("id").cast("string").alias("answer"))
    name, path = "spark.sql.adaptive.coalescePartitions.enabled", scratch_path(spark, "corpus")
    spark.conf.set(name, "false")
    try:
        assert write_by_task(rows, path).count() == 200
    finally:
        spark.conf.unset(name)
    assert len([f for f in os.listdir(f"{path}/task=a") if f.endswith(".parquet")]) > 3


def test_replies_meet_rows_by_bytes_of_their_key(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None), (5, "r")], "id bigint, prompt string")
    keys = spark.createDataFrame([("p",), ("p",), ("r",)], "t string").select(
        prompt_key(F.col("t")).alias("prompt_key"), F.lit("y").alias("text"))
    other = spark.createDataFrame([(None, "no"), ("none-5", "no"), ("zz", "no"), ("", "no")], "prompt_key string, text string")
    upper = spark.createDataFrame([("q",)], "t string").select(F.upper(prompt_key(F.col("t"))), F.lit("no"))
    got = attach_responses(rows, F.col("prompt"), keys.union(other).union(upper))
    assert got.columns == ["id", "prompt", "reply"]
    assert sorted((r["id"], r["reply"]) for r in got.collect()) == [
        (1, "y"), (1, "y"), (2, "y"), (2, "y"), (3, None), (4, None), (5, "y")]


def test_steps_carry_only_what_later_steps_read(spark, sf, shared):
    stored = mutations.stored_seeds(spark, sf)
    replies = spark.createDataFrame([], "prompt_key string, text string")
    assert M.clarify_rewrites(stored, replies).columns == ["query", "question", "gaps", "r", "answered", "rewritten"]
    extracts = M.constraint_extracts(stored, replies)
    assert extracts.columns == ["query", "question", "gaps", "x"]
    whole, stepwise = (M.constraint_steps(rows, replies) for rows in (stored, extracts))
    assert whole.columns == stepwise.columns and sorted(map(str, whole.collect())) == sorted(map(str, stepwise.collect()))
