"""One training corpus over the rows of all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.plans import mutate as M
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook import mutations, statements
from sqlgauge.querybook.mutations import _CLARIFY, _CONSTRAINT, _REJECT, _SWAP
from sqlgauge.querybook.registry import ORACLES, query
from sqlgauge.session import passing_tables, scratch_path
from sqlgauge.sources.tables import write_by_task


def _counted(task: str, source: str, rows: str, status: str, reasoned: str, where: str = "true") -> str:
    return (f"SELECT '{task}' AS task, '{source}' AS source, {status} AS status, count(*) AS n_rows, "
            f"count({reasoned}) AS n_reasoned FROM {rows} WHERE {where} GROUP BY ALL")


_GIVEN = " UNION ALL ".join(_counted(t, "given", "completions", "'ok'", "CASE WHEN form = 0 OR form = 2 OR form = 5 THEN 1 END",
                                     f"task = '{t}'") for t in ("degenerate_dim", "dim_reject"))


@query("training_corpus", "M7", f"""
WITH {I.SECTIONED}, {_CLARIFY}, {_SWAP}, {_REJECT}, {_CONSTRAINT}, {I.COMPLETIONS},
counted AS ({_counted('clarify', 'mutation', 'clarified', 'status', 'cot_process', "status = 'ok'")}
UNION ALL {_counted('metric_reject', 'mutation', 'rejected', 'status', 'cot_process', "status = 'ok'")}
UNION ALL {_counted('constraint_ask', 'mutation', 'constrained', 'status', 'cot_process', "status IN ('success', 'skip', 'cannot_extract')")}
UNION ALL {_counted('multi_step', 'mutation', f"({ORACLES['multi_step_rows']})", 'status', 'cot_process', "status = 'ok'")}
UNION ALL {_counted('reflection', 'mutation', f"({ORACLES['reflection_rows']})", "'ok'", 'reflection_process')}
UNION ALL {_counted('sql', 'seed', 'seeds', "'ok'", "CASE WHEN state = 'O' THEN 1 END")}
UNION ALL {_GIVEN}) SELECT * FROM counted""")
def training_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all eight tasks, stored by task; how many there are, and how many tell their reasoning.

    The corpus is stored family by family, those with the largest tables first: what a family writes on its way
    is gone before the next one begins.
    """
    path = scratch_path(spark, "corpus")
    completions = I.completions(spark, sf).select(
        "task", F.col("prompt_id").cast("string").alias("prompt"), F.col("gold").alias("answer"),
        F.nullif(M.first_think(F.col("content")), F.lit("")).alias("reasoning"))
    with passing_tables(spark):
        seeds = mutations.stored_seeds(spark, sf)
        families = {
            "constraint_ask": lambda: M.finished_constraints(mutations.constrained(seeds)),
            "reflection": lambda: statements.reflected(spark, sf, seeds),
            "clarify": lambda: mutations.clarified(seeds).where("status = 'ok'"),
            "metric_reject": lambda: mutations.rejected(seeds).where("status = 'ok'"),
            "multi_step": lambda: statements.stepped(spark, sf, seeds).where("status = 'ok'"),
        }
        for task, made in families.items():
            with passing_tables(spark):
                write_by_task(M.training_corpus({task: made()}), path, "append")
        stored = write_by_task(M.training_corpus({}, M.seed_rows(seeds), M.given_rows(completions)), path, "append")
    return stored.groupBy("task", "source", "status").agg(
        F.count("*").alias("n_rows"), F.count("reasoning").alias("n_reasoned"))
