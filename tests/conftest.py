import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from sqlgauge.session import local_session

    return local_session(app="sqlgauge-tests")


@pytest.fixture
def evaluate(spark):
    """Value of an expression over one row of text columns."""
    from pyspark.sql import functions as F

    def run(build, *texts):
        schema = ", ".join(f"c{i} string" for i in range(len(texts))) or "c0 string"
        df = spark.createDataFrame([tuple(texts) or (None,)], schema)
        return df.select(build(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return run
