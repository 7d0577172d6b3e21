import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from candidata.cluster import local_session

    session = local_session(8, "candidata-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression on one row of data."""

    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(
            *[F.lit(v).alias(k) if not isinstance(v, tuple) else F.expr(v[0]).alias(k) for k, v in values.items()]
        )
        return row.select(column.alias("x")).first()["x"]

    return evaluate
