from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="gleaner-tests")
    yield s
    s.stop()


def one(spark, expr_col, value, schema="x string"):
    """Evaluate a column expression on a single-row DataFrame with column x."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("r")).collect()[0]["r"]


def many(spark, expr_col, values, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["r"] for r in df.orderBy("i").select(expr_col.alias("r")).collect()]
