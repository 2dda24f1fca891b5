from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from weblode.session import build_session

    session = build_session(
        "weblode-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__adaptive__coalescePartitions__initialPartitionNum="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """``rows(data, schema)`` makes a DataFrame; ``rows.one(col, **values)`` evaluates a column on one row."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make


def column(spark, values, build, kind="string"):
    """Evaluate ``build(F.col("x"))`` for each value, in order."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.select(build(F.col("x")).alias("y"), "i").orderBy("i").collect()]
