import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from factlake.session import get_spark
    s = get_spark("local[4]", app="factlake-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def col_values(df, col):
    return [r[col] for r in df.collect()]


def one(spark, expr_fn, value, schema="x string"):
    """Evaluate a Column function on a one-row frame."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_fn("x").alias("y")).first()["y"]
