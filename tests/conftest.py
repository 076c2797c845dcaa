import os
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(pdf):
    """Rows as comparable text, columns by name, missing values alike."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):  # a column of whole numbers with missing ones comes as floats from one side
            return int(v) if v.is_integer() else round(v, 6)
        return v.item() if hasattr(v, "item") else v

    cols = sorted(pdf.columns)
    return sorted(repr([plain(v) for v in r]) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


def same_as_sql(spark, duck, query, sql):
    got, expected = query(spark, DATA).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
