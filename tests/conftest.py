import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(columns, data):
    return sorted(repr([None if v != v else v for v in (dict(zip(columns, r, strict=True))[c] for c in sorted(columns))]) for r in data)


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with a SQL query, whatever the order of rows and columns."""

    def check(df, sql):
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, rel.fetchall())

    return check
