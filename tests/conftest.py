import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", f"file://{base}/warehouse")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


@pytest.fixture(scope="session")
def agree(spark, duck, sf):
    """Run a query and its SQL and compare columns, types and rows."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}

    def check(query, sql):
        df, found = query(spark, sf), duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        types = dict(zip(found.columns, map(str, found.types)))
        assert {c: kinds[t] for c, t in df.dtypes} == types
        own = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
        assert own == sorted(found.select(*[f'"{c}"' for c in columns]).fetchall(), key=_key)

    return check
