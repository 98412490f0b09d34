import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def same(df, cursor):
    """Rows of a DataFrame and of a DuckDB cursor, without order."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        return tuple(map(plain, v)) if isinstance(v, list | tuple) else v

    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="session")
def compare(spark, duck):
    return lambda run, sql: same(run(spark, SF), duck.execute(sql))
