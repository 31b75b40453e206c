"""One local session for all tests."""

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, values):
    """Rows with columns by name, in an order of their own."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        return float(x) if x.__class__.__name__ == "Decimal" else tuple(x) if isinstance(x, list) else x

    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        got = query(spark, SF)
        want = duck.execute(sql)
        assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())

    return check
