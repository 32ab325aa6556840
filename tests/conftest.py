"""One session for all tests."""

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(df, con, sql: str) -> None:
    """Asserts equal columns by name and equal rows in any order, as the driver compares them."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in result.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert ours == theirs
