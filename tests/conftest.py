from __future__ import annotations

import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(folder / "local"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value that compares equal whether Spark or DuckDB made it."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.12g}")
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="session")
def tables():
    """DuckDB over the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    folder = Path(DATA) / "sf0.001"
    if not folder.is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con, str(folder)


@pytest.fixture
def same_as_sql(spark, tables):
    con, folder = tables

    def check(query, sql):
        got = query(spark, folder)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        got_rows, want_rows = rows(got.columns, got.collect()), rows(names, want.fetchall())
        assert len(got_rows) == len(want_rows)
        assert got_rows == want_rows

    return check
