"""One local session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.local.dir", tmp).config("spark.checkpoint.dir", f"{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value that compares equal whichever engine it comes from."""
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql: str) -> None:
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        want = r.fetchall()
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        got = sorted(repr(tuple(plain(x) for x in row)) for row in df.collect())
        assert got == sorted(repr(tuple(plain(row[i]) for i in at)) for row in want)

    return check
