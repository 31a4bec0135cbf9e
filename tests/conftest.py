import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": f"{shared}/warehouse",
        "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in SF.iterdir():
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{where}'")
    return con


def plain(v):
    """A value as engines agree on it."""
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def compare(df, con, sql):
    """Rows of both engines, columns by name, as sorted texts."""
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cur.fetchall())
    assert got == want
    return len(got)
