from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    """A value as comparable text: numbers to six places, midnight without its time."""
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v) + 0.0:.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v).removesuffix(" 00:00:00")


def same_rows(df, relation) -> None:
    cols = sorted(df.columns)
    assert sorted(relation.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert len(got) == len(want)
    assert got == want
