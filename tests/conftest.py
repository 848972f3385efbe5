from __future__ import annotations

import glob
import os
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def plain(v):
    return "" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows_of_sql(c, sql):
    got = c.sql(sql)
    names = got.columns
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
