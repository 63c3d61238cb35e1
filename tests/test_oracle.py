"""Every registered query against its SQL, over the driver's smallest tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, decimal.Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    want = result.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    rows = sorted(tuple(shown(x) for x in r) for r in got.collect())
    assert rows == sorted(tuple(shown(r[i]) for i in order) for r in want)
    assert rows


@pytest.mark.parametrize("name", ["m3_train_predict"])
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_union_whole(spark):
    n = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("nation", "customer"))
    assert entry.queries()["s1_union_relaxed"](spark, SF).count() == n


def test_days_whole(spark):
    """Every movement and every order is in its day's totals."""
    from pyspark.sql import functions as F

    from skyfold.plans.surrogate import movements

    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert entry.queries()["d27_daily_state"](spark, SF).agg(F.sum("daily_departures")).first()[0] == orders
    days = movements(spark, SF).where("phase = 'DEP' AND apt IS NOT NULL").groupBy("apt", F.to_date("ts")).count()
    assert entry.queries()["d13_airport_state"](spark, SF).agg(F.sum("daily_departures")).first()[0] == days.agg(F.sum(F.col("count") * F.col("count"))).first()[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
