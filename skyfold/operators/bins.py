"""Time bins: fixed, sliding, daily, and month edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import col, micros

MINUTE = 60_000_000


def fixed_bin(time: str | Column, minutes: int) -> Column:
    """The start of the bin, counted from 1970."""
    size = minutes * MINUTE
    return F.timestamp_micros(F.floor(micros(time) / F.lit(size)) * size)


def sliding_bins(time: str | Column, every: int, period: int) -> Column:
    """An array with the starts of the bins [start, start + period) that hold the time; starts are `every` apart."""
    step, size = every * MINUTE, period * MINUTE
    us = micros(time)
    last = F.floor(us / F.lit(step))
    first = F.floor((us - size) / F.lit(step)) + 1
    return F.transform(F.sequence(first, last), lambda k: F.timestamp_micros(k * step))


def sliding_summary(df: DataFrame, by: list[str], time: str, every: int, period: int, **aggs: Column) -> DataFrame:
    """by, bin_start and aggs for each sliding bin that holds rows.  A row goes to period / every bins."""
    d = df.where(F.col(f"`{time}`").isNotNull()).withColumn("bin_start", F.explode(sliding_bins(time, every, period)))
    return d.groupBy(*by, "bin_start").agg(*[a.alias(k) for k, a in aggs.items()])


def day(time: str | Column) -> Column:
    return F.to_date(col(time).cast("timestamp"))


def month_edges(spark: SparkSession, start: str, end: str) -> DataFrame:
    """begin and stop (dates) of the months that [start, end) touches, held to it."""
    s, e = f"DATE'{start}'", f"DATE'{end}'"
    months = spark.sql(f"SELECT explode(sequence(date_trunc('MONTH', {s})::date, greatest({s}, date_sub({e}, 1)), interval 1 month)) AS m")
    out = months.select(F.greatest("m", F.expr(s)).alias("begin"), F.least(F.add_months("m", 1), F.expr(e)).alias("stop"))
    return out.where("begin < stop")
