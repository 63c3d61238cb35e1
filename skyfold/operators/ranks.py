"""Running sums and ranks over a whole table, without a task that sees the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def running_total(df: DataFrame, order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """df with the sum of amount up to and with each row, in an order without ties.

    Rows are dealt into ranges of the order, which are sorted and summed apart; each range begins at the sum of those
    before it.  The driver gets one number for each range, as many as there are shuffle partitions.
    """
    d = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    d = stored(d.withColumn("_amount", amount.cast("long")), "ranges")
    sums = sorted((r[0], r[1]) for r in d.groupBy("_range").agg(F.sum("_amount")).collect())
    before = [0, *accumulate(s for _, s in sums)]
    starts = d.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sums, before)], "_range int, _start long")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(starts, "_range").withColumn(name, F.col("_start") + F.sum("_amount").over(inside)).drop("_range", "_start", "_amount")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with each row's place in the order, from 1."""
    return running_total(df, order, F.lit(1), name)
