"""Causal features over a stream: the batch operators that look back only, as streaming aggregations with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import joined_set


def taxi_in_stream(events: DataFrame, by: str, at: str, value: str, every: int = 10, period: int = 30, late: str = "30 minutes") -> DataFrame:
    """by, bin_start, bin_end, n, mean: sliding bins of arrivals, emitted when no late row can still change them."""
    d = events.withWatermark(at, late)
    out = d.groupBy(F.col(by), F.window(at, f"{period} minutes", f"{every} minutes").alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(by, F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), "n", "mean")


def configuration_stream(events: DataFrame, by: str, at: str, runway: str, phase: str, departed: str, arrived: str, minutes: int = 30, late: str = "30 minutes") -> DataFrame:
    """by, bin_start and the runways in use, for each bin that has ended."""
    d = events.withWatermark(at, late)
    out = d.groupBy(F.col(by), F.window(at, f"{minutes} minutes").alias("w")).agg(
        joined_set(runway, F.col(phase) == departed).alias("dep_runways_in_use"), joined_set(runway, F.col(phase) == arrived).alias("arr_runways_in_use")
    )
    return out.select(by, F.col("w.start").alias("bin_start"), "dep_runways_in_use", "arr_runways_in_use")


def counts_stream(events: DataFrame, by: list[str], at: str, minutes: int, late: str = "30 minutes") -> DataFrame:
    """by, bin_start, n: rows in tumbling bins, from which windows before an anchor are summed."""
    d = events.withWatermark(at, late)
    out = d.groupBy(*[F.col(c) for c in by], F.window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("bin_start"), "n")
