"""Aggregates: errors, shares, percentiles, correlations, sets and best rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col
from .ranks import running_total


def rmse(pred, truth) -> Column:
    d = col(pred).cast("double") - col(truth)
    return F.sqrt(F.avg(d * d))


def mae(pred, truth) -> Column:
    return F.avg(F.abs(col(pred).cast("double") - col(truth)))


def bias(pred, truth) -> Column:
    return F.avg(col(pred).cast("double") - col(truth))


def median_abs_error(pred, truth) -> Column:
    return F.median(F.abs(col(pred).cast("double") - col(truth)))


def share(condition: Column) -> Column:
    """The mean of a boolean; rows where it is null don't count."""
    return F.avg(condition.cast("double"))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and for each column the share of rows that have it."""
    return df.agg(F.count("*").alias("n"), *[share(F.col(f"`{c}`").isNotNull()).alias(c) for c in columns])


def percentile_linear(c, q: float) -> Column:
    """Exact, with linear interpolation between neighbours."""
    return F.percentile(col(c), F.lit(q))


def nearest_percentiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """by and the values at rank round(q (n - 1)), halves rounded up: a member of the data, not an interpolation.

    Distinct values are counted first.  One running sum over all of them, by group and value, finds the ranks: neither a
    large group nor the whole table meets in a task.  Without groups and values there is one row of nulls.
    """
    own = [f"_g{i}" for i in range(len(by))]
    groups = [F.col(f"`{c}`").alias(g) for c, g in zip(by, own, strict=True)]
    counts = df.where(F.col(f"`{value}`").isNotNull()).groupBy(*groups, F.col(f"`{value}`").alias("_v")).agg(F.count("*").alias("_n"))
    counts = running_total(counts, [*[F.col(g).asc_nulls_first() for g in own], F.col("_v").asc()], F.col("_n"), "_end")
    sums = counts.groupBy(*own).agg(F.min(F.col("_end") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    on = F.lit(True)
    for g in own:
        on = on & F.col(g).eqNullSafe(F.col(f"_r{g}"))
    right = sums.select(*[F.col(g).alias(f"_r{g}") for g in own], "_start", "_all")
    rank = lambda q: F.floor((F.col("_all") - 1) * q + 0.5)
    at = F.col("_end") - F.col("_start")
    found = counts.join(right, on) if by else counts.withColumns({c: sums.select(c).scalar() for c in ("_start", "_all")})
    out = found.groupBy(*own).agg(*[F.min(F.when(at > rank(q), F.col("_v"))).alias(k) for k, q in points.items()])
    return out.select(*[F.col(g).alias(c) for g, c in zip(own, by, strict=True)], *points)


def pearson(x, y) -> Column:
    """Correlation over rows that have both; null without variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def joined_set(c, where: Column, sep: str = "+") -> Column:
    """The distinct values of the rows that fit, sorted and joined; empty if there are none."""
    return F.concat_ws(sep, F.sort_array(F.collect_set(F.when(where, col(c)))))


def mean_where(c, where: Column) -> Column:
    return F.avg(F.when(where, col(c)))


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each group: the first by order (total, for a fixed result)."""
    groups = [F.col(f"`{c}`") for c in by]
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def best_of(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row of least score for each group, ties by the tie columns.  Summed up within tasks before the shuffle."""
    groups = [F.col(f"`{c}`") for c in by]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = F.struct(F.col(f"`{score}`"), *[F.col(f"`{c}`") for c in tie])
    best = df.where(F.col(f"`{score}`").isNotNull()).groupBy(*groups).agg(F.min_by(row, order).alias("_row"))
    return best.select("_row.*")


def counts_by_type(df: DataFrame, by: str, kind: str, kinds: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """A row for each of the groups and a column for each of the kinds: counts, 0 where there are none."""
    counts = df.where(F.col(kind).isin(*kinds)).groupBy(by).pivot(kind, list(kinds)).count()
    every = df.sparkSession.createDataFrame([(g,) for g in groups], f"`{by}` string")
    return every.join(counts, by, "left").na.fill(0, list(kinds))
