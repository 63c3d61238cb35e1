"""The unimpeded reference: a low percentile of clean times by group, with validity and fallback levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import share
from .movements import NAMES, Names
from .registry import makes

QUANTILE, LONGEST, LEAST_BELOW = 0.10, 7200, 10


def levels(n: Names = NAMES) -> dict[str, list[str]]:
    """From the most specific to the least."""
    return {"apt_stand_rwy": [n.airport, n.stand, n.runway], "apt_stand": [n.airport, n.stand], "apt_rwy": [n.airport, n.runway], "apt": [n.airport]}


def clean(df: DataFrame, n: Names = NAMES, longest: float = LONGEST) -> DataFrame:
    """Departures with a time above 0 and up to the longest."""
    return df.where((F.col(n.phase) == n.departed) & (F.col(n.taxi) > 0) & (F.col(n.taxi) <= longest))


def level_reference(df: DataFrame, keys: Sequence[str], value: str, quantile: float = QUANTILE, least_below: int = LEAST_BELOW) -> DataFrame:
    """keys, p10, n and valid: at least so many rows at or below the percentile.

    Values are counted by group first.  The percentile goes back to the counts, so that no row gathers a group's values.
    """
    groups = [F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    own = [f"_g{i}" for i in range(len(keys))]
    sums = counts.groupBy(*own).agg(F.expr(f"percentile(_v, {quantile}D, _n)").alias("p10"), F.sum("_n").alias("n"))
    on = F.lit(True)
    for c in own:
        on = on & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    right = sums.select(*[F.col(c).alias(f"_r{c}") for c in own], "p10", "n")
    held = counts.join(right, on).groupBy(*own, "p10", "n").agg(F.sum(F.when(F.col("_v") <= F.col("p10"), F.col("_n")).otherwise(0)).alias("_below"))
    return held.select(*[F.col(c).alias(k) for c, k in zip(own, keys, strict=True)], "p10", "n", (F.col("_below") >= least_below).alias("valid"))


def fit_reference(df: DataFrame, n: Names = NAMES, quantile: float = QUANTILE, least_below: int = LEAST_BELOW, longest: float = LONGEST) -> dict[str, DataFrame]:
    rows = clean(df, n, longest)
    return {name: level_reference(rows, keys, n.taxi, quantile, least_below) for name, keys in levels(n).items()}


@makes("geometry", "reference_sec", "reference_level", "reference_sample")
def apply_reference(df: DataFrame, tables: dict[str, DataFrame], n: Names = NAMES) -> DataFrame:
    """df with reference_sec and reference_level of the most specific valid level, and the finest level's sample size.

    Without a valid level: null and 'none'.  Null keys match no group.
    """
    d, keys_of = df, levels(n)
    for name in tables:
        t = tables[name].select(*[F.col(k).alias(f"_{name}_{i}") for i, k in enumerate(keys_of[name])], F.expr("CASE WHEN valid THEN p10 END").alias(f"_{name}_p"), F.col("n").alias(f"_{name}_n"))
        on = F.lit(True)
        for i, k in enumerate(keys_of[name]):
            on = on & (F.col(k) == F.col(f"_{name}_{i}"))
        d = d.join(t, on, "left")
    level = F.coalesce(*[F.when(F.col(f"_{name}_p").isNotNull(), F.lit(name)) for name in tables], F.lit("none"))
    finest = next(iter(tables))
    d = d.withColumn("reference_level", level)
    d = d.withColumn("reference_sec", F.coalesce(*[F.col(f"_{name}_p") for name in tables]).cast("float"))
    d = d.withColumn("reference_sample", F.coalesce(F.col(f"_{finest}_n"), F.lit(0)))
    return d.drop(*[c for c in d.columns if any(c.startswith(f"_{name}_") for name in tables)])


def coverage(df: DataFrame, official: str = "apt_stand_rwy", n: Names = NAMES) -> DataFrame:
    """By airport: rows, the share with the official level, and the share with a fallback."""
    level = F.col("reference_level")
    return df.groupBy(n.airport).agg(
        F.count("*").alias("n"),
        share(level == official).alias("official_share"),
        share(level != official).alias("fallback_share"),
    )
