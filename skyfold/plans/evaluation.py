"""Seasonal split, evaluation, diagnostics and regime analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import micros, seconds_between
from ..operators.aggregates import bias, counts_by_type, mae, mean_where, median_abs_error, nearest_percentiles, pearson, rmse, share
from . import reference
from .movements import HOLDOUT_AIRPORTS, NAMES, Names, model_columns

WINTER, SUMMER = (12, 1, 2), (6, 7, 8)


def holdout(n: Names = NAMES, full: int = 1, part: int = 7, airports: Sequence[str] = HOLDOUT_AIRPORTS) -> Column:
    """One month at every airport, another at some.  Null (an unknown time or airport) is neither side."""
    m = F.month(n.moved)
    return (m == full) | ((m == part) & F.col(n.airport).isin(*airports))


@dataclass(frozen=True)
class Split:
    fit: DataFrame
    held: DataFrame
    columns: list[str]


def seasonal_split(features: DataFrame, movements: DataFrame, longest: float | None = None, n: Names = NAMES, mask: Column | None = None) -> Split:
    """Rows with a target by the mask; the reference is fitted on the training side's movements alone.

    longest: drops longer targets from training only.
    """
    mask = holdout(n) if mask is None else mask
    rows = features.where(F.col(n.taxi).isNotNull())
    tables = reference.fit_reference(movements.where(~mask), n)
    fit = rows.where(~mask)
    if longest is not None:
        fit = fit.where(F.col(n.taxi) <= longest)
    fit, held = reference.apply_reference(fit, tables, n), reference.apply_reference(rows.where(mask), tables, n)
    return Split(fit, held, model_columns(fit, n))


def evaluate(scored: DataFrame, pred: str, truth: str, at: str, airport: str, months: Sequence[int] = (1, 7)) -> DataFrame:
    """scope, key, n, rmse: in total, for each of the months that occurs, and for each airport, in one pass."""
    m = F.month(at)
    cells = F.array(
        F.struct(F.lit("total").alias("scope"), F.lit("").alias("key")),
        F.struct(F.lit("month").alias("scope"), F.when(m.isin(*months), m.cast("string")).alias("key")),
        F.struct(F.lit("airport").alias("scope"), F.coalesce(F.col(airport).cast("string"), F.lit("none")).alias("key")),
    )
    d = scored.withColumn("_cell", F.explode(cells)).where("_cell.key IS NOT NULL")
    return d.groupBy(F.col("_cell.scope").alias("scope"), F.col("_cell.key").alias("key")).agg(F.count("*").alias("n"), rmse(pred, truth).alias("rmse"))


# Diagnostics


def schema_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that only the left has, and only the right."""
    return [c for c in left.columns if c not in right.columns], [c for c in right.columns if c not in left.columns]


def check_identity(df: DataFrame, n: Names = NAMES) -> DataFrame:
    """How often take-off less off-block is the taxi time, within a second."""
    d = df.where(F.col(n.phase) == n.departed)
    off = F.abs(seconds_between(n.moved, n.block) - F.col(n.taxi))
    whole = F.col(n.moved).isNotNull() & F.col(n.block).isNotNull() & F.col(n.taxi).isNotNull()
    return d.agg(F.count("*").alias("n"), F.count_if(whole).alias("n_complete"), share(off < 1).alias("exact_match"), F.max(off).alias("max_abs_diff"))


def check_precision(df: DataFrame, by: str, n: Names = NAMES) -> DataFrame:
    """By airport, the shares of times on a whole minute."""
    zero = lambda c: share(F.second(c).cast("int") == 0)
    return df.where(F.col(n.phase) == n.departed).groupBy(by).agg(F.count("*").alias("n"), zero(n.moved).alias("moved_on_minute"), zero(n.block).alias("block_on_minute"))


def check_match(df: DataFrame, by: str, columns: dict[str, str], n: Names = NAMES) -> DataFrame:
    """By airport, the share of departures that have each column (new name: column), of those in the table."""
    there = {k: c for k, c in columns.items() if c in df.columns}
    return df.where(F.col(n.phase) == n.departed).groupBy(by).agg(F.count("*").alias("n"), *[share(F.col(c).isNotNull()).alias(k) for k, c in there.items()])


def check_predictor(df: DataFrame, start: str, by: str | None = None, n: Names = NAMES) -> DataFrame:
    """Errors of take-off less start as the taxi time, over all departures or by airport."""
    d = df.where((F.col(n.phase) == n.departed) & F.col(n.taxi).isNotNull() & F.col(start).isNotNull() & F.col(n.moved).isNotNull())
    d = d.withColumn("_naive", seconds_between(n.moved, start))
    aggs = [F.count("*").alias("n"), rmse("_naive", n.taxi).alias("rmse"), bias("_naive", n.taxi).alias("bias")]
    if by:
        return d.groupBy(by).agg(*aggs)
    return d.agg(*aggs, mae("_naive", n.taxi).alias("mae"), median_abs_error("_naive", n.taxi).alias("median_abs_error"))


def check_target(df: DataFrame, by: str, n: Names = NAMES) -> DataFrame:
    """By airport: n, mean, std, p10 and p99 (members of the data), median, and the shares above two hours and below 0."""
    d = df.where((F.col(n.phase) == n.departed) & F.col(n.taxi).isNotNull())
    t = F.col(n.taxi)
    base = d.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.median(t).alias("p50"), share(t > 7200).alias("over_120min_share"), share(t < 0).alias("negative_share")
    )
    points = nearest_percentiles(d, [by], n.taxi, {"p10": 0.10, "p99": 0.99})
    return base.join(points.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def target_by_month(df: DataFrame, n: Names = NAMES) -> DataFrame:
    d = df.where((F.col(n.phase) == n.departed) & F.col(n.taxi).isNotNull())
    return d.groupBy(F.month(n.moved).alias("month_num")).agg(F.count("*").alias("n"), F.avg(n.taxi).alias("mean"), F.stddev_samp(n.taxi).alias("std"))


def baselines(df: DataFrame, by: str, combo: Sequence[str], mask: Column, n: Names = NAMES) -> DataFrame:
    """Errors on the held-out side of the global, airport's and combination's training means."""
    d = df.where((F.col(n.phase) == n.departed) & F.col(n.taxi).isNotNull())
    fit, held = d.where(~mask), d.where(mask)
    overall = fit.agg(F.avg(n.taxi)).scalar()
    apt = fit.groupBy(F.col(by).alias("_by")).agg(F.avg(n.taxi).alias("_apt"))
    cells = fit.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(combo)]).agg(F.avg(n.taxi).alias("_combo"))
    on = F.lit(True)
    for i, c in enumerate(combo):
        on = on & (F.col(c) == F.col(f"_c{i}"))
    s = held.join(apt, F.col(by) == F.col("_by"), "left").join(cells, on, "left").withColumn("_all", overall)
    return s.agg(
        F.count("*").alias("n_validation"),
        share(F.col("_combo").isNotNull()).alias("combo_coverage"),
        rmse("_all", n.taxi).alias("rmse_global_mean"),
        rmse("_apt", n.taxi).alias("rmse_airport_mean"),
        rmse(F.coalesce("_combo", "_apt"), n.taxi).alias("rmse_combo_mean"),
    )


def cold_start(train: DataFrame, rank: DataFrame, combo: Sequence[str], nulls: dict[str, str]) -> DataFrame:
    """n, the share of rows whose combination was trained on, and the share without each of the columns."""
    seen = train.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(combo)]).agg(F.lit(1).alias("_seen"))
    on = F.lit(True)
    for i, c in enumerate(combo):
        on = on & (F.col(c) == F.col(f"_c{i}"))
    d = rank.join(seen, on, "left")
    return d.agg(F.count("*").alias("n"), share(F.col("_seen").isNotNull()).alias("seen_combo_share"), *[share(F.col(c).isNull()).alias(k) for k, c in nulls.items()])


def check_schedule(df: DataFrame, n: Names = NAMES) -> DataFrame:
    """The departure delay's distribution, and the errors of take-off less schedule as the taxi time."""
    d = df.where((F.col(n.phase) == n.departed) & F.col(n.taxi).isNotNull() & F.col(n.scheduled).isNotNull() & F.col(n.block).isNotNull())
    d = d.withColumn("_delay", seconds_between(n.block, n.scheduled)).withColumn("_naive", seconds_between(n.moved, n.scheduled))
    base = d.agg(
        F.count("*").alias("n"), F.avg("_delay").alias("mean"), F.stddev_samp("_delay").alias("std"), F.median("_delay").alias("p50"),
        share(F.col("_delay") < 0).alias("early_share"), rmse("_naive", n.taxi).alias("rmse"), bias("_naive", n.taxi).alias("bias"),
    )
    points = nearest_percentiles(d, [], "_delay", {"p10": 0.10, "p90": 0.90})
    return base.withColumn("_one", F.lit(1)).join(points.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


# Weather regimes and event coverage


def monthly_weather(metar: DataFrame) -> DataFrame:
    at = F.col("valid").cast("timestamp")
    return metar.groupBy(F.col("station").alias("apt"), F.year(at).alias("year"), F.month(at).alias("month_num")).agg(
        share(F.col("deicing_proxy")).alias("deicing"), share(F.col("snow")).alias("snow"), share(F.col("freezing_precip")).alias("freezing"), F.min("temperature_c").alias("min_temperature_c")
    )


def deicing_regimes(official: DataFrame, metar: DataFrame) -> DataFrame:
    """By airport: months, correlations with the de-icing share, means, and winter against summer."""
    j = official.join(monthly_weather(metar), ["apt", "year", "month_num"])
    m = F.col("month_num")
    out = j.groupBy("apt").agg(
        F.count("*").alias("n_months"),
        pearson("deicing", "no_reference_share").alias("r_no_reference"),
        pearson("deicing", "additional_min").alias("r_additional"),
        F.avg("deicing").alias("mean_deicing"),
        F.avg("no_reference_share").alias("mean_no_reference"),
        mean_where("additional_min", m.isin(*WINTER)).alias("winter_additional"),
        mean_where("additional_min", m.isin(*SUMMER)).alias("summer_additional"),
    )
    return out.withColumn("winter_summer_diff", F.col("winter_additional") - F.col("summer_additional"))


def deicing_overall(official: DataFrame, metar: DataFrame) -> DataFrame:
    j = official.join(monthly_weather(metar), ["apt", "year", "month_num"])
    return j.agg(pearson("deicing", "no_reference_share").alias("r_no_reference"), pearson("deicing", "additional_min").alias("r_additional"))


def event_coverage(events: DataFrame, places: dict[str, tuple[float, float]], kinds: Sequence[str], radius_km: float = 10.0) -> DataFrame:
    """A row for each place and a column for each kind: events in the box about the place.  Boxes may overlap."""
    hits = F.filter(F.array(*[F.when(geo.within_box("latitude", "longitude", la, lo, radius_km), F.lit(p)) for p, (la, lo) in places.items()]), lambda x: x.isNotNull())
    d = events.where(F.col("type").isin(*kinds)).select("type", F.explode(hits).alias("apt"))
    return counts_by_type(d, "apt", "type", kinds, list(places))


def span_micros(df: DataFrame, at: str) -> DataFrame:
    return df.agg(F.min(micros(at)).alias("first_us"), F.max(micros(at)).alias("last_us"))
