"""Feature operators over movements.  Each is a function from frames to a frame with one row for each departure.

anchor: the instant that features look from, take-off (retrospective) or off-block (causal).  Causal features look back
only.  `strict` moves bins so that they use nothing after the anchor; without it bins are labelled by their start, as in
the published feature set, and reach past the anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import calendar, micros, ratio, seconds_between
from ..operators.asof import asof_backward
from ..operators.bins import day, fixed_bin, sliding_summary
from ..operators.aggregates import joined_set
from ..operators.windows import DAY, MINUTE, gaps, horizons, range_counts, range_counts_of
from .movements import NAMES, Names
from .registry import is_declared, makes

MINUTES = (5, 10, 15, 30, 60)
SECTOR_MINUTES = (15, 30)

# What an observation and an airport's day give.
WEATHER = "temperature_c dewpoint_c visibility_km wind_ms precip_mm ceiling_m freezing_precip snow fog thunderstorm deicing_proxy low_visibility".split()
DAILY = "atfm_regulated_share atfm_slot_late_share atfm_slot_early_share daily_departures daily_arrivals arr_atfm_delay_min arr_delay_weather_min arr_delay_atc_capacity_min arr_delay_aerodrome_capacity_min arr_delay_atc_staffing_min arr_delay_atc_equipment_min".split()


def departures(df: DataFrame, anchor: str, n: Names = NAMES) -> DataFrame:
    return df.where((F.col(n.phase) == n.departed) & F.col(anchor).isNotNull())


def arrivals(df: DataFrame, n: Names = NAMES) -> DataFrame:
    return df.where(F.col(n.phase) == n.arrived)


@makes("runway_queue", "rwy_dep_prev_5m", "rwy_dep_next_5m", "prev_dep_gap_sec", "next_dep_gap_sec", "rwy_service_interval_sec")
def runway_features(df: DataFrame, anchor: str, ahead: bool, minutes: Sequence[int] = MINUTES, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """Gaps and mean service interval at the runway, and departures in the windows around the anchor."""
    by = [n.airport, n.runway]
    d = gaps(departures(df, anchor, n), by, anchor, [n.key], ahead, names=("prev_dep_gap_sec", "next_dep_gap_sec", "rwy_service_interval_sec"), bucket=bucket)
    return range_counts(d, df.where(F.col(n.phase) == n.departed), by, anchor, n.moved, horizons("rwy_dep", minutes, True, ahead), bucket)


@makes("airport_flow", "apt_dep_prev_5m", "apt_dep_next_5m", "apt_arr_prev_5m", "apt_arr_next_5m", "arr_dep_ratio_30m")
def airport_features(df: DataFrame, dep: DataFrame, anchor: str, ahead: bool, minutes: Sequence[int] = MINUTES, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """dep with arrivals and departures at the airport in the windows, and the arrivals' share of half an hour."""
    by = [n.airport]
    streams = [(arrivals(df, n), n.moved, horizons("apt_arr", minutes, True, ahead)), (df.where(F.col(n.phase) == n.departed), n.moved, horizons("apt_dep", minutes, True, ahead))]
    out = range_counts_of(dep, streams, by, anchor, bucket)
    if 30 in minutes:
        out = out.withColumn("arr_dep_ratio_30m", ratio("apt_arr_prev_30m", F.col("apt_dep_prev_30m") + F.col("apt_arr_prev_30m")))
    return out


@makes("taxi_in_pressure", "arr_taxi_median_sec", "arr_taxi_count")
def taxi_in_pressure(df: DataFrame, dep: DataFrame, anchor: str, minutes: int = 30, every: int = 10, strict: bool = False, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """dep with the median and count of taxi-in times in the last sliding bin of arrivals that begins by the anchor.

    strict: the last that ended by it.  Without a bin the median is null and the count 0.
    """
    a = arrivals(df, n).where(F.col(n.taxi).isNotNull())
    bins = sliding_summary(a, [n.airport], n.moved, every, minutes, _median=F.median(n.taxi), _count=F.count("*"))
    if strict:
        bins = bins.withColumn("bin_start", F.timestamp_micros(micros("bin_start") + minutes * MINUTE))
    out = asof_backward(dep, bins, anchor, "bin_start", [n.airport], [n.airport], {"arr_taxi_median_sec": "_median", "arr_taxi_count": "_count"}, bucket=bucket)
    return out.withColumn("arr_taxi_count", F.coalesce("arr_taxi_count", F.lit(0)))


@makes("runway_configuration", "dep_runways_in_use", "arr_runways_in_use", "active_runway_count")
def runway_configuration(df: DataFrame, dep: DataFrame, anchor: str, minutes: int = 30, strict: bool = False, n: Names = NAMES) -> DataFrame:
    """dep with the runways that departures and arrivals used in the anchor's bin (strict: the bin before), and how many."""
    phase = F.col(n.phase)
    bins = df.where(F.col(n.moved).isNotNull()).groupBy(F.col(n.airport).alias("_apt"), fixed_bin(n.moved, minutes).alias("_bin"))
    bins = bins.agg(
        joined_set(n.runway, phase == n.departed).alias("dep_runways_in_use"),
        joined_set(n.runway, phase == n.arrived).alias("arr_runways_in_use"),
        F.count_distinct(n.runway).alias("active_runway_count"),
    )
    at = F.timestamp_micros(micros(anchor) - (minutes * MINUTE if strict else 0))
    return dep.withColumn("_at", fixed_bin(at, minutes)).join(bins, (F.col(n.airport) == F.col("_apt")) & (F.col("_at") == F.col("_bin")), "left").drop("_at", "_apt", "_bin")


def congestion(df: DataFrame, causal: bool = False, minutes: Sequence[int] = MINUTES, strict: bool = False, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """One row for each departure with a known anchor."""
    anchor, ahead = (n.block, False) if causal else (n.moved, True)
    d = runway_features(df, anchor, ahead, minutes, n, bucket)
    d = airport_features(df, d, anchor, ahead, minutes, n, bucket)
    d = taxi_in_pressure(df, d, anchor, strict=strict, n=n, bucket=bucket)
    return runway_configuration(df, d, anchor, strict=strict, n=n)


@makes("routing", "departure_bearing", "departure_sector", "flight_distance_km")
def attach_bearing(dep: DataFrame, coords: DataFrame, n: Names = NAMES) -> DataFrame:
    """dep with bearing, sector and distance to the destination; null where an airport is unknown."""
    one = lambda p: coords.select(F.col("icao").alias(f"_{p}"), F.col("latitude").alias(f"_{p}lat"), F.col("longitude").alias(f"_{p}lon"))
    d = dep.join(one("o"), F.col(n.airport) == F.col("_o"), "left").join(one("d"), F.col(n.destination) == F.col("_d"), "left")
    ends = ("_olat", "_olon", "_dlat", "_dlon")
    d = d.withColumn("departure_bearing", geo.bearing(*ends)).withColumn("flight_distance_km", geo.distance_km(*ends))
    return d.withColumn("departure_sector", geo.sector("departure_bearing")).drop("_o", "_d", *ends)


@makes("routing", "sector_dep_prev_15m")
def sector_congestion(dep: DataFrame, anchor: str, minutes: Sequence[int] = SECTOR_MINUTES, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """dep with take-offs into the same sector in the windows before the anchor; 0 in an unknown sector."""
    return range_counts(dep, dep, [n.airport, "departure_sector"], anchor, n.moved, horizons("sector_dep", minutes, True, False), bucket)


@makes("atfm", "atfm_drift_sec", "lobt_anchor_gap_sec", "diverted")
def atfm_pressure(dep: DataFrame, anchor: str, n: Names = NAMES) -> DataFrame:
    """dep with the slot's drift, the anchor's distance to it, and whether the flight was diverted, as columns allow."""
    have = set(dep.columns)
    out: dict[str, Column] = {}
    if {n.last_off_block, n.first_off_block} <= have:
        out["atfm_drift_sec"] = seconds_between(n.last_off_block, n.first_off_block).cast("float")
    if n.last_off_block in have:
        out["lobt_anchor_gap_sec"] = seconds_between(anchor, n.last_off_block).cast("float")
    if {n.filed, n.destination} <= have:
        out["diverted"] = F.col(n.filed) != F.col(n.destination)
    return dep.withColumns(out) if out else dep


@makes("stand_turnaround", "stand_turnaround_sec")
def stand_turnaround(df: DataFrame, dep: DataFrame, anchor: str, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """dep with the seconds since the last arrival went on block at its stand; null if none did."""
    a = arrivals(df, n).where(F.col(n.block).isNotNull())
    d = asof_backward(dep, a, anchor, n.block, [n.airport, n.stand], [n.airport, n.stand], {"_arrived": n.block}, bucket=bucket)
    return d.withColumn("stand_turnaround_sec", seconds_between(anchor, "_arrived").cast("float")).drop("_arrived")


def routing(df: DataFrame, dep: DataFrame, coords: DataFrame | None, anchor: str, n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    d = atfm_pressure(dep, anchor, n)
    if coords is not None and n.destination in d.columns:
        d = sector_congestion(attach_bearing(d, coords, n), anchor, n=n, bucket=bucket)
    return stand_turnaround(df, d, anchor, n, bucket)


@makes("weather", *WEATHER, "dewpoint_spread_c", "observation_age_min", "wind_dir_deg")
def weather(dep: DataFrame, metar: DataFrame, anchor: str, columns: Sequence[str] = tuple(WEATHER), n: Names = NAMES, bucket: int | None = DAY) -> DataFrame:
    """dep with the airport's last observation by the anchor, its age in minutes, and temperature less dew point."""
    here = [c for c in columns if c in metar.columns]
    d = asof_backward(dep, metar, anchor, "valid", [n.airport], ["station"], {c: c for c in here} | {"_seen": "valid"}, bucket=bucket)
    d = d.withColumn("observation_age_min", (seconds_between(anchor, "_seen") / 60).cast("float")).drop("_seen")
    if {"temperature_c", "dewpoint_c"} <= set(here):
        d = d.withColumn("dewpoint_spread_c", F.col("temperature_c") - F.col("dewpoint_c"))
    return d


@makes("atfm_daily", *DAILY)
def airport_state(dep: DataFrame, daily: DataFrame, anchor: str, n: Names = NAMES) -> DataFrame:
    """dep with the airport's totals of the anchor's day, as far as the table has them."""
    here = [c for c in DAILY if c in daily.columns]
    right = daily.select(F.col("apt").alias("_apt"), F.col("day").alias("_day"), *here)
    return dep.withColumn("_on", day(anchor)).join(right, (F.col(n.airport) == F.col("_apt")) & (F.col("_on") == F.col("_day")), "left").drop("_on", "_apt", "_day")


@makes("calendar", "hour", "weekday", "month_num", "minute_of_day")
@makes("atfm", "sched_offset_sec", "eobt_offset_sec")
def offsets(dep: DataFrame, anchor: str, n: Names = NAMES) -> DataFrame:
    """dep with the calendar (the month is the take-off's) and the anchor's distance to schedule and estimate."""
    d = dep.withColumns(calendar(anchor, n.moved)).withColumn("sched_offset_sec", seconds_between(anchor, n.scheduled).cast("float"))
    if n.estimated in dep.columns:
        d = d.withColumn("eobt_offset_sec", seconds_between(anchor, n.estimated).cast("float"))
    return d


@makes("nm_aobt", "nm_naive_taxi_sec", "nm_matched")
def network_off_block(dep: DataFrame, n: Names = NAMES) -> DataFrame:
    """dep with take-off less the network's off-block time, and whether that is known."""
    return dep.withColumn("nm_naive_taxi_sec", seconds_between(n.moved, n.off_block).cast("float")).withColumn("nm_matched", F.col(n.off_block).isNotNull())


def _counts(df: DataFrame, dep: DataFrame, anchor: str, ahead: bool, sectors: bool, minutes: Sequence[int], n: Names, bucket: int | None) -> DataFrame:
    """dep with all counts of `runway_features`, `airport_features` and, with sectors, `sector_congestion`: one shuffle."""
    off = dep if anchor == n.moved else df.where(F.col(n.phase) == n.departed)  # a departure without a time is in no window
    streams = [
        (off, n.moved, horizons("rwy_dep", minutes, True, ahead), [n.runway]),
        (arrivals(df, n), n.moved, horizons("apt_arr", minutes, True, ahead)),
        (off, n.moved, horizons("apt_dep", minutes, True, ahead)),
    ]
    if sectors:
        streams.append((dep, n.moved, horizons("sector_dep", SECTOR_MINUTES, True, False), ["departure_sector"]))
    out = range_counts_of(dep, streams, [n.airport], anchor, bucket)
    if 30 in minutes:
        out = out.withColumn("arr_dep_ratio_30m", ratio("apt_arr_prev_30m", F.col("apt_dep_prev_30m") + F.col("apt_arr_prev_30m")))
    return out


def build_features(
    df: DataFrame,
    coords: DataFrame | None = None,
    runways: DataFrame | None = None,
    metar: DataFrame | None = None,
    daily: DataFrame | None = None,
    causal: bool = False,
    network: bool = True,
    strict: bool = False,
    minutes: Sequence[int] = MINUTES,
    n: Names = NAMES,
    bucket: int | None = DAY,
) -> DataFrame:
    """The feature table, one row for each departure with an anchor; optional tables switch their families on.

    The same columns as `congestion`, `offsets`, `network_off_block`, `routing`, `weather` and `airport_state` one after the
    other.  Windows and as-of joins run on a few columns beside the movement's key, which tells movements apart, and the
    families meet the whole rows by that key once.
    """
    anchor, ahead = (n.block, False) if causal else (n.moved, True)
    dep = departures(df, anchor, n)
    located = coords is not None and n.destination in df.columns
    thin = dep.select(*dict.fromkeys([n.key, n.airport, n.runway, n.stand, n.moved, anchor, *([n.destination] if located else [])]))
    own = [c for c in thin.columns if c != n.key]
    if located:
        thin = attach_bearing(thin, coords, n)
    parts = [_counts(df, thin, anchor, ahead, located, minutes, n, bucket).drop(*own)]
    line = thin.select(*dict.fromkeys([n.key, n.airport, n.runway, anchor]))
    parts.append(gaps(line, [n.airport, n.runway], anchor, [n.key], ahead, names=("prev_dep_gap_sec", "next_dep_gap_sec", "rwy_service_interval_sec"), bucket=bucket).drop(*own))
    here = thin.select(n.key, n.airport, anchor)
    parts.append(taxi_in_pressure(df, here, anchor, strict=strict, n=n, bucket=bucket).drop(*own))
    parts.append(stand_turnaround(df, thin.select(n.key, n.airport, n.stand, anchor), anchor, n, bucket).drop(*own))
    if metar is not None:
        parts.append(weather(here, metar, anchor, n=n, bucket=bucket).drop(*own))
    d = atfm_pressure(offsets(runway_configuration(df, dep, anchor, strict=strict, n=n), anchor, n), anchor, n)
    if network and not causal and n.off_block in d.columns:
        d = network_off_block(d, n)
    if runways is not None:
        d = d.join(runways.withColumnRenamed("icao", n.airport), n.airport, "left")
    if daily is not None and not causal:
        d = airport_state(d, daily, anchor, n)
    for part in parts:
        d = d.join(part, n.key)
    floats = [f.name for f in d.schema.fields if f.dataType.simpleString() == "double" and is_declared(f.name)]
    return d.withColumns({c: F.col(c).cast("float") for c in floats})
