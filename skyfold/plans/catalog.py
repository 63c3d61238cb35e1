"""The registered queries of the core library, each with the SQL it is held against.

The driver's tables play the roles of SURVEY §7.5 (see surrogate.py).  Floating results are rounded to 6 places in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import calendar, filled_with_mean, micros, number, ratio, seconds_between
from ..operators import aggregates as agg
from ..operators.asof import asof_backward
from ..operators.bins import day, fixed_bin, month_edges, sliding_summary
from ..operators.windows import MINUTE, gaps, horizons, range_counts, running_count
from ..sources import ingest
from ..sources.files import read_csv, read_many, read_optional, read_pages, read_sheet, union_relaxed, write_parquet
from ..tables import shared_dir, stored
from . import evaluation as ev
from . import features as ft
from . import reference as ref
from . import registry
from . import submission as sub
from . import surrogate as s
from .movements import model_columns, prepare_movements
from .surrogate import MV, NAMES, OBS, SHEET, XY, movements, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The surrogates are sparse, so horizons are in hours.
WIDE = (60, 240, 600)


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c).cast("double")) for c in cols})


def _counts_sql(prefix: str, by: str, key: str, where: str, back: bool = True, ahead: bool = True, minutes=WIDE) -> str:
    """Counts by brute force: a subquery for each horizon."""
    cells = []
    for m in minutes:
        us = m * MINUTE
        if back:
            cells.append(f"(SELECT count(*) FROM mv e WHERE {where} AND {by} AND e.us > k.{key} - {us} AND e.us <= k.{key}) AS {prefix}_prev_{m}m")
        if ahead:
            cells.append(f"(SELECT count(*) FROM mv e WHERE {where} AND {by} AND e.us > k.{key} AND e.us <= k.{key} + {us}) AS {prefix}_next_{m}m")
    return ", ".join(cells)


RWY, APT = "e.apt = k.apt AND e.rwy = k.rwy", "e.apt = k.apt"
DEP, ARR = "e.phase = 'DEP'", "e.phase = 'ARR'"


@query(f"WITH {MV} SELECT id, {_counts_sql('rwy_dep', RWY, 'us', DEP)} FROM mv k WHERE phase = 'DEP'")
def w5_runway_counts(spark, d):
    """Half-open window counts around each departure at its runway."""
    m = movements(spark, d)
    dep = m.where("phase = 'DEP'").select("id", "apt", "rwy", "ts")
    return range_counts(dep, dep, ["apt", "rwy"], "ts", "ts", horizons("rwy_dep", WIDE)).drop("apt", "rwy", "ts")


@query(f"WITH {MV} SELECT id, {_counts_sql('apt_arr', APT, 'us', ARR)} FROM mv k WHERE phase = 'DEP'")
def w5_airport_arrivals(spark, d):
    """Arrivals around each departure, two streams."""
    m = movements(spark, d)
    dep = m.where("phase = 'DEP'").select("id", "apt", "ts")
    return range_counts(dep, m.where("phase = 'ARR'"), ["apt"], "ts", "ts", horizons("apt_arr", WIDE)).drop("apt", "ts")


@query(
    f"""WITH {MV}, c AS (SELECT id, {_counts_sql('apt_arr', APT, 'us', ARR, minutes=(30, 240))}, {_counts_sql('apt_dep', APT, 'us', DEP, minutes=(30, 240))} FROM mv k WHERE phase = 'DEP')
    SELECT *, round(apt_arr_prev_30m / nullif(apt_dep_prev_30m + apt_arr_prev_30m, 0), 6) AS arr_dep_ratio_30m FROM c"""
)
def d3_airport_features(spark, d):
    """D3: arrivals and departures around each departure, in one window, and the arrivals' share."""
    m = movements(spark, d)
    out = ft.airport_features(m, m.where("phase = 'DEP'").select("id", "apt", "ts"), "ts", True, (30, 240), NAMES)
    return _rounded(out.drop("apt", "ts"), "arr_dep_ratio_30m")


@query(f"WITH {MV} SELECT id, {_counts_sql('rwy_dep', RWY, 'block_us', DEP, True, False)} FROM mv k WHERE phase = 'DEP'")
def w5_causal_counts(spark, d):
    """W5, causal: take-offs at the runway up to each off-block time."""
    dep = movements(spark, d).where("phase = 'DEP'").select("id", "apt", "rwy", "ts", "block")
    return range_counts(dep, dep, ["apt", "rwy"], "block", "ts", horizons("rwy_dep", WIDE, True, False)).drop("apt", "rwy", "ts", "block")


_GAP_SQL = """g AS (SELECT id, apt, rwy, us, floor((us - lag(us) OVER w) / 1000000) AS prev_gap_sec, floor((lead(us) OVER w - us) / 1000000) AS next_gap_sec FROM mv
    WHERE phase = 'DEP' WINDOW w AS (PARTITION BY apt, rwy ORDER BY us, id))"""


@query(
    f"""WITH {MV}, {_GAP_SQL} SELECT id, prev_gap_sec, next_gap_sec, round(CASE WHEN count(prev_gap_sec) OVER r >= 2 THEN avg(prev_gap_sec) OVER r END, 6) AS mean_gap_sec
    FROM g WINDOW r AS (PARTITION BY apt, rwy ORDER BY us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def w1_w3_gaps(spark, d):
    """Gaps to the neighbours and their rolling mean."""
    dep = movements(spark, d).where("phase = 'DEP'").select("id", "apt", "rwy", "ts")
    return gaps(dep, ["apt", "rwy"], "ts", ["id"]).select("id", "prev_gap_sec", "next_gap_sec", r6("mean_gap_sec").alias("mean_gap_sec"))


@query(
    f"""WITH {MV}, {_GAP_SQL}, r AS (SELECT id, prev_gap_sec, next_gap_sec, round(CASE WHEN count(prev_gap_sec) OVER r >= 2 THEN avg(prev_gap_sec) OVER r END, 6) AS mean_gap_sec
      FROM g WINDOW r AS (PARTITION BY apt, rwy ORDER BY us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    c AS (SELECT id, {_counts_sql('rwy_dep', RWY, 'us', DEP)} FROM mv k WHERE phase = 'DEP')
    SELECT c.*, prev_gap_sec AS prev_dep_gap_sec, next_gap_sec AS next_dep_gap_sec, mean_gap_sec AS rwy_service_interval_sec FROM c JOIN r ON c.id = r.id"""
)
def d2_runway_features(spark, d):
    """Gaps, service interval and counts at the runway, one row for each departure."""
    out = ft.runway_features(movements(spark, d), "ts", True, WIDE, NAMES)
    names = [f"rwy_dep_{x}_{m}m" for m in WIDE for x in ("prev", "next")]
    return out.select("id", *names, "prev_dep_gap_sec", "next_dep_gap_sec", r6("rwy_service_interval_sec").alias("rwy_service_interval_sec"))


@query(
    f"""WITH {MV}, {OBS}, j AS (SELECT mv.id, temperature_c, dewpoint_c, snow, deicing_proxy, CAST(trunc((mv.us - obs.us) / 1000000) AS BIGINT) AS age FROM (SELECT * FROM mv WHERE phase = 'DEP') mv ASOF LEFT JOIN obs ON mv.apt = obs.station AND mv.us >= obs.us)
    SELECT id, round(temperature_c, 6) AS temperature_c, round(dewpoint_c, 6) AS dewpoint_c, snow, deicing_proxy, round(CAST(CAST(age / 60 AS FLOAT) AS DOUBLE), 3) AS observation_age_min, round(temperature_c - dewpoint_c, 6) AS dewpoint_spread_c FROM j"""
)
def d12_weather(spark, d):
    """The last observation's fields, its age and the spread; a matched null stays null."""
    dep = movements(spark, d).where("phase = 'DEP'")
    out = ft.weather(dep, s.observations(spark, d), "ts", ["temperature_c", "dewpoint_c", "snow", "deicing_proxy", "absent"], NAMES)
    return out.select("id", r6("temperature_c").alias("temperature_c"), r6("dewpoint_c").alias("dewpoint_c"), "snow", "deicing_proxy", F.round(F.col("observation_age_min").cast("double"), 3).alias("observation_age_min"), r6("dewpoint_spread_c").alias("dewpoint_spread_c"))


@query(f"WITH {MV}, c AS (SELECT apt, us, count(*) AS n FROM mv GROUP BY 1, 2) SELECT apt, us, n, CAST(sum(n) OVER (PARTITION BY apt ORDER BY us) AS BIGINT) AS running FROM c")
def w4_running_count(spark, d):
    """Movements at each instant, and up to it."""
    return running_count(movements(spark, d), ["apt"], "ts").select("apt", micros("ts").alias("us"), "n", "running")


@query(
    f"""WITH {MV}, {OBS} SELECT mv.id, obs.obs_id, round(obs.temperature_c, 6) AS temperature_c, round(obs.dewpoint_c, 6) AS dewpoint_c,
    CAST(trunc((mv.us - obs.us) / 1000000) AS BIGINT) AS age_sec FROM (SELECT * FROM mv WHERE phase = 'DEP') mv ASOF LEFT JOIN obs ON mv.apt = obs.station AND mv.us >= obs.us"""
)
def a4_weather_asof(spark, d):
    """The last observation by each departure."""
    dep = movements(spark, d).where("phase = 'DEP'").select("id", "apt", "ts")
    out = asof_backward(dep, s.observations(spark, d), "ts", "valid", ["apt"], ["station"], {"obs_id": "obs_id", "temperature_c": "temperature_c", "dewpoint_c": "dewpoint_c", "seen": "valid"}, ["obs_id"])
    return out.select("id", "obs_id", r6("temperature_c").alias("temperature_c"), r6("dewpoint_c").alias("dewpoint_c"), seconds_between("ts", "seen").alias("age_sec"))


@query(
    f"""WITH {MV}, a AS (SELECT apt, stand, block_us FROM mv WHERE phase = 'ARR')
    SELECT k.id, CAST(CAST(trunc((k.us - a.block_us) / 1000000) AS BIGINT) AS DOUBLE) AS stand_turnaround_sec FROM (SELECT * FROM mv WHERE phase = 'DEP') k ASOF LEFT JOIN a ON k.apt = a.apt AND k.stand = a.stand AND k.us >= a.block_us"""
)
def a3_stand_turnaround(spark, d):
    """Seconds since the last arrival at the stand."""
    m = movements(spark, d)
    out = ft.stand_turnaround(m, m.where("phase = 'DEP'"), "ts", NAMES)
    return out.select("id", F.col("stand_turnaround_sec").cast("double").alias("stand_turnaround_sec"))


_BINS_SQL = """b AS (SELECT apt, k * 600000000 AS bin_us, median(taxi) AS med, count(*) AS n FROM (
    SELECT apt, taxi, unnest(range(CAST(floor((us - 1800000000) / 600000000) AS BIGINT) + 1, CAST(floor(us / 600000000) AS BIGINT) + 1)) AS k FROM mv WHERE phase = 'ARR') GROUP BY 1, 2)"""


@query(f"WITH {MV}, {_BINS_SQL} SELECT apt, CAST(bin_us AS BIGINT) AS bin_us, round(med, 6) AS med, n FROM b")
def t1_sliding_bins(spark, d):
    """Medians of sliding bins."""
    out = sliding_summary(movements(spark, d).where("phase = 'ARR'"), ["apt"], "ts", 10, 30, med=F.median("taxi"), n=F.count("*"))
    return out.select("apt", micros("bin_start").alias("bin_us"), r6("med").alias("med"), "n")


@query(
    f"""WITH {MV}, {_BINS_SQL} SELECT k.id, round(b.med, 6) AS arr_taxi_median_sec, coalesce(b.n, 0) AS arr_taxi_count
    FROM (SELECT * FROM mv WHERE phase = 'DEP') k ASOF LEFT JOIN b ON k.apt = b.apt AND k.us >= b.bin_us"""
)
def d4_taxi_in_pressure(spark, d):
    """The last sliding bin that begins by the departure."""
    m = movements(spark, d)
    out = ft.taxi_in_pressure(m, m.where("phase = 'DEP'"), "ts", n=NAMES)
    return out.select("id", r6("arr_taxi_median_sec").alias("arr_taxi_median_sec"), "arr_taxi_count")


@query(
    f"""WITH {MV}, {_BINS_SQL} SELECT k.id, round(b.med, 6) AS arr_taxi_median_sec, coalesce(b.n, 0) AS arr_taxi_count
    FROM (SELECT * FROM mv WHERE phase = 'DEP') k ASOF LEFT JOIN (SELECT apt, bin_us + 1800000000 AS end_us, med, n FROM b) b ON k.apt = b.apt AND k.us >= b.end_us"""
)
def d4_taxi_in_strict(spark, d):
    """The last sliding bin that ended by the departure."""
    m = movements(spark, d)
    out = ft.taxi_in_pressure(m, m.where("phase = 'DEP'"), "ts", strict=True, n=NAMES)
    return out.select("id", r6("arr_taxi_median_sec").alias("arr_taxi_median_sec"), "arr_taxi_count")


_CONF_SQL = """c AS (SELECT apt, us // 1800000000 AS k, coalesce(string_agg(DISTINCT rwy, '+' ORDER BY rwy) FILTER (phase = 'DEP'), '') AS dep_runways_in_use,
    coalesce(string_agg(DISTINCT rwy, '+' ORDER BY rwy) FILTER (phase = 'ARR'), '') AS arr_runways_in_use, count(DISTINCT rwy) AS active_runway_count FROM mv GROUP BY 1, 2)"""


@query(f"WITH {MV}, {_CONF_SQL} SELECT k.id, dep_runways_in_use, arr_runways_in_use, active_runway_count FROM mv k JOIN c ON k.apt = c.apt AND k.us // 1800000000 = c.k WHERE k.phase = 'DEP'")
def d5_runway_configuration(spark, d):
    """Runways in use in the departure's half hour."""
    m = movements(spark, d)
    return ft.runway_configuration(m, m.where("phase = 'DEP'"), "ts", n=NAMES).select("id", "dep_runways_in_use", "arr_runways_in_use", "active_runway_count")


@query(f"WITH {MV}, {_CONF_SQL} SELECT k.id, dep_runways_in_use, arr_runways_in_use, active_runway_count FROM mv k LEFT JOIN c ON k.apt = c.apt AND k.us // 1800000000 - 1 = c.k WHERE k.phase = 'DEP'")
def d5_configuration_strict(spark, d):
    """Runways in use in the half hour that ended before the departure's."""
    m = movements(spark, d)
    return ft.runway_configuration(m, m.where("phase = 'DEP'"), "ts", strict=True, n=NAMES).select("id", "dep_runways_in_use", "arr_runways_in_use", "active_runway_count")


_GEO = """p AS (SELECT k.id, k.apt, k.us, radians(o.latitude) AS a, radians(q.latitude) AS b, radians(q.longitude - o.longitude) AS l FROM mv k LEFT JOIN xy o ON k.apt = o.icao LEFT JOIN xy q ON k.ades = q.icao WHERE k.phase = 'DEP'),
  h AS (SELECT id, apt, us, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE (degrees(atan2(sin(l) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(l))) + 360) % 360 END AS brg,
    2 * 6371.0 * asin(sqrt(least(sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(l / 2) ** 2, 1.0))) AS km FROM p)"""


@query(f"WITH {MV}, {XY}, {_GEO} SELECT id, round(brg, 6) AS departure_bearing, CAST(floor(brg / 30) % 12 AS TINYINT) AS departure_sector, round(CASE WHEN brg IS NULL THEN NULL ELSE km END, 6) AS flight_distance_km FROM h")
def d7_bearing(spark, d):
    """Bearing, sector and distance to the destination."""
    dep = movements(spark, d).where("phase = 'DEP'")
    out = ft.attach_bearing(dep, s.coordinates(spark, d), NAMES)
    return out.select("id", r6("departure_bearing").alias("departure_bearing"), "departure_sector", r6("flight_distance_km").alias("flight_distance_km"))


@query(
    f"""WITH {MV}, {XY}, {_GEO}, z AS (SELECT id, apt, us, floor(brg / 30) AS sec FROM h) SELECT k.id, {", ".join(f"(SELECT count(*) FROM z e WHERE e.apt = k.apt AND e.sec = k.sec AND e.us > k.us - {m * MINUTE} AND e.us <= k.us) AS sector_dep_prev_{m}m" for m in WIDE)} FROM z k"""
)
def d8_sector_counts(spark, d):
    """Take-offs into the same sector; 0 in an unknown one."""
    dep = ft.attach_bearing(movements(spark, d).where("phase = 'DEP'"), s.coordinates(spark, d), NAMES)
    return ft.sector_congestion(dep, "ts", WIDE, NAMES).select("id", *[f"sector_dep_prev_{m}m" for m in WIDE])


@query(f"WITH {MV} SELECT id, CAST(CAST(trunc((lobt_us - iobt_us) / 1000000) AS BIGINT) AS DOUBLE) AS atfm_drift_sec, CAST(CAST(trunc((us - lobt_us) / 1000000) AS BIGINT) AS DOUBLE) AS lobt_anchor_gap_sec, filed <> ades AS diverted FROM mv WHERE phase = 'DEP'")
def d9_atfm(spark, d):
    """Slot drift, gap to it, diversion."""
    out = ft.atfm_pressure(movements(spark, d).where("phase = 'DEP'"), "ts", NAMES)
    return out.select("id", F.col("atfm_drift_sec").cast("double").alias("atfm_drift_sec"), F.col("lobt_anchor_gap_sec").cast("double").alias("lobt_anchor_gap_sec"), "diverted")


@query(
    f"""WITH {MV} SELECT id, hour(make_timestamp(us)) AS hour, isodow(make_timestamp(us)) AS weekday, month(make_timestamp(us)) AS month_num, hour(make_timestamp(us)) * 60 + minute(make_timestamp(us)) AS minute_of_day,
    CAST(CAST(trunc((us - sched_us) / 1000000) AS BIGINT) AS DOUBLE) AS sched_offset_sec, CAST(CAST(trunc((us - eobt_us) / 1000000) AS BIGINT) AS DOUBLE) AS eobt_offset_sec FROM mv WHERE phase = 'DEP'"""
)
def d14_offsets(spark, d):
    """Calendar and offsets to schedule and estimate."""
    out = ft.offsets(movements(spark, d).where("phase = 'DEP'"), "ts", NAMES)
    whole = [F.col(c).cast("long").alias(c) for c in ("hour", "weekday", "month_num", "minute_of_day")]
    return out.select("id", *whole, F.col("sched_offset_sec").cast("double").alias("sched_offset_sec"), F.col("eobt_offset_sec").cast("double").alias("eobt_offset_sec"))


@query(f"WITH {MV} SELECT id, CAST(CAST(trunc((us - aobt_us) / 1000000) AS BIGINT) AS DOUBLE) AS nm_naive_taxi_sec, aobt_us IS NOT NULL AS nm_matched FROM mv WHERE phase = 'DEP'")
def d15_network_off_block(spark, d):
    """Take-off less the network's off-block time."""
    out = ft.network_off_block(movements(spark, d).where("phase = 'DEP'"), NAMES)
    return out.select("id", F.col("nm_naive_taxi_sec").cast("double").alias("nm_naive_taxi_sec"), "nm_matched")


@query(f"WITH {MV} SELECT id, CASE WHEN phase = 'DEP' THEN adep ELSE ades END AS apt_mvt FROM mv")
def d1_movement_airport(spark, d):
    """The airport of a movement."""
    m = movements(spark, d).drop("apt")
    return prepare_movements(m, NAMES).select("id", F.col("apt").alias("apt_mvt"))


@query(
    f"""WITH {MV}, d AS (SELECT apt, us // 86400000000 AS k, count(*) FILTER (phase = 'DEP') AS daily_departures, count(*) FILTER (phase = 'ARR') AS daily_arrivals FROM mv GROUP BY 1, 2)
    SELECT k.id, CAST(daily_departures AS DOUBLE) AS daily_departures, CAST(daily_arrivals AS DOUBLE) AS daily_arrivals FROM mv k LEFT JOIN d ON k.apt = d.apt AND k.us // 86400000000 = d.k WHERE k.phase = 'DEP'"""
)
def d13_airport_state(spark, d):
    """Totals of the departure's day over every movement."""
    m = movements(spark, d)
    daily = m.groupBy("apt", day("ts").alias("day")).agg(F.count_if(F.col("phase") == "DEP").cast("double").alias("daily_departures"), F.count_if(F.col("phase") == "ARR").cast("double").alias("daily_arrivals"))
    return ft.airport_state(m.where("phase = 'DEP'"), daily, "ts", NAMES).select("id", "daily_departures", "daily_arrivals")


@query("SELECT c_custkey, s_count, CAST(s_longest AS DOUBLE) AS s_longest FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS s_count, max(s_acctbal) AS s_longest FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON c_nationkey = s_nationkey")
def j2_dimension_join(spark, d):
    """A left join of a summarised dimension."""
    dim = table(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("s_count"), F.max("s_acctbal").alias("s_longest"))
    return table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", "s_count", "s_longest")


# The reference: line items as clean times by group

_REF = "l AS (SELECT l_returnflag AS apt, l_linestatus AS stand, l_linenumber AS rwy, l_extendedprice AS taxi, l_orderkey AS id FROM lineitem)"


def _items(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.lit("DEP").alias("phase"), F.col("l_returnflag").alias("apt"), F.col("l_linestatus").alias("stand"), F.col("l_linenumber").alias("rwy"), F.col("l_extendedprice").alias("taxi"),
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


@query(
    f"""WITH {_REF}, q AS (SELECT apt, stand, rwy, quantile_cont(taxi, 0.1) AS p10, count(*) AS n FROM l GROUP BY 1, 2, 3)
    SELECT q.apt, q.stand, q.rwy, round(p10, 6) AS p10, n, (SELECT count(*) FROM l WHERE l.apt = q.apt AND l.stand = q.stand AND l.rwy = q.rwy AND l.taxi <= q.p10) >= 10 AS valid FROM q"""
)
def d16_reference_level(spark, d):
    """The percentile, its sample, and its validity."""
    return _rounded(ref.level_reference(_items(spark, d), ["apt", "stand", "rwy"], "taxi"), "p10")


def _level_sql(keys: str, name: str, on: str) -> str:
    return f"""{name}q AS (SELECT {keys}, quantile_cont(taxi, 0.1) AS p, count(*) AS n FROM c GROUP BY {keys}),
      {name} AS (SELECT *, (SELECT count(*) FROM c WHERE {on} AND c.taxi <= {name}q.p) >= 10 AS valid FROM {name}q)"""


@query(
    f"""WITH {_REF}, t AS (SELECT l_returnflag AS apt, CASE WHEN l_partkey % 40 = 0 THEN l_linestatus ELSE 'X' || l_partkey % 50 END AS stand, CASE WHEN l_partkey % 5 = 0 THEN 99 ELSE l_linenumber END AS rwy, l_extendedprice AS taxi, l_orderkey AS id, l_linenumber AS line, l_partkey AS part FROM lineitem),
    c AS (SELECT * FROM t WHERE taxi > 0 AND taxi <= 7200),
    {_level_sql("apt, stand, rwy", "a", "c.apt = aq.apt AND c.stand = aq.stand AND c.rwy = aq.rwy")}, {_level_sql("apt, stand", "b", "c.apt = bq.apt AND c.stand = bq.stand")},
    {_level_sql("apt, rwy", "e", "c.apt = eq.apt AND c.rwy = eq.rwy")}, {_level_sql("apt", "f", "c.apt = fq.apt")}
    SELECT t.id, t.line, t.part, round(CAST(CAST(coalesce(CASE WHEN a.valid THEN a.p END, CASE WHEN b.valid THEN b.p END, CASE WHEN e.valid THEN e.p END, CASE WHEN f.valid THEN f.p END) AS FLOAT) AS DOUBLE), 2) AS reference_sec,
      CASE WHEN a.valid THEN 'apt_stand_rwy' WHEN b.valid THEN 'apt_stand' WHEN e.valid THEN 'apt_rwy' WHEN f.valid THEN 'apt' ELSE 'none' END AS reference_level, coalesce(a.n, 0) AS reference_sample
    FROM t LEFT JOIN a ON t.apt = a.apt AND t.stand = a.stand AND t.rwy = a.rwy LEFT JOIN b ON t.apt = b.apt AND t.stand = b.stand LEFT JOIN e ON t.apt = e.apt AND t.rwy = e.rwy LEFT JOIN f ON t.apt = f.apt"""
)
def d17_reference_fallback(spark, d):
    """The most specific valid level, on thinned-out stands."""
    t = table(spark, d, "lineitem").select(
        F.lit("DEP").alias("phase"), F.col("l_returnflag").alias("apt"), F.expr("CASE WHEN l_partkey % 40 = 0 THEN l_linestatus ELSE concat('X', l_partkey % 50) END").alias("stand"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN 99 ELSE l_linenumber END").alias("rwy"), F.col("l_extendedprice").alias("taxi"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
    out = ref.apply_reference(t, ref.fit_reference(t, NAMES), NAMES)
    return out.select("id", "line", "part", F.round(F.col("reference_sec").cast("double"), 2).alias("reference_sec"), "reference_level", "reference_sample")


@query(
    f"""WITH {_REF}, q AS (SELECT apt, stand, quantile_cont(taxi, 0.1) AS p, count(*) AS n FROM l GROUP BY 1, 2), v AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'apt_stand_rwy' WHEN n % 3 = 0 THEN 'apt' ELSE 'none' END AS lv FROM q)
    SELECT apt, count(*) AS n, round(avg(CASE WHEN lv = 'apt_stand_rwy' THEN 1.0 ELSE 0 END), 6) AS official_share, round(avg(CASE WHEN lv <> 'apt_stand_rwy' THEN 1.0 ELSE 0 END), 6) AS fallback_share FROM v GROUP BY 1"""
)
def d18_coverage(spark, d):
    """Shares of reference levels."""
    q = ref.level_reference(_items(spark, d), ["apt", "stand"], "taxi").withColumn("reference_level", F.expr("CASE WHEN n % 2 = 0 THEN 'apt_stand_rwy' WHEN n % 3 = 0 THEN 'apt' ELSE 'none' END"))
    return _rounded(ref.coverage(q, n=NAMES), "official_share", "fallback_share")


# Split and evaluation


@query(
    """WITH o AS (SELECT o_orderkey AS id, 'C' || (o_custkey % 5) AS apt, o_orderdate AS ts FROM orders)
    SELECT apt, month(ts) AS month_num, (month(ts) = 1) OR (month(ts) = 7 AND apt IN ('C0', 'C1')) AS held, count(*) AS n FROM o GROUP BY 1, 2, 3"""
)
def d21_holdout_mask(spark, d):
    """One month everywhere, another at some airports."""
    o = table(spark, d, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("apt"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return o.groupBy("apt", F.month("ts").cast("long").alias("month_num"), ev.holdout(NAMES, airports=("C0", "C1")).alias("held")).agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT l_extendedprice AS truth, l_quantity * 1500 AS pred, l_shipdate AS ts, l_returnflag AS apt FROM lineitem), e AS (SELECT *, (pred - truth) ** 2 AS se FROM o)
    SELECT 'total' AS scope, '' AS key, count(*) AS n, round(sqrt(avg(se)), 6) AS rmse FROM e
    UNION ALL SELECT 'month', CAST(month(ts) AS VARCHAR), count(*), round(sqrt(avg(se)), 6) FROM e WHERE month(ts) IN (1, 7) GROUP BY 2
    UNION ALL SELECT 'airport', apt, count(*), round(sqrt(avg(se)), 6) FROM e GROUP BY 2"""
)
def m7_evaluate(spark, d):
    """Errors in total, by month and by airport."""
    o = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500).alias("pred"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_returnflag").alias("apt"))
    return _rounded(ev.evaluate(o, "pred", "truth", "ts", "apt"), "rmse")


# Diagnostics


@query("SELECT count(*) AS n, round(avg(CASE WHEN event_id % 60 <> 0 THEN 1.0 ELSE 0 END), 6) AS flight, round(avg(CASE WHEN event_id % 11 <> 0 THEN 1.0 ELSE 0 END), 6) AS aobt, round(avg(CASE WHEN event_id % 13 <> 0 THEN 1.0 ELSE 0 END), 6) AS filed FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def c1_fill_rates(spark, d):
    """Shares of filled columns."""
    return _rounded(agg.fill_rates(movements(spark, d).where("phase = 'DEP'"), ["flight", "aobt", "filed"]), "flight", "aobt", "filed")


@query(
    f"""WITH {MV}, x AS (SELECT abs(trunc((us - block_us) / 1000000) - taxi) AS off FROM mv WHERE phase = 'DEP')
    SELECT count(*) AS n, count(*) AS n_complete, round(avg(CASE WHEN off < 1 THEN 1.0 ELSE 0 END), 6) AS exact_match, round(max(off), 6) AS max_abs_diff FROM x"""
)
def c2_identity(spark, d):
    """Take-off less off-block against the taxi time."""
    return _rounded(ev.check_identity(movements(spark, d), NAMES), "exact_match", "max_abs_diff")


@query(
    f"""WITH {MV} SELECT adep, count(*) AS n, round(avg(CASE WHEN us // 1000000 % 60 = 0 THEN 1.0 ELSE 0 END), 6) AS moved_on_minute, round(avg(CASE WHEN block_us // 1000000 % 60 = 0 THEN 1.0 ELSE 0 END), 6) AS block_on_minute FROM mv WHERE phase = 'DEP' GROUP BY 1"""
)
def c3_precision(spark, d):
    """Shares of times on a whole minute."""
    return _rounded(ev.check_precision(movements(spark, d), "adep", NAMES), "moved_on_minute", "block_on_minute")


@query(f"WITH {MV} SELECT adep, count(*) AS n, round(avg(CASE WHEN flight IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS flight_filled, round(avg(CASE WHEN aobt_us IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS aobt_filled FROM mv WHERE phase = 'DEP' GROUP BY 1")
def c4_match_rates(spark, d):
    """Match rates by airport."""
    return _rounded(ev.check_match(movements(spark, d), "adep", {"flight_filled": "flight", "aobt_filled": "aobt", "absent": "no_such"}, NAMES), "flight_filled", "aobt_filled")


_NAIVE = "x AS (SELECT adep, trunc((us - aobt_us) / 1000000) - taxi AS err FROM mv WHERE phase = 'DEP' AND aobt_us IS NOT NULL)"


@query(f"WITH {MV}, {_NAIVE} SELECT count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae, round(median(abs(err)), 6) AS median_abs_error FROM x")
def c5_naive_predictor(spark, d):
    """Errors of the naive predictor."""
    return _rounded(ev.check_predictor(movements(spark, d), "aobt", n=NAMES), "rmse", "bias", "mae", "median_abs_error")


@query(f"WITH {MV}, {_NAIVE} SELECT adep, count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(err), 6) AS bias FROM x GROUP BY 1")
def c5_naive_by_airport(spark, d):
    """C5 by airport."""
    return _rounded(ev.check_predictor(movements(spark, d), "aobt", "adep", NAMES), "rmse", "bias")


_NEAR = "list_sort(list({v}))[CAST(floor((count({v}) - 1) * {q} + 0.5) AS BIGINT) + 1]"


@query(
    f"""WITH {MV} SELECT adep, count(*) AS n, round(avg(taxi), 6) AS mean, round(stddev_samp(taxi), 6) AS std, round(median(taxi), 6) AS p50, round(avg(CASE WHEN taxi > 7200 THEN 1.0 ELSE 0 END), 6) AS over_120min_share,
    round(avg(CASE WHEN taxi < 0 THEN 1.0 ELSE 0 END), 6) AS negative_share, {_NEAR.format(v="taxi", q=0.1)} AS p10, {_NEAR.format(v="taxi", q=0.99)} AS p99 FROM mv WHERE phase = 'DEP' GROUP BY 1"""
)
def c6_target(spark, d):
    """The target's distribution."""
    return _rounded(ev.check_target(movements(spark, d), "adep", NAMES), "mean", "std", "p50", "over_120min_share", "negative_share")


@query("SELECT month(l_shipdate) AS month_num, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def c6_target_by_month(spark, d):
    """The target by month."""
    out = ev.target_by_month(_items(spark, d), NAMES)
    return out.select(F.col("month_num").cast("long").alias("month_num"), "n", r6("mean").alias("mean"), F.round("std", 4).alias("std"))


@query(
    f"""WITH {_REF}, z AS (SELECT l_returnflag AS apt, l_linestatus || l_partkey % 400 AS stand, l_linenumber AS rwy, l_extendedprice AS taxi, month(l_shipdate) IN (1, 7) AS held FROM lineitem),
    a AS (SELECT apt, avg(taxi) AS m FROM z WHERE NOT held GROUP BY 1), c AS (SELECT apt, stand, rwy, avg(taxi) AS m FROM z WHERE NOT held GROUP BY 1, 2, 3), g AS (SELECT avg(taxi) AS m FROM z WHERE NOT held)
    SELECT count(*) AS n_validation, round(avg(CASE WHEN c.m IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS combo_coverage, round(sqrt(avg((g.m - taxi) ** 2)), 4) AS rmse_global_mean,
      round(sqrt(avg((a.m - taxi) ** 2)), 4) AS rmse_airport_mean, round(sqrt(avg((coalesce(c.m, a.m) - taxi) ** 2)), 4) AS rmse_combo_mean
    FROM z CROSS JOIN g LEFT JOIN a ON z.apt = a.apt LEFT JOIN c ON z.apt = c.apt AND z.stand = c.stand AND z.rwy = c.rwy WHERE held"""
)
def c7_baselines(spark, d):
    """Mean baselines with fallback."""
    z = _items(spark, d).withColumn("stand", F.concat("stand", (F.col("part") % 400).cast("string")))
    out = ev.baselines(z, "apt", ["apt", "stand", "rwy"], F.month("ts").isin(1, 7), NAMES)
    return out.select("n_validation", r6("combo_coverage").alias("combo_coverage"), *[F.round(c, 4).alias(c) for c in ("rmse_global_mean", "rmse_airport_mean", "rmse_combo_mean")])


@query(
    """WITH z AS (SELECT l_returnflag AS apt, CASE WHEN l_partkey % 7 <> 0 THEN l_linestatus || l_partkey % 900 END AS stand, CASE WHEN l_suppkey % 9 <> 0 THEN l_linenumber END AS rwy, l_orderkey % 4 = 0 AS rank FROM lineitem),
    c AS (SELECT DISTINCT apt, stand, rwy FROM z WHERE NOT rank)
    SELECT count(*) AS n, round(avg(CASE WHEN c.apt IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS seen_combo_share, round(avg(CASE WHEN z.stand IS NULL THEN 1.0 ELSE 0 END), 6) AS stand_null_share, round(avg(CASE WHEN z.rwy IS NULL THEN 1.0 ELSE 0 END), 6) AS runway_null_share
    FROM z LEFT JOIN c ON z.apt = c.apt AND z.stand = c.stand AND z.rwy = c.rwy WHERE rank"""
)
def c7_cold_start(spark, d):
    """Combinations not trained on; null keys match nothing."""
    z = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("apt"), F.expr("CASE WHEN l_partkey % 7 <> 0 THEN concat(l_linestatus, l_partkey % 900) END").alias("stand"), F.expr("CASE WHEN l_suppkey % 9 <> 0 THEN l_linenumber END").alias("rwy"), (F.col("l_orderkey") % 4 == 0).alias("rank")
    )
    out = ev.cold_start(z.where("NOT rank"), z.where("rank"), ["apt", "stand", "rwy"], {"stand_null_share": "stand", "runway_null_share": "rwy"})
    return _rounded(out, "seen_combo_share", "stand_null_share", "runway_null_share")


@query(
    f"""WITH {MV}, x AS (SELECT CAST(trunc((block_us - sched_us) / 1000000) AS BIGINT) AS dl, trunc((us - sched_us) / 1000000) - taxi AS err FROM mv WHERE phase = 'DEP')
    SELECT count(*) AS n, round(avg(dl), 6) AS mean, round(stddev_samp(dl), 6) AS std, round(median(dl), 6) AS p50, round(avg(CASE WHEN dl < 0 THEN 1.0 ELSE 0 END), 6) AS early_share, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(err), 6) AS bias,
      {_NEAR.format(v="dl", q=0.1)} AS p10, {_NEAR.format(v="dl", q=0.9)} AS p90 FROM x"""
)
def c8_schedule(spark, d):
    """The delay's distribution and the schedule as a predictor."""
    return _rounded(ev.check_schedule(movements(spark, d), NAMES), "mean", "std", "p50", "early_share", "rmse", "bias")


# Sources, ingest and outer joins

_TEXT = """raw AS (SELECT event_id AS obs_id, event_id AS k, 'A' || (user_id % 4) AS station, CASE WHEN event_id % 17 = 0 THEN NULL ELSE epoch_us(date_trunc('minute', ts)) END AS valid_us,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(20 + event_id % 50 AS DOUBLE) END AS tmpf, CAST(15 + event_id % 40 AS DOUBLE) AS dwpf, CAST(event_id % 11 AS DOUBLE) AS vsby, CAST(event_id % 30 AS DOUBLE) AS sknt, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 4 AS DOUBLE) / 10 END AS p01i,
    CAST(event_id % 9 * 1000 AS DOUBLE) AS skyl1, [NULL, '-SHSN', 'FZFG', 'TSRA BR', 'RA', 'GS'][event_id % 6 + 1] AS wx FROM events),
  flg AS (SELECT *, coalesce(wx, '') AS w FROM raw)"""


@query(
    f"""WITH {_TEXT} SELECT station, valid_us, round((tmpf - 32) * 5 / 9, 6) AS temperature_c, round((dwpf - 32) * 5 / 9, 6) AS dewpoint_c, round(vsby * 1.609344, 6) AS visibility_km, round(sknt * 0.514444, 6) AS wind_ms,
    round(p01i * 25.4, 6) AS precip_mm, round(skyl1 * 0.3048, 6) AS ceiling_m, w LIKE '%FZ%' AS freezing_precip, w LIKE '%SN%' OR w LIKE '%GS%' AS snow, w LIKE '%FG%' OR w LIKE '%BR%' AS fog, w LIKE '%TS%' AS thunderstorm,
    w LIKE '%FZ%' OR w LIKE '%SN%' OR w LIKE '%GS%' OR ((tmpf - 32) * 5 / 9 <= 3 AND coalesce(p01i, 0) > 0) AS deicing_proxy, vsby * 1.609344 < 1.5 AS low_visibility FROM flg"""
)
def d25_observations(spark, d):
    """Text rows to metric observations with flags."""
    out = ingest.observations(s.raw_observations(spark, d)).withColumn("valid_us", micros("valid"))
    return _rounded(out.drop("valid", "wxcodes", "skyc1", "wind_dir_deg"), "temperature_c", "dewpoint_c", "visibility_km", "wind_ms", "precip_mm", "ceiling_m")


@query(
    f"""WITH {SHEET} SELECT APT_ICAO AS apt, CAST(YR AS INTEGER) AS year, CAST(MONTH_NUM AS INTEGER) AS month_num, TF AS flights, VALID_FL AS valid_flights, round(TOTAL_REF_TIME_MIN / nullif(TOTAL_REF_NB_FL, 0), 6) AS reference_min,
    round(TOTAL_ADD_TIME_MIN / nullif(TOTAL_REF_NB_FL, 0), 6) AS additional_min, round(1 - VALID_FL / TF, 6) AS no_reference_share FROM sheet WHERE APT_ICAO <> 'A5'"""
)
def d26_official_sheet(spark, d):
    """Ratios of sums by airport and month."""
    out = ingest.official_taxi_out(s.official_sheet(spark, d), ("A0", "A1", "A2", "A3", "A4"))
    return _rounded(out, "reference_min", "additional_min", "no_reference_share")


_DAYS = """sl AS (SELECT 'A' || (o_custkey % 4) AS apt, CAST(o_orderdate AS DATE) AS day, count(*) AS dep, count(*) FILTER (o_orderstatus = 'F') AS reg, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS late FROM orders GROUP BY 1, 2),
  ar AS (SELECT 'A' || (o_custkey % 4) AS apt, CAST(o_orderdate AS DATE) + 1 AS day, count(*) FILTER (o_orderstatus = 'O') AS arr, sum(o_orderkey % 10) AS dly FROM orders GROUP BY 1, 2)"""


def _daily(spark, d) -> DataFrame:
    """Shares by day of two sheets over every order.  Arrivals land a day after the order, so the sheets' days differ."""
    o = table(spark, d, "orders").withColumn("FLT_DATE", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")).withColumn("APT_ICAO", F.concat(F.lit("A"), (F.col("o_custkey") % 4).cast("string")))
    n = lambda x: F.count_if(x).cast("string")
    f = F.col("o_orderstatus") == "F"
    slots = o.groupBy("APT_ICAO", "FLT_DATE").agg(F.count("*").cast("string").alias("FLT_DEP_1"), n(f).alias("FLT_DEP_REG_1"), n(f & (F.col("o_totalprice") > 200000)).alias("FLT_DEP_OUT_LATE_1"), F.lit("0").alias("FLT_DEP_OUT_EARLY_1"))
    delays = o.withColumn("FLT_DATE", F.date_format(F.date_add(F.col("o_orderdate").cast("timestamp").cast("date"), 1), "yyyy-MM-dd")).groupBy("APT_ICAO", "FLT_DATE").agg(n(F.col("o_orderstatus") == "O").alias("FLT_ARR_1"), F.sum(F.col("o_orderkey") % 10).cast("string").alias("DLY_APT_ARR_1"))
    delays = delays.withColumns({f"DLY_APT_ARR_{c}_1": F.lit("0") for c in ingest.CAUSES})
    out = ingest.daily_state(slots, delays, ("A0", "A1", "A2", "A3"))
    share = [F.round(F.col(c).cast("double"), 5).alias(c) for c in ("atfm_regulated_share", "atfm_slot_late_share", "arr_atfm_delay_min")]
    return out.select("apt", "day", *share, F.col("daily_departures").cast("double").alias("daily_departures"), F.col("daily_arrivals").cast("double").alias("daily_arrivals"))


@query(
    f"""WITH {_DAYS} SELECT coalesce(sl.apt, ar.apt) AS apt, coalesce(sl.day, ar.day) AS day, round(CAST(CAST(reg / nullif(dep, 0) AS FLOAT) AS DOUBLE), 5) AS atfm_regulated_share, round(CAST(CAST(late / nullif(reg, 0) AS FLOAT) AS DOUBLE), 5) AS atfm_slot_late_share,
    CAST(dep AS DOUBLE) AS daily_departures, CAST(arr AS DOUBLE) AS daily_arrivals, round(CAST(CAST(dly / nullif(arr, 0) AS FLOAT) AS DOUBLE), 5) AS arr_atfm_delay_min FROM sl FULL JOIN ar ON sl.apt = ar.apt AND sl.day = ar.day"""
)
def d27_daily_state(spark, d):
    """Shares by day from two sheets, with a full join."""
    return _daily(spark, d)


@query("SELECT 'N' || s_nationkey AS icao, CAST(count(*) AS BIGINT) AS runway_count, round(CAST(max(s_suppkey * 10) AS DOUBLE), 3) AS longest_runway_ft, round(CAST(CAST(avg(s_suppkey * 10) AS FLOAT) AS DOUBLE), 3) AS mean_runway_ft FROM supplier WHERE s_nationkey < 20 AND s_suppkey % 5 <> 0 GROUP BY 1")
def d28_runway_summary(spark, d):
    """Open runways by airport."""
    raw = table(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("airport_ident"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '0' END").alias("closed"), (F.col("s_suppkey") * 10).cast("string").alias("length_ft"))
    out = ingest.runway_summary(raw, [f"N{i}" for i in range(20)])
    return out.select("icao", F.col("runway_count").cast("long").alias("runway_count"), *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("longest_runway_ft", "mean_runway_ft")])


@query("SELECT icao, latitude, longitude, elevation_ft FROM (SELECT 'N' || c_nationkey AS icao, CAST(c_custkey % 90 + 0.5 AS DOUBLE) AS latitude, CAST(c_custkey * 7 % 180 + 0.25 AS DOUBLE) AS longitude, CAST(c_custkey % 3000 AS DOUBLE) AS elevation_ft, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 90, c_custkey * 7 % 180, c_custkey % 3000) AS i FROM customer WHERE c_custkey % 4 <> 0) WHERE i = 1")
def d28_coordinates(spark, d):
    """One place for each airport."""
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ident"), F.when(k % 4 != 0, (k % 90 + 0.5).cast("string")).otherwise("unknown").alias("latitude_deg"), (k * 7 % 180 + 0.25).cast("string").alias("longitude_deg"), (k % 3000).cast("string").alias("elevation_ft")
    )
    return ingest.airport_coordinates(raw).withColumn("elevation_ft", F.col("elevation_ft").cast("double"))


_DEICE = f"""{OBS}, {SHEET}, mm AS (SELECT station AS apt, month(ts) AS m, avg(CASE WHEN deicing_proxy THEN 1.0 ELSE 0 END) AS deicing FROM obs GROUP BY 1, 2),
  of AS (SELECT APT_ICAO AS apt, CAST(MONTH_NUM AS BIGINT) AS m, TOTAL_ADD_TIME_MIN / nullif(TOTAL_REF_NB_FL, 0) AS additional_min, 1 - VALID_FL / TF AS nr FROM sheet),
  j AS (SELECT of.apt, of.m, nr, additional_min, mm.deicing * (1 + of.m) AS deicing FROM of JOIN mm ON of.apt = mm.apt)"""


def _regimes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Observations repeated for each month of the sheet: the stream spans one."""
    official = ingest.official_taxi_out(s.official_sheet(spark, d), ("A0", "A1", "A2", "A3"))
    months = ev.monthly_weather(s.observations(spark, d)).select("apt", "deicing")
    j = official.join(months, "apt").withColumn("deicing", F.col("deicing") * (1 + F.col("month_num")))
    return official, j


@query(
    f"""WITH {_DEICE} SELECT apt, count(*) AS n_months, round(corr(deicing, nr), 6) AS r_no_reference, round(corr(deicing, additional_min), 6) AS r_additional, round(avg(deicing), 6) AS mean_deicing,
    round(avg(CASE WHEN m IN (12, 1, 2) THEN additional_min END), 6) AS winter_additional, round(avg(CASE WHEN m IN (6, 7, 8) THEN additional_min END), 6) AS summer_additional FROM j GROUP BY 1"""
)
def d29_regimes(spark, d):
    """Correlations and seasonal means by airport."""
    _, j = _regimes(spark, d)
    m = F.col("month_num")
    out = j.groupBy("apt").agg(
        F.count("*").alias("n_months"), agg.pearson("deicing", "no_reference_share").alias("r_no_reference"), agg.pearson("deicing", "additional_min").alias("r_additional"), F.avg("deicing").alias("mean_deicing"),
        agg.mean_where("additional_min", m.isin(*ev.WINTER)).alias("winter_additional"), agg.mean_where("additional_min", m.isin(*ev.SUMMER)).alias("summer_additional"),
    )
    return _rounded(out, "r_no_reference", "r_additional", "mean_deicing", "winter_additional", "summer_additional")


@query(f"WITH {_DEICE} SELECT round(corr(deicing, nr), 6) AS r_no_reference, round(corr(deicing, additional_min), 6) AS r_additional FROM j")
def g12_correlation(spark, d):
    """Correlations over all months and airports."""
    _, j = _regimes(spark, d)
    return _rounded(j.agg(agg.pearson("deicing", "no_reference_share").alias("r_no_reference"), agg.pearson("deicing", "additional_min").alias("r_additional")), "r_no_reference", "r_additional")


@query(f"WITH {OBS} SELECT station AS apt, year(ts) AS year, month(ts) AS month_num, round(avg(CASE WHEN deicing_proxy THEN 1.0 ELSE 0 END), 6) AS deicing, round(avg(CASE WHEN snow THEN 1.0 ELSE 0 END), 6) AS snow, round(avg(CASE WHEN freezing_precip THEN 1.0 ELSE 0 END), 6) AS freezing, round(min(temperature_c), 6) AS min_temperature_c FROM obs GROUP BY 1, 2, 3")
def d29_monthly_weather(spark, d):
    """Weather by airport and month."""
    out = ev.monthly_weather(s.observations(spark, d))
    return _rounded(out.withColumn("year", F.col("year").cast("long")).withColumn("month_num", F.col("month_num").cast("long")), "deicing", "snow", "freezing", "min_temperature_c")


_PLACES = {"P0": (40.0, 10.0), "P1": (40.05, 10.05), "P2": (55.0, -3.0)}
_KINDS = ("click", "view", "error")


def _box(p: str) -> str:
    from math import cos, radians

    la, lo = _PLACES[p]
    return f"abs(latitude - {la}) < {10 / 111.0!r} AND abs(longitude - ({lo})) < {10 / (111.0 * max(0.1, cos(radians(la))))!r}"


@query(
    "WITH e AS (SELECT event_type AS type, CASE WHEN event_id % 3 = 0 THEN 55.0 ELSE 40.0 END + event_id % 100 / 500.0 AS latitude, CASE WHEN event_id % 3 = 0 THEN -3.0 ELSE 10.0 END + event_id % 70 / 300.0 AS longitude FROM events) "
    + " UNION ALL ".join(f"SELECT '{p}' AS apt, " + ", ".join(f"count(*) FILTER (type = '{k}' AND {_box(p)}) AS {k}" for k in _KINDS) + " FROM e" for p in (*_PLACES,))
)
def d30_event_coverage(spark, d):
    """Events in boxes about places, a column for each kind."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), (F.when(k % 3 == 0, 55.0).otherwise(40.0) + k % 100 / 500.0).alias("latitude"), (F.when(k % 3 == 0, -3.0).otherwise(10.0) + k % 70 / 300.0).alias("longitude"))
    return ev.event_coverage(e, _PLACES, _KINDS)


# The prediction file's rules, joins and sets


def _prediction(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every order in both files; keys of some are others in the template, so that keys are absent and extra."""
    o = table(spark, d, "orders")
    template = o.select(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END").alias("MVT_ID_mvt"))
    bad = F.expr("CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN double('NaN') WHEN o_orderkey % 107 = 0 THEN double('Infinity') WHEN o_orderkey % 109 = 0 THEN -1.0 ELSE o_totalprice / 50 END")
    return o.select(F.expr("CASE WHEN o_orderkey % 7 = 0 THEN -2 * o_orderkey - 1 ELSE o_orderkey END").alias("MVT_ID_mvt"), bad.alias("TAXITIME_SEC_mvt")), template


_PRED = """p AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -2 * o_orderkey - 1 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 107 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 109 = 0 THEN -1.0 ELSE o_totalprice / 50 END AS v FROM orders),
  t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS k FROM orders)"""


@query(
    f"""WITH {_PRED} SELECT count(*) AS n, count(DISTINCT k) AS n_keys, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_infinite, count(*) FILTER (isfinite(v) AND v < 0) AS n_negative,
    count(*) FILTER (isfinite(v) AND v > 7200) AS n_long, count(*) FILTER (isfinite(v) AND v < 60) AS n_short, round(avg(CASE WHEN isfinite(v) THEN v END), 6) AS mean, (SELECT count(*) FROM t WHERE k NOT IN (SELECT k FROM p)) AS n_absent,
    (SELECT count(*) FROM p WHERE k NOT IN (SELECT k FROM t)) AS n_extra, (SELECT count(*) FROM t) AS n_template FROM p"""
)
def d23_findings(spark, d):
    """Every count that the file's rules need."""
    return _rounded(sub.findings(*_prediction(spark, d)), "mean")


@query(f"WITH {_PRED}, q AS (SELECT k, v FROM p WHERE isfinite(v)) SELECT t.k AS \"MVT_ID_mvt\", round(coalesce(q.v, (SELECT median(v) FROM q)), 6) AS \"TAXITIME_SEC_mvt\" FROM t LEFT JOIN q ON t.k = q.k")
def m9_fill_missing(spark, d):
    """The template's keys, with the median where there is no prediction."""
    pred, template = _prediction(spark, d)
    return _rounded(sub.fill_missing(pred.where("TAXITIME_SEC_mvt < double('Infinity')"), template), "TAXITIME_SEC_mvt")


@query("SELECT o_custkey AS team, o_totalprice AS score, epoch_us(o_orderdate) AS submitted, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderdate, o_custkey) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def g19_leaderboard(spark, d):
    """Each team's best score, ranked."""
    from .model import leaderboard

    items = table(spark, d, "orders").select(F.col("o_custkey").alias("team"), F.col("o_totalprice").alias("score"), micros("o_orderdate").alias("submitted"), "o_orderkey")
    return leaderboard(items).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS DOUBLE) AS x, n_name AS label FROM nation UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer")
def s1_union_relaxed(spark, d):
    """Files of different types and columns in one frame."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("smallint").alias("x"), F.col("n_name").alias("label"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.lit(None).cast("string").alias("label"))
    return union_relaxed([a, b])


@query("SELECT CAST(greatest(m, DATE '2025-01-15') AS DATE) AS begin, CAST(least(m + INTERVAL 1 MONTH, DATE '2025-04-10') AS DATE) AS stop FROM (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-04-09', INTERVAL 1 MONTH)) AS m)")
def t5_month_edges(spark, d):
    """T5: months of a span, held to it."""
    return month_edges(spark, "2025-01-15", "2025-04-10")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END, (SELECT avg(l_extendedprice) FROM lineitem WHERE l_partkey % 3 <> 0)), 4) AS filled FROM lineitem")
def p11_fill_mean(spark, d):
    """Unknown values filled with the mean."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END").alias("x"))
    return filled_with_mean(li, "x").select("l_orderkey", "l_linenumber", "l_partkey", F.round("x", 4).alias("filled"))


@query("WITH l AS (SELECT DISTINCT p_type AS v FROM part WHERE p_partkey % 2 = 0 AND p_type <> 'PROMO'), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM l) SELECT p_partkey, CAST(coalesce(code, -1) AS DOUBLE) AS code FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p FROM part) LEFT JOIN c ON p = v")
def m1_level_codes(spark, d):
    """M1: codes from the training side; null and unknown levels are -1."""
    from .model import encode, level_codes

    p = table(spark, d, "part")
    codes = level_codes(p.where("p_partkey % 2 = 0 AND p_type <> 'PROMO'"), "p_type")
    return encode(p.select("p_partkey", F.expr("CASE WHEN p_partkey % 11 <> 0 THEN p_type END").alias("code")), {"code": codes})


# The whole feature table


def _whole(x: str) -> str:
    return f"CAST(trunc(({x}) / 1000000) AS BIGINT)"


def _float(x: str) -> str:
    """A feature as it is kept (float32), to three places; no negative zero."""
    v = f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 3)"
    return f"CASE WHEN {v} = 0 THEN CAST(0 AS DOUBLE) ELSE {v} END"


def _table_sql(causal: bool) -> str:
    """The feature table out of its parts' SQL, by brute force."""
    at, ahead = ("block_us", False) if causal else ("us", True)
    count = lambda prefix, by, where: _counts_sql(prefix, by, at, where, True, ahead, ft.MINUTES)
    gap = f"g AS (SELECT id, apt, rwy, {at}, floor(({at} - lag({at}) OVER w) / 1000000) AS pg, floor((lead({at}) OVER w - {at}) / 1000000) AS ng FROM mv WHERE phase = 'DEP' WINDOW w AS (PARTITION BY apt, rwy ORDER BY {at}, id))"
    ends = ", be AS (SELECT apt, bin_us + 1800000000 AS start, med, n FROM b)" if causal else ", be AS (SELECT apt, bin_us AS start, med, n FROM b)"
    shift = " - 1" if causal else ""
    nexts = "" if causal else f"{_float('pg.ng')} AS next_dep_gap_sec, {_float(f'trunc((k.us - k.aobt_us) / 1000000)')} AS nm_naive_taxi_sec, k.aobt_us IS NOT NULL AS nm_matched, "
    return f"""WITH {MV}, {OBS}, {XY}, {gap}, {_BINS_SQL}{ends}, {_CONF_SQL}, {_GEO}, k AS (SELECT * FROM mv WHERE phase = 'DEP'),
      pg AS (SELECT id, pg, ng, CASE WHEN count(pg) OVER r >= 2 THEN avg(pg) OVER r END AS mean FROM g WINDOW r AS (PARTITION BY apt, rwy ORDER BY {at}, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
      n AS (SELECT id, {count('rwy_dep', RWY, DEP)}, {count('apt_arr', APT, ARR)}, {count('apt_dep', APT, DEP)} FROM mv k WHERE phase = 'DEP'),
      z AS (SELECT h.id, h.apt, h.us, mv.{at} AS at, brg, km, floor(brg / 30) % 12 AS sec FROM h JOIN mv ON h.id = mv.id),
      sc AS (SELECT k.id, brg, km, sec, {', '.join(f"(SELECT count(*) FROM z e WHERE e.apt = k.apt AND e.sec = k.sec AND e.us > k.at - {m * MINUTE} AND e.us <= k.at) AS sector_dep_prev_{m}m" for m in ft.SECTOR_MINUTES)} FROM z k),
      ti AS (SELECT k.id, be.med, be.n FROM k ASOF LEFT JOIN be ON k.apt = be.apt AND k.{at} >= be.start),
      st AS (SELECT k.id, a.block_us AS arrived FROM k ASOF LEFT JOIN (SELECT apt, stand, block_us FROM mv WHERE phase = 'ARR') a ON k.apt = a.apt AND k.stand = a.stand AND k.{at} >= a.block_us),
      we AS (SELECT k.id, temperature_c, dewpoint_c, snow, freezing_precip, deicing_proxy, obs.us AS seen FROM k ASOF LEFT JOIN obs ON k.apt = obs.station AND k.{at} >= obs.us)
    SELECT n.*, {nexts}{_float('pg.pg')} AS prev_dep_gap_sec, {_float('pg.mean')} AS rwy_service_interval_sec, {_float('apt_arr_prev_30m / nullif(apt_dep_prev_30m + apt_arr_prev_30m, 0)')} AS arr_dep_ratio_30m,
      {_float('ti.med')} AS arr_taxi_median_sec, coalesce(ti.n, 0) AS arr_taxi_count, dep_runways_in_use, arr_runways_in_use, active_runway_count,
      CAST(hour(make_timestamp(k.{at})) AS BIGINT) AS hour, CAST(isodow(make_timestamp(k.{at})) AS BIGINT) AS weekday, CAST(month(make_timestamp(k.us)) AS BIGINT) AS month_num, CAST(hour(make_timestamp(k.{at})) * 60 + minute(make_timestamp(k.{at})) AS BIGINT) AS minute_of_day,
      {_float(_whole(f'k.{at} - sched_us'))} AS sched_offset_sec, {_float(_whole(f'k.{at} - eobt_us'))} AS eobt_offset_sec, {_float(_whole('lobt_us - iobt_us'))} AS atfm_drift_sec, {_float(_whole(f'k.{at} - lobt_us'))} AS lobt_anchor_gap_sec, filed <> ades AS diverted,
      {_float('brg')} AS departure_bearing, {_float('CASE WHEN brg IS NULL THEN NULL ELSE km END')} AS flight_distance_km, CAST(sec AS BIGINT) AS departure_sector, {', '.join(f'sector_dep_prev_{m}m' for m in ft.SECTOR_MINUTES)}, {_float(_whole(f'k.{at} - arrived'))} AS stand_turnaround_sec,
      {_float('temperature_c')} AS temperature_c, {_float('dewpoint_c')} AS dewpoint_c, snow, freezing_precip, deicing_proxy, {_float(_whole(f'k.{at} - seen') + ' / 60')} AS observation_age_min, {_float('temperature_c - dewpoint_c')} AS dewpoint_spread_c
    FROM k JOIN n ON k.id = n.id JOIN pg ON k.id = pg.id JOIN sc ON k.id = sc.id JOIN ti ON k.id = ti.id JOIN st ON k.id = st.id JOIN we ON k.id = we.id LEFT JOIN c ON k.apt = c.apt AND k.{at} // 1800000000{shift} = c.k"""


def _shown(df: DataFrame) -> DataFrame:
    """id and the features: fractions as they are kept, to three places, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if registry.is_declared(f.name) and f.name not in ("apt_mvt",):
            c = F.col(f.name)
            out.append((F.round(c.cast("float").cast("double"), 3) if kind in ("float", "double") else c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else c).alias(f.name))
    return df.select("id", *out)


@query(_table_sql(False))
def d19_build_features(spark, d):
    """The whole feature table."""
    return _shown(ft.build_features(movements(spark, d), coords=s.coordinates(spark, d), metar=s.observations(spark, d).drop("obs_id"), n=NAMES))


@query(_table_sql(True))
def d19_causal_features(spark, d):
    """D19 from off-block times, with strict bins."""
    return _shown(ft.build_features(movements(spark, d), coords=s.coordinates(spark, d), metar=s.observations(spark, d).drop("obs_id"), causal=True, strict=True, n=NAMES))


_FAMILY_SQL = """CASE WHEN c SIMILAR TO 'rwy_dep_(prev|next)_[0-9]+m' OR c IN ('prev_dep_gap_sec', 'next_dep_gap_sec', 'rwy_service_interval_sec') THEN 'runway_queue' WHEN c LIKE 'apt_dep_%' OR c LIKE 'apt_arr_%' OR c LIKE 'arr_dep_ratio_%' THEN 'airport_flow'
    WHEN c LIKE 'arr_taxi_%' THEN 'taxi_in_pressure' WHEN c LIKE '%_runways_in_use' OR c = 'active_runway_count' THEN 'runway_configuration' WHEN c IN ('hour', 'weekday', 'month_num', 'minute_of_day') THEN 'calendar'
    WHEN c IN ('sched_offset_sec', 'eobt_offset_sec', 'atfm_drift_sec', 'lobt_anchor_gap_sec', 'diverted') THEN 'atfm' WHEN c LIKE 'nm_%' THEN 'nm_aobt' WHEN c IN ('departure_bearing', 'departure_sector', 'flight_distance_km') OR c LIKE 'sector_dep_%' THEN 'routing'
    WHEN c = 'stand_turnaround_sec' THEN 'stand_turnaround' WHEN c IN ('temperature_c', 'dewpoint_c', 'snow', 'freezing_precip', 'deicing_proxy', 'observation_age_min', 'dewpoint_spread_c') THEN 'weather' END"""
_RAW = "id phase adep ades apt rwy stand ts block sched taxi flight aobt eobt lobt iobt filed".split()


@query(f"WITH f AS (SELECT unnest({_RAW!r}) AS c UNION ALL SELECT column_name FROM (DESCRIBE {_table_sql(False)}) WHERE column_name <> 'id') SELECT c AS \"column\", {_FAMILY_SQL} AS family FROM f")
def d22_families(spark, d):
    """The family of every column of the feature table; null for columns that no operator makes."""
    f = ft.build_features(movements(spark, d), coords=s.coordinates(spark, d), metar=s.observations(spark, d).drop("obs_id"), n=NAMES)
    return registry.with_family(spark.createDataFrame([(c,) for c in f.columns], "column string"))


@query(f"SELECT column_name AS \"column\" FROM (DESCRIBE {_table_sql(False)}) WHERE column_name <> 'id' UNION ALL SELECT unnest(['apt', 'rwy', 'stand'])")
def d20_model_columns(spark, d):
    """The columns that a model may read."""
    f = ft.build_features(movements(spark, d), coords=s.coordinates(spark, d), metar=s.observations(spark, d).drop("obs_id"), n=NAMES)
    return spark.createDataFrame([(c,) for c in model_columns(f, NAMES)], "column string")


@query(
    f"""WITH {MV}, d AS (SELECT *, day(make_timestamp(us)) > 20 AS held FROM mv WHERE phase = 'DEP'), c AS (SELECT * FROM d WHERE NOT held AND taxi > 0 AND taxi <= 7200),
    {_level_sql("apt, stand, rwy", "a", "c.apt = aq.apt AND c.stand = aq.stand AND c.rwy = aq.rwy")}, {_level_sql("apt, stand", "b", "c.apt = bq.apt AND c.stand = bq.stand")},
    {_level_sql("apt, rwy", "e", "c.apt = eq.apt AND c.rwy = eq.rwy")}, {_level_sql("apt", "f", "c.apt = fq.apt")}
    SELECT t.id, held, round(CAST(CAST(coalesce(CASE WHEN a.valid THEN a.p END, CASE WHEN b.valid THEN b.p END, CASE WHEN e.valid THEN e.p END, CASE WHEN f.valid THEN f.p END) AS FLOAT) AS DOUBLE), 3) AS reference_sec,
      CASE WHEN a.valid THEN 'apt_stand_rwy' WHEN b.valid THEN 'apt_stand' WHEN e.valid THEN 'apt_rwy' WHEN f.valid THEN 'apt' ELSE 'none' END AS reference_level, coalesce(a.n, 0) AS reference_sample
    FROM d t LEFT JOIN a ON t.apt = a.apt AND t.stand = a.stand AND t.rwy = a.rwy LEFT JOIN b ON t.apt = b.apt AND t.stand = b.stand LEFT JOIN e ON t.apt = e.apt AND t.rwy = e.rwy LEFT JOIN f ON t.apt = f.apt WHERE held OR taxi <= 60"""
)
def d21_seasonal_split(spark, d):
    """Both sides with the reference of the training side alone; long targets leave that side."""
    m = movements(spark, d)
    split = ev.seasonal_split(m.where("phase = 'DEP'"), m, longest=60.0, n=NAMES, mask=F.dayofmonth("ts") > 20)
    side = lambda f, held: f.select("id", F.lit(held).alias("held"), F.round(F.col("reference_sec").cast("double"), 3).alias("reference_sec"), "reference_level", "reference_sample")
    return side(split.fit, False).unionByName(side(split.held, True))


# Files: written to the shared folder and read again


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skyfold-{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s4_csv_inferred(spark, d):
    """A CSV file whose types are inferred."""
    path = _folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    out = read_csv(spark, path, infer=True)
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN round(s_acctbal, 2) END AS s_acctbal FROM supplier")
def s5_csv_schema(spark, d):
    """A CSV file read as text, with numbers where a cell is one."""
    path = _folder(spark, "sheet")
    table(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_acctbal AS STRING) ELSE 'n/a' END").alias("s_acctbal")).write.option("header", True).csv(path)
    out = read_sheet(spark, path, ["s_suppkey", "s_acctbal"])
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS DOUBLE) AS x FROM nation UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def s2_read_many(spark, d):
    """Parquet files whose types differ in one frame; a file that isn't there is none."""
    path = _folder(spark, "many")
    assert read_optional(spark, f"{path}/absent") is None
    table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_nationkey").cast("smallint").alias("x")).write.parquet(f"{path}/a")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x")).write.parquet(f"{path}/b")
    return read_many(spark, f"{path}/a", f"{path}/b", f"{path}/absent")


@query("SELECT r_name AS team, n_nationkey AS score FROM nation JOIN region ON n_regionkey = r_regionkey")
def s9_pages(spark, d):
    """The items of saved pages, a page for each region."""
    path = _folder(spark, "pages")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    page = n.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("r_name").alias("team"), F.col("n_nationkey").alias("score"))).alias("items"))
    page.select("n_regionkey", F.to_json(F.struct("items", F.lit("next").alias("nextCursor")))).write.partitionBy("n_regionkey").text(path)
    return read_pages(spark, path, "team: string, score: bigint")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1")
def k1_partitioned(spark, d):
    """K1: a table written by partition and read again."""
    path = _folder(spark, "parts")
    write_parquet(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query('SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, o_orderkey AS "MVT_ID_mvt", round(o_totalprice / 50, 6) AS "TAXITIME_SEC_mvt" FROM orders')
def d24_prediction_file(spark, d):
    """One file in the template's order, under the next version's name."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("MVT_ID_mvt"), (F.col("o_totalprice") / 50).alias("TAXITIME_SEC_mvt"))
    folder = _folder(spark, "predictions")
    template = o.orderBy(F.desc("TAXITIME_SEC_mvt"), "MVT_ID_mvt").select("MVT_ID_mvt")
    for _ in range(2):
        name = f"team_v{sub.next_version(folder, 'team', spark)}.parquet"
        sub.write(o, template, folder, name)
    out = spark.read.parquet(f"{folder}/team_v2.parquet").coalesce(1)
    return out.select(F.monotonically_increasing_id().alias("pos"), "MVT_ID_mvt", F.round("TAXITIME_SEC_mvt", 6).alias("TAXITIME_SEC_mvt"))


@query(f"WITH {MV} SELECT k.id, (SELECT count(*) FROM mv e WHERE e.apt = k.apt AND e.us > k.us - 3600000000 AND e.us <= k.us) AS prev, (SELECT count(*) FROM mv e WHERE e.apt = k.apt AND e.us > k.us AND e.us <= k.us + 3600000000) AS next FROM mv k")
def p8_anchor_is_event(spark, d):
    """Every movement is an anchor and an event; its own time counts as past."""
    m = movements(spark, d).select("id", "apt", "ts")
    return range_counts(m, m, ["apt"], "ts", "ts", {"prev": (60 * MINUTE, 0), "next": (0, 60 * MINUTE)}).drop("apt", "ts")


@query()
def m3_train_predict(spark, d):
    """Split, encode, train on the residual, predict."""
    from .model import train_predict

    m = movements(spark, d)
    f = stored(ft.offsets(ft.runway_features(m, "ts", True, WIDE, NAMES), "ts", NAMES), "features")  # both sides read it
    mask = F.dayofmonth("ts") > 20
    split = ev.seasonal_split(f, m, n=NAMES, mask=mask)
    columns = [c for c in split.columns if c.startswith(("rwy_dep_", "reference_", "prev_", "hour", "weekday", "minute"))]
    return train_predict(split, columns, rounds=3, n=NAMES).select("id", "taxi", "prediction")
