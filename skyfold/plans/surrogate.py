"""Movement-shaped views of the driver's tables: the roles of SURVEY §7.5, in Spark and as the SQL they are held to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros
from .movements import Names

NAMES = Names(
    key="id", phase="phase", origin="adep", destination="ades", airport="apt", runway="rwy", stand="stand", moved="ts", block="block", scheduled="sched", taxi="taxi",
    flight="flight", off_block="aobt", estimated="eobt", last_off_block="lobt", first_off_block="iobt", filed="filed",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(us):
    return F.timestamp_micros(us.cast("long"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us, v = micros("ts"), F.round(F.col("value") * 1_000_000).cast("long")
    dep = F.col("event_type").isin("click", "view", "purchase")
    here, far = F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string")), F.concat(F.lit("A"), (F.col("event_id") % 7).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.when(dep, "DEP").otherwise("ARR").alias("phase"), F.when(dep, here).otherwise(far).alias("adep"), F.when(dep, far).otherwise(here).alias("ades"),
        here.alias("apt"), F.concat(F.lit("R"), (F.col("event_id") % 2).cast("string")).alias("rwy"), F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("stand"),
        _instant(us).alias("ts"), _instant(us - v).alias("block"), _instant(us - 2 * v + 30_000_000).alias("sched"), F.col("value").alias("taxi"),
        F.when(F.col("event_id") % 60 != 0, F.col("event_id")).alias("flight"), F.when(F.col("event_id") % 11 != 0, _instant(us - v + 1_500_000)).alias("aobt"),
        _instant(us - v - 120_000_000).alias("eobt"), _instant(us - v - 60_000_000 + F.col("event_id") % 1000 * 1000).alias("lobt"), _instant(us - v - 240_000_000).alias("iobt"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("A"), (F.col("event_id") % 5).cast("string"))).alias("filed"),
    )


#: The same in SQL, times as microseconds.
MV = """mv AS (
  SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'DEP' ELSE 'ARR' END AS phase,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'A' || (user_id % 4) ELSE 'A' || (event_id % 7) END AS adep,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'A' || (event_id % 7) ELSE 'A' || (user_id % 4) END AS ades,
    'A' || (user_id % 4) AS apt, 'R' || (event_id % 2) AS rwy, 'S' || (user_id % 20) AS stand, epoch_us(ts) AS us, value AS taxi,
    epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT) AS block_us, epoch_us(ts) - 2 * CAST(round(value * 1000000) AS BIGINT) + 30000000 AS sched_us,
    CASE WHEN event_id % 60 <> 0 THEN event_id END AS flight,
    CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT) + 1500000 END AS aobt_us,
    epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT) - 120000000 AS eobt_us,
    epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT) - 60000000 + event_id % 1000 * 1000 AS lobt_us,
    epoch_us(ts) - CAST(round(value * 1000000) AS BIGINT) - 240000000 AS iobt_us,
    CASE WHEN event_id % 13 <> 0 THEN 'A' || (event_id % 5) END AS filed
  FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as weather observations of an airport; a sixth have no dew point."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string")).alias("station"), _instant(micros("ts")).alias("valid"), (F.col("value") / 10 - 5).alias("temperature_c"),
        F.when(F.col("event_id") % 6 != 0, F.col("value") / 20 - 6).alias("dewpoint_c"), F.col("event_id").alias("obs_id"), (F.col("value") < 20).alias("snow"),
        (F.col("value") < 10).alias("freezing_precip"), (F.col("value") < 40).alias("deicing_proxy"),
    )


OBS = """obs AS (
  SELECT 'A' || (user_id % 4) AS station, epoch_us(ts) AS us, value / 10 - 5 AS temperature_c, CASE WHEN event_id % 6 <> 0 THEN value / 20 - 6 END AS dewpoint_c, event_id AS obs_id,
    value < 20 AS snow, value < 10 AS freezing_precip, value < 40 AS deicing_proxy, ts
  FROM events WHERE event_type = 'error')"""


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as airports; that of nation 6 has another name, so that a destination is unknown."""
    k = F.col("n_nationkey")
    place = F.pmod(k, F.lit(17))
    return table(spark, sf_dir, "nation").select(F.concat(F.when(k == 6, "X").otherwise("A"), k.cast("string")).alias("icao"), (35.0 + place * 3.25).alias("latitude"), (-4.0 + place * 5.5).alias("longitude"))


XY = "xy AS (SELECT CASE WHEN n_nationkey = 6 THEN 'X' ELSE 'A' END || n_nationkey AS icao, CAST(35.0 + n_nationkey % 17 * 3.25 AS DOUBLE) AS latitude, CAST(-4.0 + n_nationkey % 17 * 5.5 AS DOUBLE) AS longitude FROM nation)"


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an archive's text rows: numbers that don't parse, codes, and times to the minute."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    text = lambda x: x.cast("string")
    return e.select(
        F.concat(F.lit("A"), text(F.col("user_id") % 4)).alias("station"),
        F.when(k % 17 == 0, "no time").otherwise(F.date_format(_instant(micros("ts")), "yyyy-MM-dd HH:mm")).alias("valid"),
        F.when(k % 9 == 0, "M").otherwise(text(20 + k % 50)).alias("tmpf"), text(15 + k % 40).alias("dwpf"), text(k % 11).alias("vsby"), text(k % 30).alias("sknt"), text(k % 360).alias("drct"),
        F.when(k % 5 == 0, text((k % 4) / 10)).alias("p01i"), text(k % 9 * 1000).alias("skyl1"),
        F.element_at(F.array(*[F.lit(x) for x in (None, "-SHSN", "FZFG", "TSRA BR", "RA", "GS")]), (k % 6 + 1).cast("int")).alias("wxcodes"), F.lit("OVC").alias("skyc1"), k.alias("obs_id"),
    )


def official_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment's customer nation as an airport-month sheet."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return o.groupBy(F.concat(F.lit("A"), (F.col("o_custkey") % 6).cast("string")).alias("APT_ICAO"), F.year("o_orderdate").cast("string").alias("YEAR"), F.month("o_orderdate").cast("string").alias("MONTH_NUM")).agg(
        F.count("*").alias("TF"), F.count_if(F.col("o_orderstatus") == "F").alias("VALID_FL"), F.count_if(F.col("o_orderstatus") != "P").alias("TOTAL_REF_NB_FL"),
        F.sum(F.col("o_orderkey") % 97).cast("double").alias("TOTAL_REF_TIME_MIN"), F.sum(F.col("o_orderkey") % 89).cast("double").alias("TOTAL_ADD_TIME_MIN"),
    )


SHEET = """sheet AS (
  SELECT 'A' || (o_custkey % 6) AS APT_ICAO, CAST(year(o_orderdate) AS VARCHAR) AS YR, CAST(month(o_orderdate) AS VARCHAR) AS MONTH_NUM, count(*) AS TF, count(*) FILTER (o_orderstatus = 'F') AS VALID_FL,
    count(*) FILTER (o_orderstatus <> 'P') AS TOTAL_REF_NB_FL, CAST(sum(o_orderkey % 97) AS DOUBLE) AS TOTAL_REF_TIME_MIN, CAST(sum(o_orderkey % 89) AS DOUBLE) AS TOTAL_ADD_TIME_MIN
  FROM orders GROUP BY 1, 2, 3)"""
