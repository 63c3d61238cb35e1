"""A seeded movement table and its external tables, for tests and demonstrations: expressions over a range of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The airports that the tables are about.
TEN = ("EDDF", "EDDM", "EGLL", "EHAM", "LEBL", "LEMD", "LFPG", "LIRF", "LSZH", "LTFM")


def _draw(seed: int, *key: Column) -> Column:
    """A number from 0 to below 1 that depends on the seed and the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)).cast("double") / (1 << 30)


def _one_of(values: tuple[str, ...], x: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(x * len(values)) + 1).cast("int"))


def movements(spark: SparkSession, rows: int, start: str = "2025-01-01", days: int = 365, seed: int = 1, airports: tuple[str, ...] = TEN) -> DataFrame:
    """rows movements, as many departures as arrivals: times, stands, runways, taxi times, and the network's columns."""
    i = F.col("id")
    pick = lambda k: _draw(seed, F.lit(k), i)
    d = spark.range(rows).withColumn("PHASE_mvt", F.when(i % 2 == 0, "DEP").otherwise("ARR"))
    here, far = _one_of(airports, pick(1)), _one_of(airports, pick(2))
    # two seconds of the day are drawn, and the later hours are busier
    at = F.floor(F.greatest(pick(3), pick(4)) * 86_400) + F.floor(pick(5) * days) * 86_400
    taxi = (300 + F.floor(-F.log(1 - pick(6) * 0.999) * 300)).cast("long")
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    sec = lambda x: F.timestamp_seconds(x)
    out = pick(7) >= 0.015
    d = d.select("id", "PHASE_mvt", here.alias("_h"), far.alias("_f"), (base + at).alias("_t"), taxi.alias("_x"), out.alias("_known"), pick(8).alias("_r"), pick(9).alias("_s"), pick(10).alias("_d"), pick(11).alias("_o"))
    departs = F.col("PHASE_mvt") == "DEP"
    block = F.when(departs, F.col("_t") - F.col("_x")).otherwise(F.col("_t") + F.col("_x"))
    planned = block - F.floor(F.col("_d") * 1800 - 300)
    known = lambda x: F.when(F.col("_known"), x)
    return d.select(
        F.col("id").alias("MVT_ID_mvt"), known(F.col("id") + 10_000_000).alias("FLIGHT_ID_mvt"), "PHASE_mvt",
        F.when(departs, F.col("_h")).otherwise(F.col("_f")).alias("ADEP_mvt"), F.when(departs, F.col("_f")).otherwise(F.col("_h")).alias("ADES_mvt"),
        sec(F.col("_t")).alias("MVT_TIME_UTC_mvt"), sec(block).alias("BLOCK_TIME_UTC_mvt"), sec(planned).alias("SCHED_TIME_UTC_mvt"),
        _one_of(("A320", "B738", "A21N", "E190"), F.col("_o")).alias("AIRCRAFT_TYPE_mvt"), _one_of(("09L", "27R", "18"), F.col("_r")).alias("RUNWAY_mvt"),
        F.concat(F.lit("S"), F.floor(F.col("_s") * 25).cast("string")).alias("STAND_mvt"), F.col("_x").alias("TAXITIME_SEC_mvt"),
        known(sec(planned + 300)).alias("LOBT_flt"), known(sec(planned)).alias("IOBT_flt"), known(sec(planned + 120)).alias("EOBT_1_flt"),
        known(F.timestamp_micros(block * 1_000_000 + F.floor((F.col("_o") - 0.5) * 60_000_000))).alias("AOBT_3_flt"), known(F.when(departs, F.col("_f")).otherwise(F.col("_h"))).alias("ADES_FILED_flt"),
    )


def coordinates(spark: SparkSession, seed: int = 1, airports: tuple[str, ...] = TEN) -> DataFrame:
    d = spark.createDataFrame([(a,) for a in airports], "icao string")
    return d.select("icao", (36 + _draw(seed, F.col("icao")) * 18).alias("latitude"), (-4 + _draw(seed + 1, F.col("icao")) * 34).alias("longitude"))


def metar(spark: SparkSession, start: str = "2025-01-01", days: int = 365, seed: int = 1, airports: tuple[str, ...] = TEN) -> DataFrame:
    """An observation each half hour."""
    d = spark.range(days * 48).withColumn("station", F.explode(F.array(*[F.lit(a) for a in airports])))
    at = F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + F.col("id") * 1800)
    t = 10 + 15 * F.sin(F.col("id") / 48.0 / 58.0 - 1.6) + 4 * _draw(seed, F.col("station"), F.col("id"))
    wet = _draw(seed + 1, F.col("station"), F.col("id")) < 0.1
    d = d.select("station", at.alias("valid"), t.alias("temperature_c"), wet.alias("_wet"))
    cold = F.col("_wet") & (F.col("temperature_c") < 1)
    return d.select(
        "station", "valid", "temperature_c", (F.col("temperature_c") - 3).alias("dewpoint_c"), F.lit(10.0).alias("visibility_km"), F.lit(4.0).alias("wind_ms"),
        F.when(F.col("_wet"), 0.5).otherwise(0.0).alias("precip_mm"), F.lit(900.0).alias("ceiling_m"), F.lit(False).alias("freezing_precip"), cold.alias("snow"), F.lit(False).alias("fog"),
        F.lit(False).alias("thunderstorm"), (cold | (F.col("_wet") & (F.col("temperature_c") <= 3))).alias("deicing_proxy"), F.lit(False).alias("low_visibility"),
    )
