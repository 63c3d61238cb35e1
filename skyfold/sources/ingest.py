"""External tables from their files as published (spreadsheets exported to CSV or Parquet first)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import KM_IN_MILE, M_IN_FOOT, MM_IN_INCH, MS_IN_KNOT, col, fahrenheit_to_celsius, has_code, number, parse_minute, ratio
from ..operators.aggregates import first_of
from ..plans.movements import AIRPORTS
from ..plans.registry import makes

# Weather codes by flag.
FREEZING = ("FZRA", "FZDZ", "FZFG")
SNOW = ("SN", "SG", "PL", "IC", "GS", "GR")
FOG = ("FG", "BR")
THUNDER = ("TS",)
# Limits of the flags.
ICING_C, LOW_VISIBILITY_KM = 3.0, 1.5
# Delay causes by their code.
CAUSES = {"W": "weather", "C": "atc_capacity", "G": "aerodrome_capacity", "S": "atc_staffing", "T": "atc_equipment"}


def observations(raw: DataFrame) -> DataFrame:
    """Weather observations in metric units with flags.  A flag of unknown parts is unknown, unless another part is true."""
    t, v = fahrenheit_to_celsius(number("tmpf")), number("vsby") * KM_IN_MILE
    freezing, snow = has_code("wxcodes", FREEZING), has_code("wxcodes", SNOW)
    wet = (t <= ICING_C) & (F.coalesce(number("p01i"), F.lit(0.0)) > 0)
    return raw.select(
        "station", parse_minute("valid").alias("valid"), t.alias("temperature_c"), fahrenheit_to_celsius(number("dwpf")).alias("dewpoint_c"), v.alias("visibility_km"),
        (number("sknt") * MS_IN_KNOT).alias("wind_ms"), number("drct").alias("wind_dir_deg"), (number("p01i") * MM_IN_INCH).alias("precip_mm"), (number("skyl1") * M_IN_FOOT).alias("ceiling_m"),
        "wxcodes", "skyc1", freezing.alias("freezing_precip"), snow.alias("snow"), has_code("wxcodes", FOG).alias("fog"), has_code("wxcodes", THUNDER).alias("thunderstorm"),
        (freezing | snow | wet).alias("deicing_proxy"), (v < LOW_VISIBILITY_KM).alias("low_visibility"),
    )


def official_taxi_out(sheet: DataFrame, airports: Sequence[str] = AIRPORTS) -> DataFrame:
    """Reference and additional minutes for each departure, by airport and month."""
    d = sheet.where(F.col("APT_ICAO").isin(*airports) & (F.col("TF") > 0))
    return d.select(
        F.col("APT_ICAO").alias("apt"), col("YEAR").try_cast("int").alias("year"), col("MONTH_NUM").try_cast("int").alias("month_num"), F.col("TF").alias("flights"), F.col("VALID_FL").alias("valid_flights"),
        ratio("TOTAL_REF_TIME_MIN", "TOTAL_REF_NB_FL").alias("reference_min"), ratio("TOTAL_ADD_TIME_MIN", "TOTAL_REF_NB_FL").alias("additional_min"),
        (1 - ratio("VALID_FL", "TF")).alias("no_reference_share"),
    )


def daily_state(slots: DataFrame, delays: DataFrame, airports: Sequence[str] = AIRPORTS) -> DataFrame:
    """Slot shares and arrival delay by airport and day; days that only one sheet has stay."""
    day = col("FLT_DATE").try_cast("date").alias("day")
    apt = F.col("APT_ICAO").alias("apt")
    dep, reg = number("FLT_DEP_1"), number("FLT_DEP_REG_1")
    s = slots.where(F.col("APT_ICAO").isin(*airports)).select(
        apt, day, ratio(reg, dep).cast("float").alias("atfm_regulated_share"), ratio(number("FLT_DEP_OUT_LATE_1"), reg).cast("float").alias("atfm_slot_late_share"),
        ratio(number("FLT_DEP_OUT_EARLY_1"), reg).cast("float").alias("atfm_slot_early_share"), dep.cast("float").alias("daily_departures"),
    )
    arr = number("FLT_ARR_1")
    a = delays.where(F.col("APT_ICAO").isin(*airports)).select(
        apt, day, ratio(number("DLY_APT_ARR_1"), arr).cast("float").alias("arr_atfm_delay_min"), arr.cast("float").alias("daily_arrivals"),
        *[ratio(number(f"DLY_APT_ARR_{c}_1"), arr).cast("float").alias(f"arr_delay_{name}_min") for c, name in CAUSES.items()],
    )
    return s.join(a, ["apt", "day"], "full")


def airport_coordinates(raw: DataFrame) -> DataFrame:
    """icao, latitude, longitude and elevation of all airports with a place, one row each (the least place, for ties)."""
    d = raw.select(F.col("ident").alias("icao"), number("latitude_deg").alias("latitude"), number("longitude_deg").alias("longitude"), number("elevation_ft").cast("float").alias("elevation_ft"))
    return first_of(d.where("latitude IS NOT NULL AND longitude IS NOT NULL"), ["icao"], [F.col("latitude"), F.col("longitude"), F.col("elevation_ft")])


@makes("geometry", "runway_count", "longest_runway_ft", "mean_runway_ft")
def runway_summary(raw: DataFrame, airports: Sequence[str] = AIRPORTS) -> DataFrame:
    """Open runways by airport: how many, the longest and the mean length."""
    d = raw.where(F.col("airport_ident").isin(*airports) & (col("closed").try_cast("int") == 0))
    length = number("length_ft")
    return d.groupBy(F.col("airport_ident").alias("icao")).agg(
        F.count("*").alias("runway_count"), F.max(length).cast("float").alias("longest_runway_ft"), F.avg(length).cast("float").alias("mean_runway_ft")
    )
