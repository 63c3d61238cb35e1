"""Scalar expressions: times, conversions, flags and null handling."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since 1970; time-zone-less values are read as UTC under a UTC session."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole seconds, cut toward zero; null if either is."""
    return F.expr("NULL").cast("long") if later is None or earlier is None else _cut(micros(later) - micros(earlier))


def _cut(us: Column) -> Column:
    return F.when(us >= 0, F.floor(us / 1_000_000)).otherwise(F.ceil(us / 1_000_000)).cast("long")


def null_if_zero(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(0))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return col(a).cast("double") / null_if_zero(col(b).cast("double"))


def number(c: str | Column) -> Column:
    """A double, or null where the text isn't one."""
    return col(c).try_cast("double")


def parse_minute(c: str | Column) -> Column:
    """'yyyy-MM-dd HH:mm' as an instant, else null."""
    return F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd HH:mm"))


def parse_time(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c))


def has_code(c: str | Column, codes: tuple[str, ...]) -> Column:
    """Whether the text contains any of the codes; a null text contains none."""
    text = F.coalesce(col(c), F.lit(""))
    return reduce(or_, [text.contains(code) for code in codes], F.lit(False))


def calendar(at: str | Column, month_of: str | Column | None = None) -> dict[str, Column]:
    """Hour, ISO weekday (Monday 1), month and minute of day.  month_of: another time for the month."""
    at = col(at)
    return {
        "hour": F.hour(at).cast("tinyint"),
        "weekday": (F.weekday(at) + 1).cast("tinyint"),
        "month_num": F.month(at if month_of is None else col(month_of)).cast("tinyint"),
        "minute_of_day": (F.hour(at) * 60 + F.minute(at)).cast("smallint"),
    }


def fahrenheit_to_celsius(c: str | Column) -> Column:
    return (col(c) - 32.0) * 5.0 / 9.0


# Conversion factors.
KM_IN_MILE, MS_IN_KNOT, MM_IN_INCH, M_IN_FOOT = 1.609344, 0.514444, 25.4, 0.3048


def filled_with_mean(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """df with the column's nulls replaced by its mean over the frame; all null stays null.

    The mean is a scalar subquery, summed within tasks first: one row reaches the others, the frame isn't gathered.
    """
    mean = df.agg(F.avg(F.col(f"`{column}`"))).scalar()
    return df.withColumn(into or column, F.coalesce(F.col(f"`{column}`"), mean))
