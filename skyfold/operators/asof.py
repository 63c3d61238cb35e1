"""Grouped as-of join: for each left row the last right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros
from .windows import DAY


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    left_by: Sequence[str],
    right_by: Sequence[str],
    payload: dict[str, str],
    tie: Sequence[str] = (),
    bucket: int | None = DAY,
) -> DataFrame:
    """left with payload (new name: right column), all null where no right row of the group is early enough.

    Equal times match.  Of right rows at one time the last by tie (nulls first) counts.  Null groups match nothing.
    The matched row is taken whole: null fields of it stay null.  Within a bucket a window finds the match; the last
    row of the buckets before is carried over, one row for each bucket and group.
    """
    keys = [f"_k{i}" for i in range(len(left_by))]
    l = left.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(left_by, keys, strict=True)], micros(left_time).alias("_us"))
    r = right.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(right_by, keys, strict=True)],
        micros(right_time).alias("_us"),
        F.struct(*[F.col(f"`{old}`").alias(new) for new, old in payload.items()], F.lit(True).alias("_hit")).alias("_row"),
        F.struct(F.lit(0).alias("_z"), *[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(tie)]).alias("_tie"),
    )
    r = r.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_us"]))
    cut = (F.floor(F.col("_us") / F.lit(bucket)) if bucket else F.when(F.col("_us").isNotNull(), 0)).cast("long")
    l, r = l.withColumn("_bucket", cut), r.withColumn("_bucket", cut)
    both = r.withColumn("_side", F.lit(0)).unionByName(l.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last("_row", ignorenulls=True).over(w)).where("_side = 1").drop("_row", "_tie", "_side")
    if bucket:
        ends = r.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.struct("_us", "_tie")).alias("_last"))
        # buckets with left rows need the last bucket before them that has right rows
        need = l.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_us"])).select(*keys, "_bucket").distinct()
        carry = ends.unionByName(need, allowMissingColumns=True)
        carry = carry.groupBy(*keys, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
        both = both.join(carry, [*keys, "_bucket"], "left").withColumn("_own", F.coalesce("_own", "_carry")).drop("_carry")
    known = F.lit(True)
    for k in [*keys, "_us"]:
        known = known & F.col(k).isNotNull()
    fields = [F.when(known, F.col(f"_own.`{new}`")).alias(new) for new in payload]
    return both.select(*[F.col(f"`{c}`") for c in left.columns], *fields)
