"""Window operators over ordered groups of any size.

A group (an airport, say) may hold a large share of all rows, so no operator here sorts a group in one task.  Time is cut
into buckets; a window partition is a group's bucket, and the rows that windows need from beyond its edges are added to
it as context: rows within a span of time, or a number of rows before or after.  Context rows take part in windows and
are dropped afterwards.  With bucket None a group is one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros

MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE


def _named(cols: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in cols]


def spread(df: DataFrame, back: int, ahead: int, bucket: int | None) -> DataFrame:
    """df, which has _us, with _bucket and _own: each row also in the buckets whose rows reach it within back and ahead."""
    if bucket is None:
        return df.withColumn("_bucket", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    own = F.floor(F.col("_us") / F.lit(bucket))
    first, last = F.floor((F.col("_us") - ahead) / F.lit(bucket)), F.floor((F.col("_us") + back) / F.lit(bucket))
    return df.withColumn("_bucket", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_bucket") == own)


def range_counts(
    keys: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    key_time: str,
    event_time: str,
    spans: dict[str, tuple[int, int]],
    bucket: int | None = DAY,
) -> DataFrame:
    """keys with a count of events for each span name: (back, ahead) in microseconds.

    (back, 0) counts events in (t - back, t], (0, ahead) those in (t, t + ahead].  Keys without a time, or with a null
    group, count 0; events without a time or group are in no window.
    """
    return range_counts_of(keys, [(events, event_time, spans)], by, key_time, bucket)


def range_counts_of(keys: DataFrame, streams: Sequence[tuple], by: Sequence[str], key_time: str, bucket: int | None = DAY) -> DataFrame:
    """range_counts of several streams: (events, their time, spans) or (events, their time, spans, more groups).

    One shuffle serves all of them, by group and bucket; the windows of a stream with more groups are within its partitions.
    Streams of one frame and time share its rows.  A count is the difference of two running counts: their frames begin with
    the partition and only grow, so that each takes one pass, where a sliding frame is added up anew for each row.
    """
    reach = [span for stream in streams for span in stream[2].values()]
    back, ahead = max([0, *(b for b, _ in reach)]), max([0, *(a for _, a in reach)])
    size = None if bucket is None else max(bucket, back, ahead)
    own = F.floor(F.col("_us") / F.lit(size)) if size else F.lit(0)
    both = keys.withColumn("_us", micros(key_time)).withColumn("_bucket", own.cast("long")).withColumn("_probe", F.lit(True))

    def known(columns: Sequence[str]) -> Column:
        out = F.col("_us").isNotNull()
        for c in _named(columns):
            out = out & c.isNotNull()
        return out

    sources: list[list] = []  # frame, time, groups of all its streams
    source_of = []
    for events, event_time, _, *more in streams:
        i = next((i for i, (e, t, _) in enumerate(sources) if e is events and t == event_time), len(sources))
        if i == len(sources):
            sources.append([events, event_time, list(by)])
        sources[i][2] = list(dict.fromkeys([*sources[i][2], *(more[0] if more else ())]))
        source_of.append(i)
    for i, (events, event_time, groups) in enumerate(sources):
        e = events.select(*_named(groups), micros(event_time).alias("_us"), F.lit(1).cast("long").alias(f"_n{i}"), F.lit(False).alias("_probe"))
        e = spread(e.where(known(by)), back, ahead, size).drop("_own")
        both = both.unionByName(e, allowMissingColumns=True)
    if len(streams) > 1:
        both = both.repartition(*_named(by), "_bucket")
    upto, out = {}, {}
    for k, (i, (_, _, spans, *more)) in enumerate(zip(source_of, streams, strict=True)):
        groups = [*by, *(more[0] if more else ())]
        w = Window.partitionBy(*_named(groups), "_bucket").orderBy("_us")
        for name, (b, a) in spans.items():
            for us in (0, -b if b else a):
                upto[f"_upto{k}_{us}"] = F.count(f"_n{i}").over(w.rangeBetween(Window.unboundedPreceding, us))
            now, edge = F.col(f"`_upto{k}_0`"), F.col(f"`_upto{k}_{-b if b else a}`")
            out[name] = F.when(known(groups), now - edge if b else edge - now).otherwise(F.lit(0)).cast("long")
    both = both.withColumns(upto).where("_probe").withColumns(out)
    return both.drop("_us", "_probe", "_bucket", *upto, *[f"_n{i}" for i in range(len(sources))])


def horizons(prefix: str, minutes: Sequence[int], back: bool = True, ahead: bool = True) -> dict[str, tuple[int, int]]:
    """Span names like prefix_prev_5m and prefix_next_5m."""
    out = {f"{prefix}_prev_{m}m": (m * MINUTE, 0) for m in minutes} if back else {}
    return out | ({f"{prefix}_next_{m}m": (0, m * MINUTE) for m in minutes} if ahead else {})


def near_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, bucket: int | None) -> DataFrame:
    """df, which has _us, with _bucket and _own, and in each bucket the group's last rows before it and first after it."""
    if bucket is None:
        return df.withColumn("_bucket", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    df = df.withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket)))
    out = df.withColumn("_own", F.lit(True))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_bucket"])
    inner = [*_named(by), F.col("_bucket")]
    for n, back in ((before, True), (after, False)):
        if not n:
            continue
        turn = [F.col("_us").desc() if back else F.col("_us").asc(), *[c.desc() if back else c.asc() for c in _named(order)]]
        edge = df.withColumn("_i", F.row_number().over(Window.partitionBy(*inner).orderBy(*turn))).where(F.col("_i") <= n)
        edge = edge.groupBy(*inner).agg(F.sort_array(F.collect_list(F.struct("_i", row.alias("row")))).alias("rows"))
        # few rows: one for each bucket of a group
        w = Window.partitionBy(*_named(by)).orderBy(F.col("_bucket").desc() if back else F.col("_bucket").asc())
        near = F.slice(F.flatten(F.collect_list("rows").over(w.rowsBetween(1, n))), 1, n)
        edge = edge.withColumn("near", near).select(*inner, F.explode("near").alias("r"))
        # the rows of the group's other buckets, in this bucket
        edge = edge.select("_bucket", "r.row.*").withColumn("_own", F.lit(False))
        out = out.unionByName(edge)
    return out


def gaps(df: DataFrame, by: Sequence[str], time: str, order: Sequence[str], ahead: bool = True, rows: int = 5, least: int = 2, names: Sequence[str] = ("prev_gap_sec", "next_gap_sec", "mean_gap_sec"), bucket: int | None = DAY) -> DataFrame:
    """Seconds since the row before and to the row after, and the mean of the last `rows` gaps if `least` are known.

    Rows of a group are ordered by time, then by order.  Rows without a time are left out.
    """
    d = df.withColumn("_us", micros(time)).where("_us IS NOT NULL")
    d = near_rows(d, by, order, rows, 1 if ahead else 0, bucket)
    w = Window.partitionBy(*_named(by), "_bucket").orderBy("_us", *_named(order))
    gap = lambda x: F.floor(x / 1_000_000).cast("double")  # noqa: E731  never below 0 here
    d = d.withColumn(names[0], gap(F.col("_us") - F.lag("_us").over(w)))
    if ahead:
        d = d.withColumn(names[1], gap(F.lead("_us").over(w) - F.col("_us")))
    run = w.rowsBetween(-(rows - 1), 0)
    d = d.withColumn(names[2], F.when(F.count(names[0]).over(run) >= least, F.avg(names[0]).over(run)))
    return d.where("_own").drop("_us", "_bucket", "_own")


def running_count(df: DataFrame, by: Sequence[str], time: str, bucket: int | None = DAY) -> DataFrame:
    """by, time, n and running: rows at each instant, and up to it.  Buckets' sums are carried over."""
    d = df.where(F.col(f"`{time}`").isNotNull()).groupBy(*_named(by), F.col(f"`{time}`")).agg(F.count("*").alias("n"))
    d = d.withColumn("_us", micros(time)).withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket)) if bucket else F.lit(0))
    sums = d.groupBy(*_named(by), "_bucket").agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy(*_named(by)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    keys = [*by, "_bucket"]
    right = sums.select(*[F.col(f"`{k}`").alias(f"_r{i}") for i, k in enumerate(keys)], "_before")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}"))
    d = d.join(right, on)
    w = Window.partitionBy(*_named(by), "_bucket").orderBy("_us")
    return d.withColumn("running", (F.sum("n").over(w) + F.col("_before")).cast("long")).select(*_named(by), F.col(f"`{time}`"), "n", "running")
