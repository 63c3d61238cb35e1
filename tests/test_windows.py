"""Window operators against brute force, with ties, nulls and any bucket size."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from skyfold.operators.asof import asof_backward
from skyfold.operators.windows import DAY, MINUTE, gaps, horizons, range_counts, range_counts_of, running_count

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
BUCKETS = [None, DAY, 90 * MINUTE]


def rows(n, seed, minutes=False, nulls=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = T0 + timedelta(seconds=rnd.randrange(0, 2 * 86400, 60 if minutes else 7))
        out.append((i, rnd.choice(["A", "B"] + [None] * nulls), rnd.choice("12"), None if nulls and rnd.random() < 0.05 else t))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, apt string, rwy string, ts timestamp")


@pytest.mark.parametrize("bucket", BUCKETS)
@pytest.mark.parametrize("minutes", [False, True])
def test_range_counts(spark, bucket, minutes):
    data, events = rows(250, 1, minutes), rows(250, 2, minutes)
    spans = horizons("n", (5, 15, 60))
    got = range_counts(frame(spark, data), frame(spark, events), ["apt", "rwy"], "ts", "ts", spans, bucket).collect()
    assert len(got) == len(data)
    for r in got:
        _, apt, rwy, t = data[r.id]
        for m in (5, 15, 60):
            w = timedelta(minutes=m)
            own = [e for _, a, b, e in events if t and e and apt and (a, b) == (apt, rwy)]
            assert r[f"n_prev_{m}m"] == sum(t - w < e <= t for e in own)
            assert r[f"n_next_{m}m"] == sum(t < e <= t + w for e in own)


@pytest.mark.parametrize("bucket", BUCKETS)
def test_gaps(spark, bucket):
    data = rows(150, 3, True)
    got = {r.id: r for r in gaps(frame(spark, data), ["apt", "rwy"], "ts", ["id"], bucket=bucket).collect()}
    assert set(got) == {i for i, *_, t in data if t}
    groups = {}
    for i, a, b, t in sorted((x for x in data if x[3]), key=lambda x: (x[3], x[0])):
        groups.setdefault((a, b), []).append((i, t))
    for g in groups.values():
        known = []
        for k, (i, t) in enumerate(g):
            prev = (t - g[k - 1][1]).total_seconds() if k else None
            known.append(prev)
            last = [x for x in known[-5:] if x is not None]
            assert got[i].prev_gap_sec == prev
            assert got[i].next_gap_sec == ((g[k + 1][1] - t).total_seconds() if k + 1 < len(g) else None)
            assert got[i].mean_gap_sec == (pytest.approx(sum(last) / len(last)) if len(last) > 1 else None)


@pytest.mark.parametrize("bucket", BUCKETS)
def test_asof(spark, bucket):
    left, right = rows(150, 4, True), rows(60, 5, True)
    r = spark.createDataFrame([(a, t, i, None if i % 4 == 0 else i * 2) for i, a, _, t in right], "station string, seen timestamp, k long, v long")
    got = asof_backward(frame(spark, left), r, "ts", "seen", ["apt"], ["station"], {"k": "k", "v": "v"}, ["k"], bucket).collect()
    assert len(got) == len(left)
    for x in got:
        _, apt, _, t = left[x.id]
        fit = [(s, k) for k, a, _, s in right if t and s and apt and a == apt and s <= t]
        k = max(fit)[1] if fit else None
        assert x.k == k
        assert x.v == (None if k is None or k % 4 == 0 else k * 2)  # the matched row's null, not an older value


def test_asof_empty(spark):
    empty = spark.createDataFrame([], "station string, seen timestamp, v long")
    got = asof_backward(frame(spark, rows(10, 6)), empty, "ts", "seen", ["apt"], ["station"], {"v": "v"}).collect()
    assert len(got) == 10 and all(x.v is None for x in got)


@pytest.mark.parametrize("bucket", BUCKETS)
def test_running_count(spark, bucket):
    data = rows(120, 7, True, nulls=False)
    for r in running_count(frame(spark, data), ["apt"], "ts", bucket).collect():
        t = r.ts.astimezone(timezone.utc) if r.ts.tzinfo else r.ts.replace(tzinfo=timezone.utc)
        assert r.running == sum(a == r.apt and e <= t for _, a, _, e in data)


def test_causal_case(spark):
    """Take-offs at 12:00, 12:10, 12:40; the third went off block at 12:20."""
    at = lambda m: datetime(2025, 1, 1, 12, tzinfo=timezone.utc) + timedelta(minutes=m)
    d = spark.createDataFrame([(0, "A", at(0), at(-20)), (1, "A", at(10), at(-10)), (2, "A", at(40), at(20))], "id long, apt string, ts timestamp, block timestamp")
    got = {r.id: r.n_prev_30m for r in range_counts(d, d, ["apt"], "block", "ts", horizons("n", (30,), True, False)).collect()}
    assert got[2] == 2


def windows(df):
    """The frames of df's windows, from its analyzed plan, each as (lower, upper)."""
    import re

    return re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*), ([^)]*\)?)\)", df._jdf.queryExecution().analyzed().toString())


def test_range_counts_take_one_pass(spark):
    """Frames that slide are added up anew for each row, in a time that grows with the square of the rows."""
    dep = frame(spark, rows(50, 1, nulls=False))
    got = range_counts(dep, dep, ["apt"], "ts", "ts", horizons("n", (60, 600)))
    assert {lower for lower, _ in windows(got)} == {"unboundedpreceding$()"}


def test_streams_of_one_frame_share_its_rows(spark):
    dep, arr = frame(spark, rows(60, 1)), frame(spark, rows(60, 2))
    streams = [(dep, "ts", horizons("rwy", (15,)), ["rwy"]), (arr, "ts", horizons("arr", (15,))), (dep, "ts", horizons("apt", (15,)))]
    got = range_counts_of(dep, streams, ["apt"], "ts")
    assert got._jdf.queryExecution().analyzed().toString().count("Generate explode") == 2
    want = {}
    for name, events, by in (("rwy", dep, ["apt", "rwy"]), ("arr", arr, ["apt"]), ("apt", dep, ["apt"])):
        for r in range_counts(dep, events, by, "ts", "ts", horizons(name, (15,))).collect():
            want.setdefault(r.id, {}).update({c: r[c] for c in (f"{name}_prev_15m", f"{name}_next_15m")})
    for r in got.collect():
        assert want[r.id] == {c: r[c] for c in want[r.id]}
