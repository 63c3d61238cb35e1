"""Features, reference, registry, split and the prediction file: hand-worked cases and negative controls."""

from datetime import datetime, timedelta, timezone
from math import atan2, cos, degrees, radians, sin

import pytest
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import aggregates as agg
from skyfold.functions.scalar import filled_with_mean
from skyfold.plans import evaluation, features, model, movements, reference, registry, submission
from skyfold.plans.movements import NAMES
from skyfold.sources import synthetic

T0 = datetime(2025, 1, 1, 12, tzinfo=timezone.utc)
XY = {"EDDF": (50.03, 8.56), "EGLL": (51.47, -0.46), "LTFM": (41.27, 28.73), "LTAI": (36.9, 30.8), "EHAM": (52.31, 4.76)}


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def taxi(spark, rows):
    """(airport, stand, runway, seconds)"""
    return spark.createDataFrame([("DEP", *r) for r in rows], "PHASE_mvt string, apt_mvt string, STAND_mvt string, RUNWAY_mvt string, TAXITIME_SEC_mvt double")


def test_movement_airport(spark):
    d = spark.createDataFrame([("DEP", "EDDF", "LTFM"), ("ARR", "LTFM", "EDDF"), ("DEP", "LTFM", "EGLL")], "PHASE_mvt string, ADEP_mvt string, ADES_mvt string")
    assert [r.apt_mvt for r in movements.prepare_movements(d).collect()] == ["EDDF", "EDDF", "LTFM"]


def test_percentile_and_validity(spark):
    rows = [("A", "S", "R", 100.0 + 10 * i) for i in range(100)] + [("B", "S", "R", 300.0 + 10 * i) for i in range(12)] + [("C", "S", "R", 400.0)] * 20
    got = {r.apt_mvt: r for r in reference.level_reference(taxi(spark, rows), ["apt_mvt"], "TAXITIME_SEC_mvt").collect()}
    assert got["A"].p10 == pytest.approx(199.0)
    assert not got["B"].valid and got["C"].valid


def test_clean_rows(spark):
    rows = [("A", "S", "R", 400.0)] * 20 + [("A", "S", "R", 99_999.0), ("A", "S", "R", -50.0)]
    assert reference.fit_reference(taxi(spark, rows))["apt"].first().n == 20


def test_fallback_and_specificity(spark):
    fit = reference.fit_reference(taxi(spark, [("A", "A1", "R", 400.0)] * 30 + [("A", "B2", "R", 900.0)] * 30))
    probe = taxi(spark, [("A", "A1", "R", 1.0), ("A", "Z9", "R", 1.0), ("Q", "A1", "R", 1.0), ("A", None, None, 1.0)])
    got = [(r.reference_level, r.reference_sec, r.reference_sample) for r in reference.apply_reference(probe, fit).collect()]
    assert ("apt_stand_rwy", 400.0, 30) in got and ("apt_rwy", 400.0, 0) in got and ("none", None, 0) in got and ("apt", 400.0, 0) in got


@pytest.mark.parametrize("a,b", [("EDDF", "EGLL"), ("LTFM", "LTAI"), ("EHAM", "LTFM"), ("LTAI", "EDDF")])
def test_bearing(spark, a, b):
    (p, x), (q, y) = XY[a], XY[b]
    d = radians(y - x)
    want = degrees(atan2(sin(d) * cos(radians(q)), cos(radians(p)) * sin(radians(q)) - sin(radians(p)) * cos(radians(q)) * cos(d))) % 360
    one = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), (p, x, q, y))])
    got = one.select(geo.bearing("a", "b", "c", "d"), geo.sector(geo.bearing("a", "b", "c", "d")), geo.distance_km("a", "b", "c", "d")).first()
    assert got[0] == pytest.approx(want, abs=0.01) and got[1] == int(want // 30)
    if (a, b) == ("EDDF", "EGLL"):
        assert 260 < got[0] < 310 and got[2] == pytest.approx(655, rel=0.02)


def test_unknown_destination_and_sector(spark):
    coords = spark.createDataFrame([(k, *v) for k, v in XY.items()], "icao string, latitude double, longitude double")
    d = spark.createDataFrame([(0, "EDDF", "EGLL", at(0)), (1, "EDDF", "LTAI", at(2)), (2, "EDDF", "EGLL", at(4)), (3, "EDDF", "ZZZZ", at(5)), (4, "EDDF", "ZZZZ", at(6))], "MVT_ID_mvt long, apt_mvt string, ADES_mvt string, MVT_TIME_UTC_mvt timestamp")
    got = {r.MVT_ID_mvt: r for r in features.sector_congestion(features.attach_bearing(d, coords), NAMES.moved).collect()}
    assert got[2].sector_dep_prev_15m == 2 and got[1].sector_dep_prev_15m == 1
    assert got[3].departure_bearing is None and got[4].sector_dep_prev_15m == 0 and len(got) == 5


def test_turnaround_and_drift(spark):
    schema = "MVT_ID_mvt long, PHASE_mvt string, apt_mvt string, STAND_mvt string, MVT_TIME_UTC_mvt timestamp, BLOCK_TIME_UTC_mvt timestamp, LOBT_flt timestamp, IOBT_flt timestamp"
    d = spark.createDataFrame([(0, "ARR", "A", "S", at(-5), at(0), None, None), (1, "ARR", "A", "S", at(35), at(40), None, None), (2, "DEP", "A", "S", at(50), at(45), at(42), at(30))], schema)
    dep = d.where("PHASE_mvt = 'DEP'")
    assert features.stand_turnaround(d, dep, NAMES.moved).first().stand_turnaround_sec == 600.0
    got = features.atfm_pressure(dep, NAMES.moved).first()
    assert got.atfm_drift_sec == 720.0 and got.lobt_anchor_gap_sec == 480.0


def test_families(spark):
    names = "apt_mvt rwy_dep_prev_5m apt_arr_next_60m arr_taxi_count dep_runways_in_use sector_dep_prev_15m atfm_drift_sec atfm_slot_late_share stand_turnaround_sec snow hour AIRCRAFT_TYPE_mvt nm_matched".split()
    d = spark.createDataFrame([(c,) for c in [*names, "other", "rwy_dep_prev_m"]], "column string")
    got = {r.column: r.family for r in registry.with_family(d).collect()}
    assert {got[c] for c in names} == set(registry.families()) and len(registry.families()) == 13
    assert got["other"] is None and got["rwy_dep_prev_m"] is None
    assert registry.leaving_out(["hour", "snow", "other"], "weather") == ["hour", "other"]
    with pytest.raises(KeyError):
        registry.leaving_out(["hour"], "nothing")
    with pytest.raises(ValueError):
        registry.declare("calendar", ["snow"])


def test_model_columns(spark):
    d = spark.range(1).selectExpr("id AS MVT_ID_mvt", "'x' AS FLIGHT_mvt", "1 AS TAXITIME_SEC_mvt", "current_timestamp() AS seen", "'y' AS ADEP_flt", "1.0 AS snow", "'S' AS STAND_mvt", "'RA' AS wxcodes")
    assert movements.model_columns(d) == ["snow", "STAND_mvt"]


def test_level_codes(spark):
    """Every level has its code, however many there are."""
    d = spark.range(12_000).selectExpr("concat('v', lpad(id, 6, '0')) AS v").union(spark.createDataFrame([(None,), ("v000001",)], "v string"))
    got = {r.level: r.code for r in model.level_codes(d, "v").collect()}
    assert len(got) == 12_000 and all(code == int(level[1:]) for level, code in got.items())


def test_unknown_numbers(spark):
    d = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, 4.0)], "a double, b double")
    e = model.Encoder(["a", "b"]).fit(d)
    got = [tuple(r.features) for r in e.transform(d).select("features").collect()]
    assert e.gaps == ["a", "b"] and got == [(1.0, model.UNKNOWN, 0.0, 1.0), (model.UNKNOWN, 2.0, 1.0, 0.0), (3.0, 4.0, 0.0, 0.0)]


def test_nearest_percentiles(spark):
    rows = [("A", float(v)) for v in (5, 1, 1, 9, 7)] + [(None, 2.0), (None, 4.0), ("B", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.lo, r.mid) for r in agg.nearest_percentiles(d, ["g"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    assert got == {"A": (1.0, 5.0), None: (2.0, 4.0)}
    assert [tuple(r) for r in agg.nearest_percentiles(d, [], "v", {"mid": 0.5}).collect()] == [(4.0,)]
    assert [tuple(r) for r in agg.nearest_percentiles(d.where("false"), [], "v", {"mid": 0.5}).collect()] == [(None,)]


def test_filled_with_mean(spark):
    d = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in filled_with_mean(d, "x").collect()) == [1.0, 2.0, 3.0]
    assert filled_with_mean(d.where("x IS NULL"), "x").first().x is None


@pytest.fixture(scope="module")
def year(spark):
    return movements.prepare_movements(synthetic.movements(spark, 2000, days=365, seed=3)).cache()


def test_feature_table(spark, year):
    coords, metar = synthetic.coordinates(spark), synthetic.metar(spark, days=30)
    full = features.build_features(year, coords=coords, metar=metar)
    assert full.count() == year.where("PHASE_mvt = 'DEP'").count()
    inputs = movements.model_columns(full)
    assert all(registry.is_declared(c) for c in inputs), [c for c in inputs if not registry.is_declared(c)]
    causal = features.build_features(year, coords=coords, metar=metar, causal=True, strict=True)
    assert not [c for c in causal.columns if "_next_" in c or c.startswith("nm_")]
    assert [c for c in full.columns if "_next_" in c]


def test_causal_values_do_not_leak(spark, year):
    """What happens after a departure's off-block time doesn't change its strict causal features."""
    some = year.where("apt_mvt = 'EDDF'").cache()
    mid = datetime(2025, 7, 1, tzinfo=timezone.utc)
    late = F.col("MVT_TIME_UTC_mvt") > F.lit(mid)
    changed = some.withColumn("RUNWAY_mvt", F.when(late, "99X").otherwise(F.col("RUNWAY_mvt"))).withColumn("TAXITIME_SEC_mvt", F.when(late, F.lit(1)).otherwise(F.col("TAXITIME_SEC_mvt")))
    keep = lambda d: {r.MVT_ID_mvt: tuple(r) for r in features.congestion(d, causal=True, strict=True).drop("TAXITIME_SEC_mvt").where(F.col("MVT_TIME_UTC_mvt") <= F.lit(mid)).collect()}
    assert keep(some) == keep(changed)


def test_split(spark, year):
    f = features.offsets(features.departures(year, NAMES.moved), NAMES.moved)
    split = evaluation.seasonal_split(f, year)
    months = {(r[0], r[1]) for r in split.held.select(F.month("MVT_TIME_UTC_mvt"), "apt_mvt").distinct().collect()}
    assert {m for m, _ in months} == {1, 7} and {a for m, a in months if m == 7} <= set(movements.HOLDOUT_AIRPORTS)
    assert split.fit.count() + split.held.count() == f.count()
    assert "TAXITIME_SEC_mvt" not in split.columns and "reference_sec" in split.columns


def test_zero_variance_correlation(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert d.agg(agg.pearson("a", "b")).first()[0] is None


def test_prediction_file(spark, tmp_path):
    template = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "MVT_ID_mvt long").coalesce(1)
    ok = [(1, 500.0), (3, 700.0), (5, 600.0), (9, 800.0)]
    schema = "MVT_ID_mvt long, TAXITIME_SEC_mvt double"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert submission.validate(make(ok), template) == []
    for bad in (ok[:3], ok[:3] + [(7, 1.0)], ok[:3] + [(5, 1.0)], ok[:3] + [(9, None)], ok[:3] + [(9, -1.0)], ok[:3] + [(9, float("nan"))], ok[:3] + [(9, float("inf"))]):
        with pytest.raises(submission.InvalidPrediction):
            submission.validate(make(bad), template)
    with pytest.raises(submission.InvalidPrediction):
        submission.validate(make(ok).drop("TAXITIME_SEC_mvt"), template)
    assert len(submission.validate(make([(1, 10.0), (3, 7300.0), (5, 20.0), (9, 30.0)]), template)) == 3
    submission.write(make(ok), template, str(tmp_path), "team_v7.parquet")
    import pyarrow.parquet as pq

    assert pq.read_table(tmp_path / "team_v7.parquet")["MVT_ID_mvt"].to_pylist() == [5, 3, 9, 1]
    (tmp_path / "other_v20.parquet").touch()
    assert submission.next_version(str(tmp_path), "team") == 8 and submission.next_version(str(tmp_path / "none"), "team") == 1
    with pytest.raises(submission.InvalidPrediction):
        submission.write(make(ok), template, str(tmp_path), "team.parquet")
    assert submission.fill_missing(make(ok[:3]), template).where("MVT_ID_mvt = 9").first().TAXITIME_SEC_mvt == 600.0


def test_streaming_bins(spark, tmp_path):
    from skyfold.streaming.causal import taxi_in_stream

    spark.createDataFrame([("A", at(i), float(i)) for i in range(0, 300, 10)], "apt string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("apt string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = taxi_in_stream(stream, "apt", "ts", "v").writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bins").collect()
    assert got and all(r.n == 3 for r in got if r.bin_start.replace(tzinfo=timezone.utc) >= T0)


def test_training_side_is_made_once(spark):
    """Levels, gaps, the mean and the trees read it; what it is made of (windows, say) ran for each of them."""
    from skyfold.plans.evaluation import Split
    from skyfold.plans.model import train_predict

    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    d = spark.range(60).select((F.col("id") * 7 % 13).cast("double").alias("x"), F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("level"), (F.col("id") % 5 + 10).cast("double").alias("taxi"), F.lit(9.0).alias("reference_sec"))
    fit = d.withColumn("x", F.udf(count, "double")("x"))
    out = train_predict(Split(fit, d, ["x", "level"]), ["x", "level"], rounds=1, depth=2, n=movements.Names(taxi="taxi"))
    assert out.count() == 60
    assert made.value == 60
