"""Files, ingest, and aggregates with nulls, ties and empty inputs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyfold.functions.scalar import has_code, ratio, seconds_between
from skyfold.operators import aggregates as agg
from skyfold.operators.bins import fixed_bin, month_edges, sliding_summary
from skyfold.plans.model import Encoder, ablation, leaderboard
from skyfold.sources import files, ingest, synthetic


def test_files(spark, tmp_path):
    a, b = str(tmp_path / "training_1.parquet"), str(tmp_path / "training_2.parquet")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(a)
    spark.createDataFrame([(2**40, "y")], "a long, b string").write.parquet(b)
    got = files.read_many(spark, a, b)
    assert dict(got.dtypes)["a"] == "bigint" and got.count() == 2
    assert files.read_optional(spark, str(tmp_path / "none.parquet")) is None
    with pytest.raises(FileNotFoundError):
        files.read_many(spark, str(tmp_path / "no*.parquet"))
    (tmp_path / "m.csv").write_text("#note\nstation,valid\nA,2025-01-01 00:20\n# more\nB,M\n")
    rows = files.read_csv(spark, str(tmp_path / "m.csv"), comment="#")
    assert [r.valid is None for r in files.times_parsed(rows, ["valid", "absent"]).orderBy("station").collect()] == [False, True]
    (tmp_path / "page.json").write_text('{"items": [{"team": "a", "score": 2.5}, {"team": "b", "score": 1.5}], "nextCursor": null}')
    items = files.read_pages(spark, str(tmp_path / "page.json"), "team: string, score: double")
    assert {(r.team, r.score) for r in items.collect()} == {("a", 2.5), ("b", 1.5)}
    files.write_parquet(items, str(tmp_path / "out"), ["team"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert files.markdown(items.orderBy("team"), 1).splitlines()[2] == "| a | 2.5 |"


def test_sheets_and_inference(spark, tmp_path):
    (tmp_path / "s.csv").write_text("APT,YEAR,DAY\nA,2025,2025-01-02\nB,n/a,no day\n")
    got = {r.APT: (r.YEAR, r.DAY) for r in files.read_sheet(spark, str(tmp_path / "s.csv"), ["YEAR"], ["DAY"]).collect()}
    assert got["A"] == (2025.0, date(2025, 1, 2)) and got["B"] == (None, None)
    (tmp_path / "n.csv").write_text("a,b\n1,x\n2.5,y\n")
    assert dict(files.read_csv(spark, str(tmp_path / "n.csv"), infer=True).dtypes) == {"a": "double", "b": "string"}


def test_fetches(tmp_path):
    asked, waits = [], []

    def fetch(month):
        asked.append(month)
        if asked.count(month) < 3 and month == "m2":
            raise OSError("busy")
        return month.encode()

    get = lambda: files.fetch_chunks(["m1", "m2"], fetch, str(tmp_path), lambda m: f"{m}.csv", wait=1.0, pause=0.5, sleep=waits.append)
    assert [p.read_text() for p in get()] == ["m1", "m2"] and waits == [0.5, 1.0, 2.0, 0.5]
    assert [p.name for p in get()] == ["m1.csv", "m2.csv"] and asked == ["m1", "m2", "m2", "m2"]  # nothing is fetched again

    def never(month):
        raise OSError("down")

    with pytest.raises(OSError):
        files.fetch_chunks(["m3"], never, str(tmp_path), lambda m: f"{m}.csv", sleep=waits.append)
    assert not (tmp_path / "m3.csv").exists()


def test_cursor_pages():
    pages = {None: {"items": [1, 2], "nextCursor": "b"}, "b": {"items": [], "nextCursor": "c"}, "c": {"items": [3]}}
    assert list(files.fetch_pages(pages.__getitem__)) == [1, 2, 3]
    with pytest.raises(ValueError):
        list(files.fetch_pages({None: {"items": [1], "nextCursor": "b"}, "b": {"items": [], "nextCursor": "b"}}.__getitem__))


def test_observation_flags(spark):
    schema = "station string, valid string, tmpf string, dwpf string, vsby string, sknt string, drct string, p01i string, wxcodes string, skyc1 string, skyl1 string"
    rows = [("A", "2025-01-01 00:20", "32.0", "M", "0.5", "10", "90", "0.1", "FZFG", "OVC", "300"), ("A", "bad", "M", "30", None, None, None, "0.1", None, None, None), ("A", "2025-01-01 01:20", "33", "30", "9", "1", "2", None, "-SHSN", None, None)]
    a, b, c = ingest.observations(spark.createDataFrame(rows, schema)).collect()
    assert a.freezing_precip and a.fog and a.deicing_proxy and a.low_visibility and a.temperature_c == 0 and a.dewpoint_c is None
    assert b.valid is None and b.deicing_proxy is None and b.low_visibility is None and b.snow is False  # unknown or false is unknown
    assert c.snow and c.deicing_proxy and not c.low_visibility


def test_scalars(spark):
    one = spark.createDataFrame([(datetime(2025, 1, 1, 0, 0, 0, 900000), datetime(2025, 1, 1, 0, 0, 2, 100000))], "a timestamp, b timestamp")
    assert one.select(seconds_between("b", "a"), seconds_between("a", "b")).first() == (1, -1)
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)), has_code(F.lit(None).cast("string"), ("TS",))).first() == (None, False)


def test_bins(spark):
    d = spark.createDataFrame([("A", datetime(2025, 1, 1, 0, 30)), ("A", None)], "k string, t timestamp")
    got = sliding_summary(d, ["k"], "t", 10, 30, n=F.count("*")).collect()
    assert len(got) == 3 and all(r.n == 1 for r in got)
    assert d.where("t is not null").select(F.unix_seconds(fixed_bin("t", 30)) % 1800).first()[0] == 0
    assert [(str(r.begin), str(r.stop)) for r in month_edges(spark, "2025-01-10", "2025-02-01").collect()] == [("2025-01-10", "2025-02-01")]


def test_aggregates(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("a", None), ("b", 5.0)], "k string, v double")
    got = {r.k: r for r in agg.nearest_percentiles(d, ["k"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    assert (got["a"].p10, got["a"].p50, got["b"].p10) == (1.0, 5.0, 5.0)  # rank floor(0.9 + 0.5) and floor(4.5 + 0.5)
    empty = d.where("false")
    assert [tuple(r) for r in agg.nearest_percentiles(empty, [], "v", {"p": 0.5}).collect()] == [(None,)]
    assert empty.agg(agg.rmse("v", "v"), agg.share(F.col("v") > 1)).first() == (None, None)
    sets = d.groupBy("k").agg(agg.joined_set("v", F.col("v") > 7).alias("s")).collect()
    assert {(r.k, r.s) for r in sets} == {("a", "8.0+9.0"), ("b", "")}
    assert {r.k: r.v for r in agg.best_of(d, ["k"], "v").collect()} == {"a": 0.0, "b": 5.0}
    counts = agg.counts_by_type(d, "k", "k", ["a", "z"], ["a", "q"]).collect()
    assert {(r["k"], r["z"]) for r in counts} == {("a", 0), ("q", 0)}


def test_leaderboard_ties(spark):
    d = spark.createDataFrame([("a", 2.0, 2), ("a", 1.0, 5), ("b", 1.0, 3), ("c", None, 1)], "team string, score double, submitted long")
    assert [(r.team, r["rank"]) for r in leaderboard(d).orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_encoder(spark):
    fit = spark.createDataFrame([("x", 1.0), ("z", None), (None, 2.0)], "c string, v double")
    held = spark.createDataFrame([("z", 1.0), ("new", float("nan")), (None, None)], "c string, v double")
    rows = [r.features.toArray().tolist() for r in Encoder(["c", "v"]).fit(fit).transform(held).collect()]
    # the last is the flag of unknown numbers
    assert rows == [[1.0, 1.0, 0.0], [-1.0, -1e9, 1.0], [-1.0, -1e9, 1.0]]


def test_ablation_names(spark):
    from skyfold.plans.evaluation import Split

    d = spark.createDataFrame([(1.0, 1.0, 2.0)], "TAXITIME_SEC_mvt double, hour double, snow double")
    seen = []

    def score(columns):
        seen.append(columns)
        return d.withColumn("prediction", F.lit(3.0))

    got = ablation(Split(d, d, ["hour", "snow"]), score)
    assert [(n, k) for n, k, _ in got] == [("all", 2), ("weather", 1), ("calendar", 1)] and all(e == 2.0 for *_, e in got)


def test_synthetic_is_seeded(spark):
    a, b = synthetic.movements(spark, 100, seed=5).collect(), synthetic.movements(spark, 100, seed=5).repartition(3).orderBy("MVT_ID_mvt").collect()
    assert a == b
    d = synthetic.movements(spark, 100, seed=5).where("PHASE_mvt = 'DEP'")
    assert d.where(F.unix_seconds("MVT_TIME_UTC_mvt") - F.unix_seconds("BLOCK_TIME_UTC_mvt") != F.col("TAXITIME_SEC_mvt")).count() == 0


def test_runways_of_a_large_airport(spark):
    raw = spark.createDataFrame([("EHAM", "0", "9000")] * 200 + [("EHAM", "1", "12000")], "airport_ident string, closed string, length_ft string")
    assert [tuple(r) for r in ingest.runway_summary(raw, ["EHAM"]).collect()] == [("EHAM", 200, 9000.0, 9000.0)]
