import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rainrisk.operators import forecast, gauges, rain

T0 = datetime(2026, 1, 10, 12)
TARGET = F.lit(str(T0)).cast("timestamp")
HOURS = [T0 - timedelta(hours=h) for h in range(96)]


def units(spark, *at):
    return spark.createDataFrame([(f"u{i}", la, lo) for i, (la, lo) in enumerate(at)], "ua_id string, lat double, lon double")


def stations(spark, *at):
    return spark.createDataFrame([(f"s{i}", la, lo) for i, (la, lo) in enumerate(at)], "station_id string, lat double, lon double")


def test_windows_of_constant_rain(spark):
    st = stations(spark, (-23.5, -45.5))
    hourly = spark.createDataFrame([("s0", h, 5.0 if h == T0 else 1.0) for h in HOURS], "station_id string, hr timestamp, mm double")
    u = units(spark, (-23.51, -45.5), (-25.0, -45.5))
    cover = gauges.point_coverage(gauges.point_series(u, st, hourly, TARGET), TARGET).collect()
    assert len(cover) == 1
    c = cover[0]
    assert (c.intensity_mmh, c.ac18h_mm, c.ac24h_mm, c.ac72h_mm, c.ac96h_mm) == (5, 22, 28, 76, 100)
    assert (c.covered_24, c.covered_96, c.covered_target) == (24, 96, True)


def test_absent_hour_is_not_zero(spark):
    st = stations(spark, (-23.5, -45.5), (-23.52, -45.5))
    hourly = spark.createDataFrame([("s0", T0, 4.0), ("s0", HOURS[1], 2.0), ("s1", HOURS[1], 2.0)], "station_id string, hr timestamp, mm double")
    s = {r.hr: r.mm for r in gauges.point_series(units(spark, (-23.51, -45.5)), st, hourly, TARGET).collect()}
    assert s == {T0: 4.0, HOURS[1]: 2.0}


def test_coverage_rule(spark):
    rows = [(True, 22, 87), (True, 21, 87), (True, 22, 86), (False, 24, 96)]
    df = spark.createDataFrame(rows, "covered_target boolean, covered_24 int, covered_96 int").coalesce(1)
    assert [r.q for r in df.select(gauges.qualifies().alias("q")).collect()] == [True, False, False, False]


def day_table(spark, rows):
    return spark.createDataFrame(rows, "station_id string, lat double, lon double, total_mm double, hours bigint")


def test_suspect_station(spark):
    rows = [("dry", -23.50, -45.50, 0.0, 24), ("a", -23.51, -45.50, 20.0, 24), ("b", -23.50, -45.51, 30.0, 24), ("c", -23.49, -45.50, 25.0, 24)]
    assert [r.station_id for r in gauges.suspect_stations(day_table(spark, rows)).collect()] == ["dry"]
    # two neighbours are too few; neighbours with few hours do not count; a silent station is no suspect
    assert gauges.suspect_stations(day_table(spark, rows[:3])).count() == 0
    assert gauges.suspect_stations(day_table(spark, rows[:3] + [("c", -23.49, -45.50, 25.0, 10)])).count() == 0
    assert gauges.suspect_stations(day_table(spark, [("dry", -23.5, -45.5, 0.0, 0)] + rows[1:])).count() == 0


def test_suspects_match_brute_force_with_crowded_positions(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", -23.5 + rng.randrange(4) * 0.03, -45.5 + rng.randrange(4) * 0.03, rng.choice([0.0, 0.2, 0.4, 4.0, 6.0, 9.0]), rng.choice([0, 5, 18, 24]))
            for i in range(60)]
    want = set()
    for sid, la, lo, tot, hrs in rows:
        near = sorted(t for o, la2, lo2, t, h2 in rows if o != sid and h2 >= 18 and _km(la, lo, la2, lo2) <= 10)
        if hrs > 0 and tot <= 0.5 and len(near) >= 3:
            mid = len(near) // 2
            median = near[mid] if len(near) % 2 else (near[mid - 1] + near[mid]) / 2
            if median >= 5:
                want.add(sid)
    got = {r.station_id for r in gauges.suspect_stations(day_table(spark, rows)).collect()}
    assert got == want


def _km(la1, lo1, la2, lo2):
    p1, p2 = math.radians(la1), math.radians(la2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def window_row(spark, i, a18, a24, a72, a96):
    return spark.createDataFrame([("u0", -23.5, -45.5, i, a18, a24, a72, a96)],
                                 "ua_id string, lat double, lon double, intensity_mmh double, ac18h_mm double, ac24h_mm double, ac72h_mm double, ac96h_mm double")


def st24(spark, values, step=0.01, coverage=24.0):
    rows = [(f"s{i}", -23.5 + step * (i + 1), -45.5, v, coverage) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, lat double, lon double, value_mm double, coverage_hours double")


def correct(spark, windows, st):
    return gauges.correct_rain(windows, gauges.anchor_estimates(windows, st, coverage="coverage_hours")).first()


def test_dry_override_keeps_older_rain(spark):
    r = correct(spark, window_row(spark, 25.0, 280.0, 300.0, 500.0, 600.0), st24(spark, [0.0, 0.0, 0.0]))
    assert (r.correction, r.ac24h_mm, r.intensity_mmh, r.ac72h_mm, r.ac96h_mm) == ("override", 0.0, 0.0, 200.0, 300.0)


def test_dry_override_needs_redundancy(spark):
    r = correct(spark, window_row(spark, 25.0, 280.0, 300.0, 500.0, 600.0), st24(spark, [0.0, 0.0]))
    assert r.correction == "scale" and r.factor > 0.1


def test_scale_add_and_none(spark):
    r = correct(spark, window_row(spark, 10.0, 80.0, 100.0, 150.0, 180.0), st24(spark, [20.0]))
    assert r.correction == "scale" and 0.1 <= r.factor < 1 and r.ac24h_mm == round(100 * r.factor, 2)
    r = correct(spark, window_row(spark, 0.0, 0.0, 0.0, 10.0, 20.0), st24(spark, [30.0]))
    assert r.correction == "add" and r.ac18h_mm <= r.ac24h_mm <= r.ac72h_mm <= r.ac96h_mm and r.factor is None
    r = correct(spark, window_row(spark, 0.0, 0.0, 0.2, 10.0, 20.0), st24(spark, [0.1]))
    assert r.correction == "none" and r.ac24h_mm == 0.2
    r = correct(spark, window_row(spark, 5.0, 8.0, 10.0, 15.0, 18.0), st24(spark, [1.0], step=5.0))
    assert r.correction == "none"


def test_first_station_in_order_wins_when_close(spark):
    st = spark.createDataFrame([("b", -23.5, -45.5, 9.0), ("a", -23.501, -45.5, 4.0), ("c", -23.6, -45.5, 100.0)], "station_id string, lat double, lon double, value_mm double")
    r = gauges.anchor_estimates(units(spark, (-23.5, -45.5)), st).first()
    assert r.g24_mm == 4.0 and abs(r.d_min_km - 0.1112) < 1e-3


def test_trailing_windows_zero_fill_and_late_hour(spark):
    rows = [("c", T0, 1.5), ("c", HOURS[17], 2.0), ("c", HOURS[18], 3.0), ("c", HOURS[95], 4.0), ("c", T0 - timedelta(hours=96), 50.0), ("c", T0 + timedelta(hours=1), 60.0), ("c", HOURS[2], -9.0)]
    df = spark.createDataFrame(rows, "cell string, hr timestamp, mm double")
    r = rain.trailing_windows(df, ["cell"], TARGET).first()
    assert (r.intensity_mmh, r.ac18h_mm, r.ac24h_mm, r.ac72h_mm, r.ac96h_mm) == (1.5, 3.5, 6.5, 6.5, 10.5)


def test_completeness(spark):
    df = spark.createDataFrame([(h,) for h in HOURS[3:40]], "hr timestamp")
    r = rain.hour_completeness(df, TARGET).first()
    assert (r.files_ok, r.missing_24h, r.missing_96h) == (37, 3, 59)


def test_forecast_run_falls_back_until_complete(spark):
    def cells(run, leads):
        return [(run, run + timedelta(hours=k), 0, 0, float(k)) for k in leads]
    rows = cells(T0, [0, 6]) + cells(T0 - timedelta(hours=6), [6, 12, 30]) + cells(T0 - timedelta(hours=12), [12, 18, 36])
    grid = spark.createDataFrame(rows, "run timestamp, valid timestamp, lat_idx int, lon_idx int, acc_mm double")
    assert forecast.choose_run(grid, TARGET).first().run == T0 - timedelta(hours=6)
    r = forecast.accumulate(grid, TARGET, ["lat_idx", "lon_idx"]).first()
    assert (r.ac6h_prev, r.ac24h_prev) == (6.0, 24.0)
    assert forecast.accumulate(grid.where("valid < run"), TARGET, ["lat_idx", "lon_idx"]).count() == 0


def test_measured_units_keep_their_windows(spark):
    windows = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 0.0, 0.0, False), (3, 0.0, 0.0, None)], "ua_id long, lat double, lon double, from_gauges boolean")
    windows = windows.withColumns({c: F.lit(v) for c, v in (("intensity_mmh", 1.0), ("ac18h_mm", 8.0), ("ac24h_mm", 10.0), ("ac72h_mm", 20.0), ("ac96h_mm", 30.0))})
    estimates = spark.createDataFrame([(0.0, 0.0, 20.0, 0.0, 0, 0, None)], "lat double, lon double, g24_mm double, d_min_km double, n_covered long, n_dry long, d_covered double")
    got = {r["ua_id"]: (r["correction"], r["ac24h_mm"], r["ac96h_mm"]) for r in gauges.correct_rain(windows, estimates, skip=F.col("from_gauges")).collect()}
    assert got == {1: ("none", 10.0, 30.0), 2: ("scale", 18.5, 55.5), 3: ("scale", 18.5, 55.5)}


def test_gauge_blocks_of_an_empty_cycle(spark):
    from rainrisk.operators import risk

    points = spark.createDataFrame([], "ua_id long, hazard string, from_gauges boolean, correction string, factor double")
    none = spark.createDataFrame([], "station_id long")
    row = risk.gauge_blocks(points, none, none, "no stations").first().asDict(True)
    assert row == {"gauge": {"applied": False, "mean_factor": None, "stations_recent": 0, "points_corrected": 0},
                   "gauge_primary": {"applied": False, "points_gauge": 0, "stations_near": 0, "error": "no stations"}}
