from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rainrisk.operators import analytics, fire, risk

T0 = datetime(2026, 1, 10, 12)


def cycles(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cycle_id bigint, started_at timestamp, outcome string, duration_s double, files_ok int, alert_count int")


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 4.9, 5.0, 30.0, 500.0, -3.0)], "v double")
    got = analytics.histogram(df, "v", (0, 5, 15, 30)).orderBy("bin").collect()
    assert [r.n for r in got] == [3, 1, 0, 2] and got[-1].upper is None


def test_percentile_interpolates(spark):
    from rainrisk.operators.scale import exact_quantiles

    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, None)], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", {"q": 0.5}).first().q == 2.5


def test_alert_deltas(spark):
    rows = [(T0 + timedelta(minutes=m), "ok", 1.0, 96, n) for m, n in ((-130, 1), (-70, 4), (0, 6))]
    r = analytics.alert_deltas(cycles(spark, rows)).first()
    assert (r.alert_count, r.alert_delta_1h, r.alert_delta_24h) == (6, 2, None)
    assert analytics.alert_deltas(cycles(spark, rows), hours=(2,)).first().alert_delta_2h == 5
    assert analytics.alert_deltas(cycles(spark, rows[:1])).first().alert_delta_1h is None


def test_operations(spark):
    rows = [(T0, "ok", 10.0, 96, 0), (T0 + timedelta(minutes=10), "error", 20.0, 48, 0)]
    r = analytics.operations(cycles(spark, rows)).first()
    assert (r.success_rate_pct, r.completeness_pct, r.interval_p50_min, r.interval_max_min, r.duration_p50_s) == (50.0, 75.0, 10.0, 10.0, 15.0)


def test_regional_position(spark):
    pts = spark.createDataFrame([("a", "geo", 2, 1, 75.0, 100.0, 3.0, 0.5), ("b", "hidro", 2, 4, 300.0, 300.0, 9.0, None), ("c", "geo", None, 0, 999.0, 1.0, 1.0, None)],
                                "ua_id string, hazard string, regiao_id int, rd int, ac24h_mm double, ac96h_mm double, intensity_mmh double, cpc double")
    got = {r.regiao_id: r for r in analytics.regional_summary(pts, risk.default_regions(spark)).collect()}
    r = got[2]
    assert (r.ac24h_max, r.hid_level, r.hid_next_break, r.hid_margin_mm, r.uas_geo, r.uas_hidro, r.hidro_rd4) == (75.0, 1, 80.0, 5.0, 1, 1, 1)
    assert (got[1].uas_geo, got[1].ac24h_max, got[1].hid_level, got[1].hid_margin_mm) == (0, None, None, None) and len(got) == 4
    assert analytics.unassigned_points(pts, risk.default_regions(spark)).first()[0] == 1


def test_fire_transitions(spark):
    rows = [("1", "observado", "baixo"), ("1", "D+1", "critico"), ("2", "observado", "alto"), ("2", "D+1", "medio"), ("3", "observado", "SEM_DADO"), ("3", "D+1", "alto")]
    r = fire.transitions(spark.createDataFrame(rows, "trecho_id string, horizonte string, rf_classe string")).first()
    assert (r.worsen, r.improve, r.same) == (1, 1, 0)


def test_fire_values_and_bounds(spark):
    rows = [("a", "h", v) for v in (0.15, 7.0, -1.0, float("nan"), None, 0.1)] + [("b", "h", 3.0), ("c", "h", -5.0)]
    got = {r.trecho_id: r for r in fire.segment_statistics(spark.createDataFrame(rows, "trecho_id string, horizonte string, rf double"), ["trecho_id", "horizonte"]).collect()}
    assert (got["a"].rf_valor, got["a"].rf_classe, got["a"].amostras, got["a"].rf_media) == (0.15, "baixo", 2, 0.125)
    assert (got["b"].rf_valor, got["b"].rf_classe) == (1.0, "critico") and "c" not in got


def test_escalation_needs_depth(spark):
    rows = [("u", "geo", T0 + timedelta(minutes=10 * i), i, rd) for i, rd in enumerate([1, 1, 2, 2, 2, 3, 3])] + [("v", "geo", T0, 0, 4)]
    hist = spark.createDataFrame(rows, "ua_id string, hazard string, ts timestamp, cycle_id bigint, rd int")
    got = {r.ua_id: r for r in analytics.escalation(hist).collect()}
    assert (got["u"].rd_1h, got["u"].rd_4h, got["u"].delta, got["u"].trail) == (1, 1, 2, [1, 1, 2, 2, 2, 3, 3])
    assert (got["v"].rd_1h, got["v"].rd_4h, got["v"].delta) == (None, None, 0)
    assert [r.ua_id for r in analytics.rising(analytics.escalation(hist)).collect()] == ["u"]
    assert [r.ua_id for r in analytics.steady(analytics.escalation(hist).withColumn("ac24h_mm", F.lit(None).cast("double"))).collect()] == ["v"]


def test_steady_by_rain_and_headline(spark):
    """Units in alert stand by level, then by 24 h rain; unknown units and rain count as none. The headline shows the last cycle."""
    rows = [(u, "geo", T0, 0, rd) for u, rd in (("a", 3), ("b", 3), ("c", 4), ("d", 3))]
    esc = analytics.escalation(spark.createDataFrame(rows, "ua_id string, hazard string, ts timestamp, cycle_id bigint, rd int"))
    points = spark.createDataFrame([("a", "geo", 3, "R1", 5.0), ("b", "geo", 3, "R2", 9.0), ("c", "geo", 4, "R3", None)], "ua_id string, hazard string, rd int, sigla_rodovia string, ac24h_mm double")
    got = analytics.steady(analytics.described(esc, points)).collect()
    assert [(r.ua_id, r.sigla_rodovia) for r in got] == [("c", "R3"), ("b", "R2"), ("a", "R1"), ("d", None)]
    kind = ("cycle_id int, started_at timestamp, alert_count int, duration_s double, files_ok int, missing_24h int, data_status string, ac24h_max double, ac96h_max double, "
            "intensity_max double, gauge struct<mean_factor:double,stations_recent:int>")
    cycles = spark.createDataFrame([(1, T0, 5, 1.0, 96, 0, "ok", 1.0, 2.0, 3.0, (0.5, 4)), (2, T0 + timedelta(hours=1), 7, 2.0, 90, 6, "degraded", 4.0, 5.0, 6.0, None)], kind)
    h = analytics.headline(points, cycles).first()
    assert (h.alerts_now, h.max_rd, h.max_rd_name, h.alert_delta_1h, h.missing_24h, h.data_status) == (3, 4, "Alerta Máximo", 2, 6, "degraded")
    assert (h.ac24h_max, h.ac96h_max, h.intensity_max, h.gauge_factor, h.gauge_stations) == (4.0, 5.0, 6.0, None, None)
    assert analytics.headline(points.where("false"), cycles).first().max_rd_name == "Monitoramento"


def test_payload_blocks_run(spark):
    from rainrisk import fixtures as fx
    from rainrisk.plans import products

    sf = "/root/testdata/sf0.001"
    blocks = products.analytics_payload(fx.points(spark, sf), fx.cycles(spark, sf), fx.history(spark, sf), risk.default_regions(spark), fx.fire_classes(spark, sf),
                                       spark.createDataFrame([(1, T0, 2, 0.5, 1.0)], "regiao_id int, hr timestamp, uas int, mean_mm double, max_mm double"))
    assert all(isinstance(df.limit(1).count(), int) for df in blocks.values()) and len(blocks) == 16
    board = products.dashboard(fx.points(spark, sf), fx.fire_classes(spark, sf))
    assert board["top_units"].count() == 10


def test_cycle_series_defaults(spark):
    rows = [(T0, "ok", [1, 2, 3, 4, 5], None), (T0, "ok", None, 7)]
    df = spark.createDataFrame(rows, "started_at timestamp, outcome string, by_level array<int>, alert_count int").withColumns(
        {"max_rd": F.lit(None).cast("int"), "gauge": F.struct(F.lit(0.5).alias("mean_factor"), F.lit(3).alias("stations_recent"))}).coalesce(1)
    got = analytics.cycle_series(df).collect()
    assert [(r.alert_count, r.by_level, r.gauge_factor) for r in got] == [(9, [1, 2, 3, 4, 5], 0.5), (7, [0] * 5, 0.5)]
