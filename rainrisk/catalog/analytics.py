from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixtures as fx
from ..constants import AC24H_EDGES, AC96H_EDGES, INTENSITY_EDGES
from ..functions import text
from ..operators import analytics, risk
from ..streaming import alerts, history as hist
from . import query
from .rain import T, TICKS, TXT
from .risk import LABEL, PLACED

GEO = "hazard='geo' AND ac24h_mm IS NOT NULL"


@query("AGG-12 AGG-15", fx.sql_with("points regions", {"s": f"""SELECT regiao_id, COUNT(*) FILTER (hazard='geo') AS uas_geo, COUNT(*) FILTER (hazard='hidro') AS uas_hidro, COUNT(*) FILTER (hazard='geo' AND rd=4) AS geo_rd4,
    COUNT(*) FILTER (hazard='hidro' AND rd=0) AS hidro_rd0, ROUND(MAX(ac24h_mm::DECIMAL(18,4)) FILTER ({GEO}), 1)::DOUBLE AS ac24h_max, ROUND(quantile_cont(ac24h_mm, 0.9) FILTER ({GEO})::DECIMAL(18,6), 2)::DOUBLE AS ac24h_p90,
    MAX(cpc) FILTER (hazard='geo') AS cpc_max FROM points WHERE regiao_id IS NOT NULL GROUP BY regiao_id"""}, """SELECT r.regiao_id, COALESCE(uas_geo, 0) AS uas_geo, COALESCE(uas_hidro, 0) AS uas_hidro, COALESCE(geo_rd4, 0) AS geo_rd4, COALESCE(hidro_rd0, 0) AS hidro_rd0,
    ac24h_max, ac24h_p90, cpc_max, len([x FOR x IN hid24h_breaks IF ac24h_max >= x])::INT AS hid_level, hid24h_breaks[(len([x FOR x IN hid24h_breaks IF ac24h_max >= x])+1)] AS hid_next_break,
    ROUND(COALESCE(hid24h_breaks[(len([x FOR x IN hid24h_breaks IF ac24h_max >= x])+1)] - ac24h_max, 0e0), 1) AS hid_margin_mm, len([x FOR x IN cpc_breaks IF cpc_max >= x])::INT AS cpc_level FROM regions r LEFT JOIN s USING (regiao_id)"""))
def regional_summary(spark, sf):
    out = analytics.regional_summary(fx.points(spark, sf), risk.default_regions(spark))
    return out.select("regiao_id", "uas_geo", "uas_hidro", "geo_rd4", "hidro_rd0", "ac24h_max", "ac24h_p90", "cpc_max", "hid_level", "hid_next_break", "hid_margin_mm", "cpc_level")


@query("AGG-12", fx.sql_with("points", {}, "SELECT COUNT(*) AS points_unassigned FROM points WHERE COALESCE(regiao_id, 0) NOT BETWEEN 1 AND 4"))
def unassigned_points(spark, sf):
    return analytics.unassigned_points(fx.points(spark, sf), risk.default_regions(spark))


BYHOUR = f"""SELECT p.regiao_id, s.hr, COUNT(*) AS uas, ROUND((SUM(COALESCE({TICKS}, 0))::DOUBLE/COUNT(*)/10000e0)::DECIMAL(18,9), 2)::DOUBLE AS mean_mm, ((MAX(COALESCE({TICKS}, 0))+50)//100)::DOUBLE/100e0 AS max_mm
    FROM placed p JOIN units u USING (ua_id) CROSS JOIN (SELECT {T} - to_hours(i::INT) AS hr FROM range(96) r(i)) s LEFT JOIN grid_hourly g ON g.lat_idx=u.lat_idx AND g.lon_idx=u.lon_idx AND g.hr=s.hr
    WHERE p.regiao_id IS NOT NULL GROUP BY ALL"""


def _by_hour(spark, sf):
    from ..operators.spatial import containing_region

    placed = containing_region(fx.units(spark, sf), risk.default_regions(spark))
    return analytics.hourly_by_region(fx.grid_hourly(spark, sf, 96), placed, ["lat_idx", "lon_idx"], fx.target())


@query("AGG-13", fx.sql_with("units regions grid_hourly", {"placed": PLACED, "bh": BYHOUR}, "SELECT regiao_id, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hr, uas, mean_mm, max_mm FROM bh"))
def hourly_region_rain(spark, sf):
    return _by_hour(spark, sf).withColumn("hr", F.date_format("hr", TXT))


@query("AGG-13 A-12", fx.sql_with("units regions grid_hourly", {"placed": PLACED, "bh": BYHOUR}, "SELECT regiao_id, MAX(uas) AS uas, ROUND(SUM(mean_mm::DECIMAL(18,2)), 1)::DOUBLE AS sum96_mean, MAX(max_mm) AS peak_mmh FROM bh GROUP BY regiao_id"))
def region_rain_totals(spark, sf):
    return analytics.region_hour_totals(_by_hour(spark, sf))


def _bins(column: str, edges) -> str:
    idx = f"GREATEST(0, len([x FOR x IN {[float(e) for e in edges]} IF {column} >= x])-1)"
    return f"SELECT {idx} AS bin, COUNT(*) AS n FROM points WHERE {GEO} GROUP BY 1"


@query("AGG-14", fx.sql_with("points", {"c": _bins("ac24h_mm - 2e0", AC24H_EDGES)}, f"""SELECT i::INT AS bin, {[float(e) for e in AC24H_EDGES]}[i+1]::DOUBLE AS lower, {[float(e) for e in AC24H_EDGES]}[i+2]::DOUBLE AS upper, COALESCE(n, 0) AS n FROM range(6) r(i) LEFT JOIN c ON c.bin = i"""))
def rain_histogram(spark, sf):
    p = fx.points(spark, sf).where("hazard = 'geo'").withColumn("v", F.col("ac24h_mm") - 2.0)
    return analytics.histogram(p, "v", AC24H_EDGES)


@query("AGG-16", fx.sql_with("points", {"c": " UNION ALL ".join(f"SELECT '{k}' AS measure, bin, n FROM ({_bins(c, e)})" for k, c, e in (("ac24h", "ac24h_mm", AC24H_EDGES), ("ac96h", "ac96h_mm", AC96H_EDGES), ("intensity", "intensity_mmh", INTENSITY_EDGES))),
       "e": " UNION ALL ".join(f"SELECT '{k}' AS measure, {i} AS bin, {float(v)}e0 AS lower" for k, e in (("ac24h", AC24H_EDGES), ("ac96h", AC96H_EDGES), ("intensity", INTENSITY_EDGES)) for i, v in enumerate(e))},
       "SELECT measure, bin, lower, COALESCE(n, 0) AS n FROM e LEFT JOIN c USING (measure, bin)"))
def distribution_bins(spark, sf):
    return analytics.distribution_bins(fx.points(spark, sf))


LONG = " UNION ALL ".join(f"SELECT '{k}' AS measure, {c} AS v FROM points WHERE {GEO}" for k, c in (("ac24h", "ac24h_mm"), ("ac96h", "ac96h_mm"), ("intensity", "intensity_mmh")))


@query("AGG-15 AGG-16", fx.sql_with("points", {"l": LONG}, """SELECT measure, COUNT(*) AS n_values, ROUND(quantile_cont(v, 0.5)::DECIMAL(18,6), 2)::DOUBLE AS p50, ROUND(quantile_cont(v, 0.9)::DECIMAL(18,6), 2)::DOUBLE AS p90,
    CASE measure WHEN 'intensity' THEN ROUND(MAX(v)::DECIMAL(18,6), 2)::DOUBLE ELSE ROUND(MAX(v)::DECIMAL(18,6), 1)::DOUBLE END AS max FROM l GROUP BY measure"""))
def rain_distributions(spark, sf):
    return analytics.distributions(fx.points(spark, sf))


@query("AGG-15", fx.sql_with("", {}, "SELECT o_orderstatus, COUNT(*) AS n_values, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS p50, ROUND(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY o_orderstatus"))
def exact_price_quantiles(spark, sf):
    from ..operators.scale import exact_quantiles

    q = exact_quantiles(fx.table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", {"p50": 0.5, "p95": 0.95})
    return q.withColumns({c: F.round(c, 4) for c in ("p50", "p95")})


ESC = {"t": "SELECT *, row_number() OVER (PARTITION BY ua_id, hazard ORDER BY ts DESC, cycle_id DESC) AS back FROM history QUALIFY back <= 24",
       "g": """SELECT ua_id, hazard, COUNT(*)::INT AS depth, arg_min(rd, back) AS rd_now, MAX(CASE WHEN back = 7 THEN rd END) AS rd_1h, arg_max(rd, back) AS first_rd, string_agg(rd::VARCHAR, ',' ORDER BY back DESC) AS trail FROM t GROUP BY ALL""",
       "e": "SELECT *, CASE WHEN depth >= 2 THEN first_rd END AS rd_4h, CASE WHEN depth >= 2 THEN first_rd ELSE rd_now END AS rd_prev, rd_now - CASE WHEN depth >= 2 THEN first_rd ELSE rd_now END AS delta FROM g"}


@query("WIN-02 STR-08", fx.sql_with("history", ESC, "SELECT ua_id, hazard, trail, depth FROM g"))
def unit_trails(spark, sf):
    return analytics.trails(fx.history(spark, sf)).withColumn("trail", F.array_join("trail", ","))


@query("WIN-03", fx.sql_with("history", ESC, "SELECT ua_id, hazard, rd_now, rd_1h, rd_4h, rd_prev, delta FROM e"))
def escalation(spark, sf):
    return analytics.escalation(fx.history(spark, sf)).select("ua_id", "hazard", "rd_now", "rd_1h", "rd_4h", "rd_prev", "delta")


@query("WIN-03", fx.sql_with("history", ESC, """SELECT MAX(depth) AS cycles_tracked, COUNT(*) FILTER (rd_now > rd_1h) AS up_1h, COUNT(*) FILTER (rd_now < rd_1h) AS down_1h, COUNT(*) FILTER (rd_now > rd_4h) AS up_4h,
    COUNT(*) FILTER (rd_now < rd_4h) AS down_4h, COUNT(*) FILTER (delta = 0 AND rd_now >= 3) AS steady_alert_total FROM e"""))
def escalation_counts(spark, sf):
    return analytics.escalation_counts(analytics.escalation(fx.history(spark, sf)))


ESC_POINTS = ESC | {"d": "SELECT e.*, p.sigla_rodovia, p.region_name, p.ac24h_mm, p.ac96h_mm FROM e LEFT JOIN points p USING (ua_id, hazard)"}
LISTED = "ua_id, hazard, delta, rd_prev, rd_now, sigla_rodovia, region_name, ac24h_mm, ac96h_mm"


@query("TOP-03", fx.sql_with("history points", ESC_POINTS, f"""SELECT 'rising' AS list, row_number() OVER (ORDER BY delta DESC, rd_now DESC, ua_id, hazard) AS place, {LISTED} FROM d WHERE delta > 0 QUALIFY place <= 12
    UNION ALL SELECT 'falling', row_number() OVER (ORDER BY delta, rd_prev DESC, ua_id, hazard) AS place, {LISTED} FROM d WHERE delta < 0 QUALIFY place <= 12
    UNION ALL SELECT 'steady', row_number() OVER (ORDER BY rd_now DESC, COALESCE(ac24h_mm, 0) DESC, ua_id, hazard) AS place, {LISTED} FROM d WHERE delta = 0 AND rd_now >= 3 QUALIFY place <= 12"""))
def escalation_lists(spark, sf):
    e = analytics.described(analytics.escalation(fx.history(spark, sf)), fx.points(spark, sf))
    parts = [(n, f(e)) for n, f in (("rising", analytics.rising), ("falling", analytics.falling), ("steady", analytics.steady))]
    # the lists hold twelve rows; their order is part of the result
    parts = [(n, d.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))) for n, d in parts]
    frames = [d.select(F.lit(n).alias("list"), "place", *LISTED.split(", ")) for n, d in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("AGG-29 WIN-05", fx.sql_with("cycles", {"g": "SELECT date_diff('second', lag(started_at) OVER (ORDER BY started_at, cycle_id), started_at)/60e0 AS gap FROM cycles"}, """SELECT COUNT(*) AS cycles, COUNT(*) FILTER (outcome='ok') AS ok, COUNT(*) FILTER (outcome='error') AS error,
    COUNT(*) FILTER (outcome='skipped') AS skipped, COUNT(*) FILTER (data_status='degraded') AS degraded, ROUND(MAX(duration_s)::DECIMAL(18,6), 2)::DOUBLE AS duration_max_s, ROUND(100e0*SUM(files_ok)/COUNT(files_ok)/96e0, 1) AS completeness_pct, ROUND(100e0*COUNT(*) FILTER (outcome='ok')/COUNT(*), 1) AS success_rate_pct,
    ROUND(quantile_cont(duration_s, 0.5)::DECIMAL(18,9), 2)::DOUBLE AS duration_p50_s, ROUND(quantile_cont(duration_s, 0.95)::DECIMAL(18,9), 2)::DOUBLE AS duration_p95_s, (SELECT ROUND(quantile_cont(gap, 0.5), 2) FROM g) AS interval_p50_min, (SELECT ROUND(MAX(gap), 1) FROM g) AS interval_max_min FROM cycles"""))
def operations(spark, sf):
    return analytics.operations(fx.cycles(spark, sf))


@query("JOIN-12", fx.sql_with("cycles", {"l": "SELECT arg_max(alert_count, (started_at, cycle_id)) AS a, MAX(started_at) AS t FROM cycles"}, """SELECT a AS alert_count, a - (SELECT arg_max(alert_count, (started_at, cycle_id)) FROM cycles, l WHERE started_at <= t - INTERVAL 1 HOUR) AS alert_delta_1h,
    a - (SELECT arg_max(alert_count, (started_at, cycle_id)) FROM cycles, l WHERE started_at <= t - INTERVAL 24 HOURS) AS alert_delta_24h FROM l"""))
def alert_deltas(spark, sf):
    return analytics.alert_deltas(fx.cycles(spark, sf))


LAST = ", ".join(f"arg_max({e}, (started_at, cycle_id)) AS {n}" for n, e in [(c, c) for c in ("files_ok", "duration_s", "missing_24h", "data_status", "ac24h_max", "ac96h_max", "intensity_max")]
                 + [("gauge", "{'g': gauge}")])


@query("AGG-43 CMP-08", fx.sql_with("cycles points", {"l": f"SELECT arg_max(alert_count, (started_at, cycle_id)) AS a, MAX(started_at) AS t, {LAST} FROM cycles", "m": "SELECT MAX(rd) AS rd FROM points"}, f"""SELECT
    (SELECT COUNT(*) FROM points WHERE rd >= 3) AS alerts_now, m.rd AS max_rd, {LABEL} AS max_rd_name, a - (SELECT arg_max(alert_count, (started_at, cycle_id)) FROM cycles, l WHERE started_at <= t - INTERVAL 1 HOUR) AS alert_delta_1h,
    a - (SELECT arg_max(alert_count, (started_at, cycle_id)) FROM cycles, l WHERE started_at <= t - INTERVAL 24 HOURS) AS alert_delta_24h, files_ok, duration_s, missing_24h, data_status, ac24h_max, ac96h_max, intensity_max,
    gauge.g.mean_factor AS gauge_factor, gauge.g.stations_recent AS gauge_stations FROM l, m"""))
def headline(spark, sf):
    return analytics.headline(fx.points(spark, sf), fx.cycles(spark, sf))


@query("FLT-24 SCL-31", fx.sql_with("cycles", {}, "SELECT strftime(started_at, '%Y-%m-%d %H:%M:%S') AS at, outcome, array_to_string(by_level, ',') AS by_level, alert_count, max_rd, files_ok, missing_24h, duration_s, data_status, ac24h_max, ac96h_max, intensity_max, gauge.mean_factor AS gauge_factor, gauge.stations_recent AS gauge_stations FROM cycles"))
def cycle_series(spark, sf):
    out = analytics.cycle_series(fx.cycles(spark, sf))
    return out.withColumns({"at": F.date_format("at", TXT), "by_level": F.array_join("by_level", ",")})


@query("FLT-24", fx.sql_with("cycles", {}, "SELECT COUNT(*) AS count, strftime(MIN(started_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(MAX(started_at), '%Y-%m-%d %H:%M:%S') AS last FROM cycles"))
def series_span(spark, sf):
    return analytics.series_span(fx.cycles(spark, sf)).select("count", F.date_format("from", TXT).alias("first"), F.date_format("to", TXT).alias("last"))


@query("FLT-16", fx.sql_with("cycles", {}, "SELECT cycle_id FROM cycles WHERE cycle_id%10=0 OR started_at >= TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 24 HOURS"))
def recent_window(spark, sf):
    c = fx.cycles(spark, sf).withColumn("started_at", F.when(F.col("cycle_id") % 10 != 0, F.col("started_at")))
    return analytics.recent_window(c, F.lit("2024-03-01 00:00:00").cast("timestamp"), 24).select("cycle_id")


@query("TOP-01 CMP-09", fx.sql_with("points", {}, "SELECT ua_id, hazard, rd, ac96h_mm FROM points ORDER BY rd DESC, ac96h_mm DESC, ua_id, hazard LIMIT 10"))
def top_units(spark, sf):
    return analytics.top_units(fx.points(spark, sf)).select("ua_id", "hazard", "rd", "ac96h_mm")


@query("AGG-26", fx.sql_with("points", {}, "SELECT COALESCE(region_name, 'Fora de cobertura') AS regiao, " + ", ".join(f"COUNT(*) FILTER (rd={i}) AS rd{i}" for i in range(5)) + " FROM points GROUP BY 1"))
def region_matrix(spark, sf):
    return analytics.region_matrix(fx.points(spark, sf))


@query("TOP-06", fx.sql_with("cycles", {}, "SELECT cycle_id, outcome FROM cycles ORDER BY started_at DESC, cycle_id DESC LIMIT 12"))
def latest_cycles(spark, sf):
    return analytics.latest_cycles(fx.cycles(spark, sf)).select("cycle_id", "outcome")


@query("SNK-05", fx.sql_with("cycles", {}, "SELECT cycle_id FROM cycles ORDER BY started_at DESC, cycle_id DESC LIMIT 2016"))
def telemetry_tail(spark, sf):
    out = hist.compact_telemetry(fx.cycles(spark, sf).withColumn("batch_id", F.col("cycle_id")), keep=2016)
    return out.select("cycle_id")


@query("STR-07 TOP-05", fx.sql_with("history", {}, "SELECT ua_id, hazard, rd FROM history QUALIFY row_number() OVER (PARTITION BY ua_id, hazard ORDER BY ts DESC, cycle_id DESC) = 1 AND rd >= 3"))
def active_alerts(spark, sf):
    return alerts.active_alerts(fx.history(spark, sf)).select("ua_id", "hazard", "rd")


@query("STR-07 TOP-05", fx.sql_with("points history", {"s": "SELECT hazard, ua_id, rd AS level, ts AS sent_at FROM history WHERE rd >= 3 QUALIFY row_number() OVER (PARTITION BY ua_id, hazard ORDER BY ts DESC, cycle_id DESC) = 1"}, """SELECT ua_id, hazard, rd,
    CASE WHEN level IS NULL THEN 'new' WHEN rd > level THEN 'escalated' ELSE 'reminder' END AS reason FROM points LEFT JOIN s USING (hazard, ua_id) WHERE rd >= 3 AND source <> 'NO_DATA' AND (level IS NULL OR rd > level OR TIMESTAMP '2001-06-01 00:00:00' - sent_at >= INTERVAL 6 HOURS)"""))
def alerts_to_send(spark, sf):
    h = fx.history(spark, sf).where("rd >= 3")
    state = h.groupBy("hazard", "ua_id").agg(F.max_by(F.struct("rd", "ts"), F.struct("ts", "cycle_id")).alias("l")).select(
        "hazard", "ua_id", F.col("l.rd").alias("level"), F.col("l.ts").cast("timestamp").alias("sent_at"))
    out, _ = alerts.step(fx.points(spark, sf), state, F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return alerts.ordered(out).select("ua_id", "hazard", "rd", "reason")


YEARLY = {"p": "SELECT hazard, ua_id, date_trunc('year', ts)::TIMESTAMP AS cyc, MAX(rd) AS rd FROM history GROUP BY ALL", "c": "SELECT cyc, row_number() OVER (ORDER BY cyc) AS o FROM (SELECT DISTINCT cyc FROM p)",
          "j": "SELECT hazard, ua_id, cyc, o, rd FROM p JOIN c USING (cyc) WHERE rd >= 3"}


@query("STR-07", fx.sql_with("history", YEARLY, """SELECT hazard, ua_id, strftime(cyc, '%Y-%m-%d') AS cycle, rd, reason FROM (WITH RECURSIVE r AS (
    SELECT hazard, ua_id, cyc, o, rd, rd AS level, cyc AS sent, 'new' AS reason FROM j WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.hazard = j.hazard AND b.ua_id = j.ua_id AND b.o = j.o - 1)
    UNION ALL
    SELECT hazard, ua_id, cyc, o, rd, CASE WHEN why IS NULL THEN level ELSE rd END, CASE WHEN why IS NULL THEN sent ELSE cyc END, why FROM (
        SELECT j.hazard, j.ua_id, j.cyc, j.o, j.rd, r.level, r.sent, CASE WHEN j.rd > r.level THEN 'escalated' WHEN date_diff('hour', r.sent, j.cyc) >= 12000 THEN 'reminder' END AS why
        FROM r JOIN j ON j.hazard = r.hazard AND j.ua_id = r.ua_id AND j.o = r.o + 1)) SELECT * FROM r) WHERE reason IS NOT NULL"""))
def alert_log(spark, sf):
    """All alerts of a backlog of cycles, judged in one pass."""
    year = F.date_trunc("year", F.col("ts")).cast("timestamp").alias("cycle_at")
    rows = fx.history(spark, sf).groupBy("hazard", "ua_id", year).agg(F.max("rd").alias("rd")).withColumn("source", F.lit("SATELLITE"))
    out, _ = alerts.steps(rows, spark.createDataFrame([], "hazard string, ua_id long, level int, sent_at timestamp"), cooldown_h=12000)
    return out.select("hazard", "ua_id", F.date_format("cycle_at", "yyyy-MM-dd").alias("cycle"), "rd", "reason")


@query("SNK-07", fx.sql_with("points", {"a": "SELECT * FROM points WHERE rd >= 3", "t": "SELECT *, row_number() OVER (ORDER BY rd DESC, ac96h_mm DESC, ua_id, hazard) AS k FROM a"}, """SELECT printf('%d unit(s) at risk (RD>=3) - max RD%d', COUNT(*), MAX(rd)) AS subject, COUNT(*) AS n,
    (SELECT string_agg('- [' || ua_id || '] RD' || rd || ' (' || CASE rd WHEN 3 THEN 'Alerta' ELSE 'Alerta Máximo' END || ') | RA' || ra || ' | 24h=' || ac24h_mm || 'mm 96h=' || ac96h_mm || 'mm | ' || COALESCE(region_name, ''), chr(10) ORDER BY k) FROM t WHERE k <= 50)
    || CASE WHEN COUNT(*) > 50 THEN chr(10) || '... (+' || (COUNT(*)-50) || ' units)' ELSE '' END AS body FROM a"""))
def alert_message(spark, sf):
    from ..functions.risk import level_label
    from ..sinks.outputs import alert_message as message

    return message(fx.points(spark, sf).where("rd >= 3").withColumn("nivel", level_label(F.col("rd"))))


NOTICE_TABLES = {
    "a": "SELECT p.*, u.lat, u.lon, u.km0 AS km FROM points p JOIN units u USING (ua_id) WHERE rd >= 3 AND hazard = 'geo'",
    "t": """SELECT *, CASE rd WHEN 3 THEN 'Alerta' ELSE 'Alerta Máximo' END AS nivel, row_number() OVER (ORDER BY rd DESC, ac96h_mm DESC, ua_id) AS k FROM a""",
    "b": """SELECT '[Encosta] ' || COUNT(*) || ' unit(s) at risk (RD>=3) - max RD' || MAX(rd) AS subject, COUNT(*) AS n, 'Alert - contingency plan (SP-055)' || chr(10) || 'Channel: Encosta' || chr(10) ||
        'Time (UTC): 2024-01-30T18:00:00+00:00' || chr(10) || 'Rain source: SATELLITE (status: ok)' || chr(10) || chr(10) || COUNT(*) || ' unit(s) with dynamic risk >= 3:' || chr(10) || chr(10) ||
        string_agg('- [' || ua_id || '] RD' || rd || ' (' || nivel || ') | RA' || ra || ' | 24h=' || ac24h_mm || 'mm 96h=' || ac96h_mm || 'mm | ' || COALESCE(region_name, ''), chr(10) ORDER BY k) FILTER (k <= 50)
        || CASE WHEN COUNT(*) > 50 THEN chr(10) || '... (+' || (COUNT(*)-50) || ' units)' ELSE '' END AS text,
        list({'id': ua_id, 'nome': NULL, 'rodovia': sigla_rodovia, 'km': km, 'rd': rd, 'nivel': nivel, 'ra': ra, 'lat': lat, 'lon': lon, 'ac24h_mm': ac24h_mm, 'ac96h_mm': ac96h_mm, 'region': region_name}
             ORDER BY k) FILTER (k <= 100) AS zones FROM t"""}


@query("SNK-07", fx.sql_with("points units", NOTICE_TABLES, """SELECT subject, text, to_json({'text': subject || chr(10) || text, 'subject': subject, 'timestamp': '2024-01-30T18:00:00+00:00', 'count': n,
    'threshold': 3, 'zones': zones})::VARCHAR AS payload FROM b"""))
def alert_notice(spark, sf):
    from ..functions.risk import level_label
    from ..sinks.outputs import alert_notice as notice

    places = fx.units(spark, sf).select("ua_id", "lat", "lon", F.col("km0").alias("km"))
    alerts = fx.points(spark, sf).where("rd >= 3 AND hazard = 'geo'").join(places, "ua_id").withColumn("nivel", level_label(F.col("rd")))
    return notice(alerts, fx.target(), F.lit("SATELLITE"), F.lit("ok"), "geo", roads="SP-055")


@query("SNK-11 STR-09", fx.sql_with("cycles", {}, "SELECT outcome, COUNT(*) AS rows, 'cycle' AS step FROM cycles GROUP BY outcome"))
def run_records(spark, sf):
    c = fx.cycles(spark, sf)
    return c.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit("cycle"))


@query("SCL-23 SCL-33", fx.sql_with("cycles", {}, """SELECT cycle_id, strftime(started_at - INTERVAL 3 HOURS, '%d/%m/%Y %H:%M:%S') AS started_fmt, strftime(started_at, '%d/%m/%Y') AS day_fmt,
    CASE outcome WHEN 'ok' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'warn' END AS light FROM cycles"""))
def formatted_cycles(spark, sf):
    c = fx.cycles(spark, sf)
    status = F.when(F.col("outcome") == "skipped", "degraded").otherwise(F.col("outcome"))
    return c.select("cycle_id", text.format_datetime(F.col("started_at")).alias("started_fmt"), text.format_date(F.col("started_at")).alias("day_fmt"),
                    text.traffic_light(status).alias("light"))
