from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import gauges
from ..plans import cycle
from . import query
from .rain import CELL_WINDOWS, HOURS, R, T, TICKS, TXT, UNIT_WINDOWS, WINDOW_COLS, inputs


def hav(a: str, b: str) -> str:
    c = (f"(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))")
    return f"(2*6371e0*atan2(sqrt({c}), sqrt(1e0-{c})))"


PAIRS30 = f"SELECT u.ua_id, s.*, {hav('u', 's')} AS d FROM units u, stations_24h s WHERE {hav('u', 's')} <= 30"
ANCHOR = """SELECT u.ua_id, COALESCE(p.snap.v, num/den) AS g24_mm, COALESCE(p.snap.d, dmin) AS d_min_km, n_covered, n_dry, d_covered FROM units u JOIN (
    SELECT ua_id, arg_min({'v': value_mm, 'd': d}, station_id) FILTER (d < 0.5) AS snap, SUM(value_mm/(d*d)) FILTER (d >= 0.5) AS num, SUM(1/(d*d)) FILTER (d >= 0.5) AS den,
    MIN(d) AS dmin, COUNT(*) FILTER (coverage_hours >= 18) AS n_covered, COUNT(*) FILTER (coverage_hours >= 18 AND value_mm <= 2) AS n_dry,
    MIN(d) FILTER (coverage_hours >= 18) AS d_covered FROM pairs GROUP BY ua_id) p USING (ua_id)"""


@query("AGG-03 JOIN-06 SCL-01", fx.sql_with("units stations gauge_hourly stations_24h", {"pairs": PAIRS30, "est": ANCHOR},
       "SELECT ua_id, ROUND(g24_mm, 6) AS g24_mm, ROUND(d_min_km, 6) AS d_min_km, n_covered::BIGINT AS n_covered, n_dry::BIGINT AS n_dry FROM est"))
def anchor_estimates(spark, sf):
    u = fx.units(spark, sf)
    est = gauges.anchor_estimates(u, fx.stations_24h(spark, sf), coverage="coverage_hours")
    return u.join(est, ["lat", "lon"]).select("ua_id", F.round("g24_mm", 6).alias("g24_mm"), F.round("d_min_km", 6).alias("d_min_km"), "n_covered", "n_dry")


@query("AGG-05", fx.sql_with("units stations gauge_hourly stations_24h", {"pairs": PAIRS30.replace("<= 30", ">= 0")}, """SELECT ua_id, ROUND(COALESCE(arg_min(value_mm, station_id) FILTER (d < 0.1),
    SUM(value_mm/(d*d)) FILTER (d >= 0.1)/SUM(1/(d*d)) FILTER (d >= 0.1)), 6) AS value_mm FROM pairs GROUP BY ua_id"""))
def plain_distance_mean(spark, sf):
    u = fx.units(spark, sf)
    est = gauges.network_mean(u, fx.stations_24h(spark, sf))
    return u.join(est, ["lat", "lon"]).select("ua_id", F.round("g24_mm", 6).alias("value_mm"))


@query("AGG-06", fx.sql_with("units stations gauge_hourly stations_24h", {"pairs": PAIRS30, "est": ANCHOR},
       "SELECT ua_id FROM est WHERE g24_mm <= 2 AND n_covered >= 3 AND d_covered <= 15 AND n_dry/n_covered::DOUBLE >= 0.8e0"))
def dry_ground_units(spark, sf):
    u = fx.units(spark, sf)
    est = gauges.anchor_estimates(u, fx.stations_24h(spark, sf), coverage="coverage_hours")
    dry = gauges.dry_consensus(F.col("g24_mm"), F.col("n_covered"), F.col("n_dry"), F.col("d_covered"))
    return u.join(est, ["lat", "lon"]).where(dry).select("ua_id")


CORRECTED = """SELECT *, CASE br WHEN 'override' THEN GREATEST(0e0, LEAST(1e0, g24_mm/ac24h_mm)) WHEN 'scale' THEN GREATEST(0.1e0, LEAST(3e0, blend/ac24h_mm)) END AS factor FROM (
  SELECT *, CASE WHEN g24_mm IS NULL OR w <= 0 OR (ac24h_mm <= 0.5 AND g24_mm <= 0.5) THEN 'none'
    WHEN ac24h_mm >= 50 AND g24_mm <= 2 AND n_covered >= 3 AND d_covered <= 15 AND n_dry/n_covered::DOUBLE >= 0.8e0 THEN 'override'
    WHEN ac24h_mm > 0.5 THEN 'scale' ELSE 'add' END AS br FROM (
    SELECT uw.*, g24_mm, d_min_km, n_covered, n_dry, d_covered, 0.85e0*GREATEST(0e0, 1e0-d_min_km/30e0) AS w,
      0.85e0*GREATEST(0e0, 1e0-d_min_km/30e0)*g24_mm + (1e0-0.85e0*GREATEST(0e0, 1e0-d_min_km/30e0))*ac24h_mm AS blend FROM uw LEFT JOIN est USING (ua_id)))"""
MOVED = """SELECT ua_id, br AS correction, factor, CASE br WHEN 'override' THEN intensity_mmh*factor WHEN 'scale' THEN intensity_mmh*factor ELSE intensity_mmh END AS i,
  CASE br WHEN 'override' THEN ac18h_mm*factor WHEN 'scale' THEN ac18h_mm*factor WHEN 'add' THEN ac18h_mm+blend*0.8e0 ELSE ac18h_mm END AS a18,
  CASE br WHEN 'override' THEN g24_mm WHEN 'scale' THEN ac24h_mm*factor WHEN 'add' THEN ac24h_mm+blend ELSE ac24h_mm END AS a24,
  CASE br WHEN 'override' THEN GREATEST(0e0, ac72h_mm-ac24h_mm)+g24_mm WHEN 'scale' THEN ac72h_mm*factor WHEN 'add' THEN ac72h_mm+blend ELSE ac72h_mm END AS a72,
  CASE br WHEN 'override' THEN GREATEST(0e0, ac96h_mm-ac24h_mm)+g24_mm WHEN 'scale' THEN ac96h_mm*factor WHEN 'add' THEN ac96h_mm+blend ELSE ac96h_mm END AS a96 FROM co"""
CENTS = lambda x: f"ROUND(({x})::DECIMAL(18,6), 2)::DOUBLE"
GROWN = f"""SELECT ua_id, correction, factor, i AS intensity_mmh, a18 AS ac18h_mm, GREATEST(a24, a18) AS ac24h_mm, GREATEST(a72, a24, a18) AS ac72h_mm, GREATEST(a96, a72, a24, a18) AS ac96h_mm
  FROM (SELECT ua_id, correction, factor, {', '.join(f"{CENTS(c)} AS {c}" for c in ('i', 'a18', 'a24', 'a72', 'a96'))} FROM mv)"""
CORR_CTES = {"pairs": PAIRS30, "est": ANCHOR, "cw": CELL_WINDOWS, "uw": UNIT_WINDOWS, "co": CORRECTED, "mv": MOVED}


def corrected(spark, sf):
    data = inputs(spark, sf)
    est = gauges.anchor_estimates(data.units, fx.stations_24h(spark, sf), coverage="coverage_hours")
    return gauges.correct_rain(cycle.satellite_windows(data, fx.target()), est)


@query("SCL-10 SCL-11 SCL-12", fx.sql_with("units grid_hourly stations gauge_hourly stations_24h", CORR_CTES | {"gn": GROWN}, f"""SELECT ua_id, correction, ROUND(factor, 6) AS factor,
    {', '.join(WINDOW_COLS)} FROM gn"""))
def corrected_branches(spark, sf):
    return corrected(spark, sf).select("ua_id", "correction", F.round("factor", 6).alias("factor"), *WINDOW_COLS)


@query("SCL-11 AGG-30", fx.sql_with("units grid_hourly stations gauge_hourly stations_24h", CORR_CTES, """SELECT COUNT(*) FILTER (correction <> 'none') AS points_corrected,
    COUNT(*) FILTER (correction = 'override') AS points_ground_override, ROUND(SUM(ROUND(factor*1e9)::BIGINT)/COUNT(factor)/1e9, 3) AS mean_factor,
    ROUND(MIN(factor) FILTER (factor < 1), 3) AS max_downscale, ROUND(MAX(factor) FILTER (factor > 1), 3) AS max_upscale FROM mv"""))
def correction_summary(spark, sf):
    return gauges.correction_summary(corrected(spark, sf))


@query("JOIN-05", fx.sql_with("units stations", {}, f"SELECT DISTINCT s.station_id FROM stations s SEMI JOIN units u ON {hav('u', 's')} <= 2"))
def stations_near_units(spark, sf):
    return gauges.stations_near(fx.stations(spark, sf), fx.units(spark, sf), 2.0).select("station_id")


SERIES = f"""SELECT u.ua_id, g.hr, SUM(g.mm/pow(GREATEST({hav('u', 's')}, 0.5e0), 2))/SUM(1e0/pow(GREATEST({hav('u', 's')}, 0.5e0), 2)) AS mm
    FROM units u JOIN stations s ON {hav('u', 's')} <= 30 JOIN gauge_hourly g USING (station_id) WHERE {HOURS} BETWEEN 0 AND 95 GROUP BY u.ua_id, g.hr"""


@query("AGG-04 JOIN-07 STR-14", fx.sql_with("units stations gauge_hourly", {"sr": SERIES}, "SELECT ua_id, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hr, ROUND(mm, 6) AS mm FROM sr"))
def gauge_point_series(spark, sf):
    u = fx.units(spark, sf)
    s = gauges.point_series(u, fx.stations(spark, sf), fx.gauge_hourly(spark, sf, 96), fx.target(), 30.0)
    return u.join(s, ["lat", "lon"]).select("ua_id", F.date_format("hr", TXT).alias("hr"), F.round("mm", 6).alias("mm"))


COVER = f"""SELECT ua_id, {R(f"COALESCE(SUM(CASE WHEN {HOURS}=0 THEN {TICKS} END),0)")} AS intensity_mmh,
    {', '.join(R(f"COALESCE(SUM(CASE WHEN {HOURS}<{n} THEN {TICKS} END),0)") + f" AS ac{n}h_mm" for n in (18, 24, 72, 96))},
    COUNT(*) FILTER ({HOURS} < 24) AS covered_24, COUNT(*) AS covered_96, bool_or({HOURS} = 0) AS covered_target FROM sr GROUP BY ua_id"""


@query("AGG-04 FLT-21 SCL-13", fx.sql_with("units stations gauge_hourly", {"sr": SERIES, "cv": COVER}, f"""SELECT ua_id, {', '.join(WINDOW_COLS)}, covered_24::INT AS covered_24,
    covered_96::INT AS covered_96, covered_target, covered_target AND covered_24 >= 22 AND covered_96 >= 87 AS qualifies FROM cv"""))
def gauge_coverage(spark, sf):
    u = fx.units(spark, sf)
    s = gauges.point_series(u, fx.stations(spark, sf), fx.gauge_hourly(spark, sf, 96), fx.target(), 30.0)
    c = gauges.point_coverage(s, fx.target()).withColumn("qualifies", gauges.qualifies())
    return u.join(c, ["lat", "lon"]).select("ua_id", *WINDOW_COLS, "covered_24", "covered_96", "covered_target", "qualifies")


@query("AGG-04", fx.sql_with("units stations", {}, f"SELECT u.ua_id, COUNT(*) AS stations FROM units u JOIN stations s ON {hav('u', 's')} <= 15 GROUP BY u.ua_id"))
def stations_in_radius(spark, sf):
    u = fx.units(spark, sf)
    return u.join(gauges.station_counts(u, fx.stations(spark, sf)), ["lat", "lon"]).select("ua_id", "stations")


DAY = f"""SELECT s.*, COALESCE(SUM(ROUND(mm*10000)::BIGINT), 0)::DOUBLE/10000e0 AS total_mm, COUNT(mm) AS hours FROM stations s
    LEFT JOIN (SELECT * FROM gauge_hourly WHERE {HOURS} BETWEEN 0 AND 23) USING (station_id) GROUP BY ALL"""
SUSPECT_SQL = f"""SELECT a.station_id, a.total_mm, COUNT(*) AS neighbors, ROUND(median(b.total_mm), 6) AS median_mm FROM dy a JOIN dy b
    ON a.station_id <> b.station_id AND b.hours >= 1 AND {hav('a', 'b')} <= 30 WHERE a.hours > 0 AND a.total_mm <= 0.5e0 GROUP BY ALL
    HAVING COUNT(*) >= 3 AND median(b.total_mm) >= 5"""


@query("AGG-07 JOIN-08", fx.sql_with("stations gauge_hourly", {"dy": DAY}, SUSPECT_SQL))
def suspect_stations(spark, sf):
    day = gauges.station_day(fx.stations(spark, sf), fx.gauge_hourly(spark, sf, 96), fx.target())
    return gauges.suspect_stations(day, 30.0, 1).withColumn("median_mm", F.round("median_mm", 6))


@query("AGG-31 SET-04", fx.sql_with("stations gauge_hourly units", {"dy": DAY, "su": SUSPECT_SQL, "nr": f"SELECT * FROM stations s SEMI JOIN units u ON {hav('u', 's')} <= 2",
       "kept": "SELECT * FROM stations s WHERE station_id NOT IN (SELECT station_id FROM su)", "sr": SERIES.replace("JOIN stations s", "JOIN kept s"), "cv": COVER}, f"""SELECT
    (SELECT COUNT(*) FROM nr) AS stations_near, (SELECT COUNT(*) FROM nr WHERE station_id IN (SELECT station_id FROM gauge_hourly WHERE hr = {T})) AS stations_last_hour,
    (SELECT COUNT(*) FROM su) AS stations_suspect, (SELECT COUNT(*) FROM units) AS points_total, n AS points_gauge, (SELECT COUNT(*) FROM units) - n AS points_fallback
    FROM (SELECT COUNT(*) AS n FROM cv WHERE covered_target AND covered_24 >= 20 AND covered_96 >= 77)"""))
def gauge_source_summary(spark, sf):
    u, st, gh = fx.units(spark, sf), fx.stations(spark, sf), fx.gauge_hourly(spark, sf, 96)
    suspects = gauges.suspect_stations(gauges.station_day(st, gh, fx.target()), 30.0, 1)
    kept = st.join(suspects, "station_id", "left_anti")
    cover = gauges.point_coverage(gauges.point_series(u, kept, gh, fx.target(), 30.0), fx.target())
    applied = gauges.apply_primary(cycle.satellite_windows(inputs(spark, sf), fx.target()), cover, 0.8)
    return gauges.gauge_summary(gauges.stations_near(st, u, 2.0), gh, suspects, applied, fx.target())


PRIMARY_SQL = f"""SELECT us.* REPLACE ({', '.join(f"COALESCE(g.{c}, us.{c}) AS {c}" for c in WINDOW_COLS)}), g.ua_id IS NOT NULL AS from_gauges
    FROM us LEFT JOIN (SELECT * FROM cv WHERE covered_target AND covered_24 >= 20 AND covered_96 >= 77) g USING (ua_id)"""
PRIMARY_CTES = {"sr": SERIES, "cv": COVER, "cw": CELL_WINDOWS, "us": UNIT_WINDOWS, "pw": PRIMARY_SQL}


@query("SCL-13", fx.sql_with("units stations gauge_hourly grid_hourly", PRIMARY_CTES, f"""SELECT ua_id, CASE WHEN from_gauges THEN 'GAUGES' ELSE 'SATELLITE' END AS source,
    {', '.join(WINDOW_COLS)} FROM pw"""))
def primary_gauge_windows(spark, sf):
    data = inputs(spark, sf)
    s = gauges.point_series(data.units, fx.stations(spark, sf), fx.gauge_hourly(spark, sf, 96), fx.target(), 30.0)
    out = gauges.apply_primary(cycle.satellite_windows(data, fx.target()), gauges.point_coverage(s, fx.target()), 0.8)
    return out.select("ua_id", "source", *WINDOW_COLS)


@query("SCL-41 SCL-18", """SELECT event_id, value*4e0 AS ac96h_mm, value/24e0 AS intensity_mmh, CASE WHEN event_id%5=0 THEN 'SATELLITE' WHEN event_id%5<4 THEN 'GAUGES + SATELLITE' ELSE 'GAUGES' END AS source FROM events""")
def daily_total_feed(spark, sf):
    from ..functions import rain as rf

    w = rf.alternative_windows(F.col("value"))
    return fx.table(spark, sf, "events").select("event_id", w["ac96h_mm"].alias("ac96h_mm"), w["intensity_mmh"].alias("intensity_mmh"),
                                                rf.source_label(F.col("event_id") % 5, F.lit(4)).alias("source"))
