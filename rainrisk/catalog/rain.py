from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rain as rf
from ..operators import forecast as fc, rain
from ..plans import cycle
from . import query

T = f"TIMESTAMP '{fx.TARGET}'"
TXT = "yyyy-MM-dd HH:mm:ss"
HOURS = f"date_diff('hour', hr, {T})"
TICKS = "ROUND(mm*10000)::BIGINT"


def R(ticks: str, digits: int = 2) -> str:
    """SQL twin of the tick rounding."""
    unit = 10 ** (4 - digits)
    return f"((({ticks})::BIGINT + {unit // 2}) // {unit})::DOUBLE/{10 ** digits}e0"


def windows(keys: str, table: str, null_zero: bool = True) -> str:
    sums = ", ".join(f"COALESCE(SUM(CASE WHEN {HOURS} < {n} THEN {TICKS} END), 0)" + f" AS t{n}" for n in (18, 24, 72, 96))
    inner = (f"SELECT {keys}, COALESCE(SUM(CASE WHEN {HOURS} = 0 THEN {TICKS} END), 0) AS t0, {sums} FROM {table} "
             f"WHERE {HOURS} BETWEEN 0 AND 95 GROUP BY {keys}")
    return f"SELECT {keys}, {R('t0')} AS intensity_mmh, " + ", ".join(f"{R(f't{n}')} AS ac{n}h_mm" for n in (18, 24, 72, 96)) + f" FROM ({inner})"


CELL_WINDOWS = windows("lat_idx, lon_idx", "grid_hourly")
UNIT_WINDOWS = """SELECT u.*, COALESCE(w.intensity_mmh, 0e0) AS intensity_mmh, COALESCE(w.ac18h_mm, 0e0) AS ac18h_mm, COALESCE(w.ac24h_mm, 0e0) AS ac24h_mm,
    COALESCE(w.ac72h_mm, 0e0) AS ac72h_mm, COALESCE(w.ac96h_mm, 0e0) AS ac96h_mm FROM units u LEFT JOIN cw w USING (lat_idx, lon_idx)"""
WINDOW_COLS = ["intensity_mmh", "ac18h_mm", "ac24h_mm", "ac72h_mm", "ac96h_mm"]


def inputs(spark, sf, **more):
    from ..operators.risk import default_regions

    return cycle.Inputs(fx.units(spark, sf), fx.grid_hourly(spark, sf, 96), default_regions(spark), **more)


@query("SRC-01 AGG-01 SCL-17", fx.sql_with("grid_hourly", {}, CELL_WINDOWS))
def cell_rain_windows(spark, sf):
    return rain.trailing_windows(fx.grid_hourly(spark, sf, 96), ["lat_idx", "lon_idx"], fx.target())


@query("JOIN-04 JOIN-09", fx.sql_with("grid_hourly units", {"cw": CELL_WINDOWS, "uw": UNIT_WINDOWS}, "SELECT ua_id, " + ", ".join(WINDOW_COLS) + " FROM uw"))
def unit_rain_windows(spark, sf):
    return cycle.satellite_windows(inputs(spark, sf), fx.target()).select("ua_id", *WINDOW_COLS)


@query("AGG-02 SCL-18", fx.sql_with("grid_hourly", {}, f"""SELECT files_ok, missing_24h, missing_96h, CASE WHEN missing_24h < 6 THEN 'ok' ELSE 'degraded' END AS data_status FROM (
    SELECT COUNT(*)::INT AS files_ok, (24 - COUNT(*) FILTER (h < 24))::INT AS missing_24h, (96 - COUNT(*))::INT AS missing_96h
    FROM (SELECT DISTINCT {HOURS} AS h FROM grid_hourly WHERE {HOURS} BETWEEN 0 AND 95))"""))
def hour_completeness(spark, sf):
    out = rain.hour_completeness(fx.grid_hourly(spark, sf, 96), fx.target())
    return out.withColumn("data_status", rf.data_status(F.col("missing_24h")))


@query("A-14 SRC-01", fx.sql_with("grid_hourly", {}, "SELECT strftime(hr, '%Y-%m-%d %H:%M:%S') AS hr, COUNT(*) AS n_cells, COUNT(*) = 12 AS ok FROM grid_hourly GROUP BY hr"))
def mesh_complete_hours(spark, sf):
    return rain.mesh_complete_hours(fx.grid_hourly(spark, sf), 12).withColumn("hr", F.date_format("hr", TXT))


TIMELINE = f"""SELECT lat_idx, lon_idx, hr, {R('t')} AS intensity_mmh, {R('s24')} AS ac24h_mm, {R('s96')} AS ac96h_mm FROM (
    SELECT lat_idx, lon_idx, hr, t, SUM(t) OVER (w ROWS 23 PRECEDING) AS s24, SUM(t) OVER (w ROWS 95 PRECEDING) AS s96 FROM (
      SELECT c.lat_idx, c.lon_idx, s.hr, COALESCE(SUM({TICKS}), 0) AS t FROM (
        SELECT DISTINCT lat_idx, lon_idx FROM grid_hourly WHERE {HOURS} BETWEEN 0 AND 95) c
      CROSS JOIN (SELECT {T} - to_hours(i::INT) AS hr FROM range(96) r(i)) s
      LEFT JOIN grid_hourly g ON g.lat_idx = c.lat_idx AND g.lon_idx = c.lon_idx AND g.hr = s.hr GROUP BY ALL)
    WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY hr))"""


@query("WIN-01", fx.sql_with("grid_hourly", {"tl": TIMELINE}, "SELECT lat_idx, lon_idx, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hr, intensity_mmh, ac24h_mm, ac96h_mm FROM tl"))
def timeline_windows(spark, sf):
    out = rain.timeline_windows(fx.grid_hourly(spark, sf, 96), ["lat_idx", "lon_idx"], fx.target())
    return out.withColumn("hr", F.date_format("hr", TXT))


@query("STR-05", fx.sql_with("", {}, """SELECT user_id AS station_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hr,
    SUM(ROUND(value*10000)::BIGINT)::DOUBLE/10000e0 AS mm, COUNT(*) AS qtd FROM events GROUP BY ALL"""))
def station_hour_totals(spark, sf):
    out = rain.hourly_totals(fx.table(spark, sf, "events").withColumnRenamed("user_id", "station_id"), ["station_id"])
    return out.withColumn("hr", F.date_format("hr", TXT))


@query("STR-06", fx.sql_with("gauge_hourly", {}, f"""SELECT station_id, strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end, {R('SUM(' + TICKS + ')')} AS total_mm
    FROM (SELECT station_id, mm, hr + to_hours(i::INT) AS e FROM gauge_hourly, range(1, 25) r(i)) GROUP BY station_id, e"""))
def sliding_day_totals(spark, sf):
    out = rain.sliding_accumulations(fx.gauge_hourly(spark, sf), ["station_id"], 24)
    return out.withColumn("window_end", F.date_format("window_end", TXT))


CHOSEN = f"""SELECT MAX(run) AS run FROM (SELECT run FROM forecast_grid WHERE run <= {T} AND date_diff('hour', run, {T}) <= 156
    AND date_diff('hour', run, time_bucket(INTERVAL 6 HOURS, {T}, TIMESTAMP '2024-01-01 00:00:00')) <= 72 GROUP BY run
    HAVING bool_or(valid = {T}) AND bool_or(valid = {T} + INTERVAL 6 HOURS) AND bool_or(valid = {T} + INTERVAL 24 HOURS))"""
ACCUM = f"""SELECT run, lat_idx, lon_idx, ROUND(GREATEST(0e0, m6 - m0)*100 + 1e-7)::BIGINT::DOUBLE/100e0 AS ac6h_prev, ROUND(GREATEST(0e0, m24 - m0)*100 + 1e-7)::BIGINT::DOUBLE/100e0 AS ac24h_prev FROM (
    SELECT run, lat_idx, lon_idx, MAX(CASE WHEN valid = {T} THEN acc_mm END) AS m0, MAX(CASE WHEN valid = {T} + INTERVAL 6 HOURS THEN acc_mm END) AS m6,
    MAX(CASE WHEN valid = {T} + INTERVAL 24 HOURS THEN acc_mm END) AS m24 FROM forecast_grid JOIN (SELECT * FROM chosen) USING (run) GROUP BY ALL)"""


@query("JOIN-11 SRC-06", fx.sql_with("forecast_grid", {"chosen": CHOSEN}, "SELECT strftime(run, '%Y-%m-%d %H:%M:%S') AS run FROM chosen WHERE run IS NOT NULL"))
def forecast_run(spark, sf):
    return fc.choose_run(fx.forecast_grid(spark, sf), fx.target()).select(F.date_format("run", TXT).alias("run"))


@query("SCL-14", fx.sql_with("forecast_grid", {"chosen": CHOSEN, "fa": ACCUM}, "SELECT strftime(run, '%Y-%m-%d %H:%M:%S') AS run, lat_idx, lon_idx, ac6h_prev, ac24h_prev FROM fa"))
def forecast_accumulation(spark, sf):
    out = fc.accumulate(fx.forecast_grid(spark, sf), fx.target(), ["lat_idx", "lon_idx"])
    return out.withColumn("run", F.date_format("run", TXT))


@query("JOIN-10 JOIN-29 CMP-04", fx.sql_with("forecast_grid units", {"chosen": CHOSEN, "fa": ACCUM}, """SELECT ua_id, ac6h_prev AS prev6h_mm, ac24h_prev AS prev24h_mm,
    ROUND(ac24h_prev/24e0, 1) AS intensity_prev_mmh FROM units LEFT JOIN fa USING (lat_idx, lon_idx)"""))
def unit_forecast(spark, sf):
    grid = fc.accumulate(fx.forecast_grid(spark, sf), fx.target(), ["lat_idx", "lon_idx"])
    return fc.forecast_view(fc.attach_forecast(fx.units(spark, sf), grid, ["lat_idx", "lon_idx"])).select(
        "ua_id", "prev6h_mm", "prev24h_mm", "intensity_prev_mmh")


COMPOSED = f"""SELECT uw.*, ac6h_prev AS prev6h_mm, ac24h_prev AS prev24h_mm,
    CASE WHEN ac24h_prev IS NULL THEN ac96h_mm ELSE ROUND((ac72h_mm + ac24h_prev)*100)::BIGINT::DOUBLE/100e0 END AS use96,
    CASE WHEN ac24h_prev IS NULL THEN ac24h_mm ELSE ROUND((ac18h_mm + ac6h_prev)*100)::BIGINT::DOUBLE/100e0 END AS use24,
    CASE WHEN ac24h_prev IS NULL THEN 'OBS_ONLY' ELSE 'WRF' END AS fonte_chuva FROM uw LEFT JOIN fa USING (lat_idx, lon_idx)"""
COMPOSED_CTES = {"cw": CELL_WINDOWS, "uw": UNIT_WINDOWS, "chosen": CHOSEN, "fa": ACCUM, "cp": COMPOSED}


@query("SCL-05", fx.sql_with("grid_hourly units forecast_grid", COMPOSED_CTES, "SELECT ua_id, use96 AS ac96h_mm, use24 AS ac24h_mm, fonte_chuva FROM cp"))
def composed_windows(spark, sf):
    data = inputs(spark, sf, forecast_grid=fx.forecast_grid(spark, sf))
    w = fc.attach_forecast(cycle.satellite_windows(data, fx.target()), fc.accumulate(data.forecast_grid, fx.target(), cycle.CELL), cycle.CELL)
    return cycle.composed(w).select("ua_id", "ac96h_mm", "ac24h_mm", "fonte_chuva")


@query("SCL-15 SCL-16", """SELECT event_id, strftime(date_trunc('hour', ts - INTERVAL 3 HOURS), '%Y-%m-%d %H:%M:%S') AS satellite_hour,
    strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS gauge_hour,
    CASE WHEN event_id%360-180 < 0 THEN (event_id%360-180)::DOUBLE + 360e0 ELSE (event_id%360-180)::DOUBLE END AS lon_360 FROM events""")
def target_hours(spark, sf):
    from ..functions.geo import lon_0_360

    e = fx.table(spark, sf, "events")
    return e.select("event_id", F.date_format(rf.satellite_target_hour(F.col("ts")), TXT).alias("satellite_hour"),
                    F.date_format(rf.gauge_target_hour(F.col("ts")), TXT).alias("gauge_hour"),
                    lon_0_360((F.col("event_id") % 360 - 180).cast("double")).alias("lon_360"))


@query("STR-02", f"""SELECT event_id, CASE WHEN event_id%7=0 THEN TRUE WHEN age < 4 THEN TRUE WHEN age >= 24 THEN FALSE
    ELSE event_id%3=0 OR age*3600 - 3600 > 86400 END AS fetch FROM (SELECT event_id, date_diff('second', ts, {T})/3600e0 AS age FROM events)""")
def refetch_plan(spark, sf):
    e = fx.table(spark, sf, "events")
    i = F.col("event_id")
    checked = F.when(i % 3 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return e.select(i, rf.needs_refetch(F.col("ts"), fx.target(), checked, i % 7 != 0).alias("fetch"))
