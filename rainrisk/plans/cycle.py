"""Risk datasets: live cycle, replay at an instant, timeline, forecast and actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import HISTORY_MAX_DAYS, PRIMARY, READY_HOURS, SUSPECT
from ..functions import geo, rain
from ..operators import forecast as fc, gauges, risk, spatial
from ..operators.scale import attach, with_row
from ..operators.rain import hour_completeness, timeline_windows, trailing_windows, unit_windows

CELL = ["lat_idx", "lon_idx"]


@dataclass
class Inputs:
    """Tables of a cycle. ``units`` carries ``lat, lon, RAGEO, RAHID`` and its grid cell."""

    units: DataFrame
    grid: DataFrame
    regions: DataFrame
    stations: DataFrame | None = None
    gauge_hourly: DataFrame | None = None
    stations_24h: DataFrame | None = None
    forecast_grid: DataFrame | None = None
    gauge_radius_km: float = PRIMARY["radius_km"]
    gauge_coverage: float = PRIMARY["coverage"]
    suspect_radius_km: float = SUSPECT["radius_km"]
    suspect_min_hours: int = SUSPECT["min_hours"]


def satellite_windows(data: Inputs, target: Column) -> DataFrame:
    """Windows per unit from the nearest grid cell; windows are summed once per cell."""
    return unit_windows(data.units, trailing_windows(data.grid, CELL, target), CELL)


def ground_windows(data: Inputs, windows: DataFrame, gauge_target: Column) -> DataFrame:
    """Gauge windows where coverage allows, corrected satellite windows for the rest.

    Adds ``source`` and ``from_gauges`` and, with ``stations_24h``, ``correction`` and ``factor``. Suspect stations measure nobody.
    """
    out = windows.withColumns({"from_gauges": F.lit(False), "source": F.lit("SATELLITE")})
    if data.stations is not None:
        day = gauges.station_day(data.stations, data.gauge_hourly, gauge_target)
        suspects = gauges.suspect_stations(day, data.suspect_radius_km, data.suspect_min_hours)
        good = data.stations.join(suspects, "station_id", "left_anti")
        series = gauges.point_series(data.units, good, data.gauge_hourly, gauge_target, data.gauge_radius_km)
        out = gauges.apply_primary(windows, gauges.point_coverage(series, gauge_target), data.gauge_coverage)
    if data.stations_24h is not None:
        estimates = gauges.anchor_estimates(data.units, data.stations_24h, coverage="coverage_hours")
        out = gauges.correct_rain(out, estimates, skip=F.col("from_gauges")).drop("g24_mm", "d_min_km")
    return out


def composed(windows: DataFrame) -> DataFrame:
    """Observed plus forecast windows under the names the evaluation reads."""
    for c in ("prev24h_mm", "prev6h_mm"):
        if c not in windows.columns:
            windows = windows.withColumn(c, F.lit(None).cast("double"))
    parts = rain.compose_windows(*[F.col(c) for c in ("ac72h_mm", "ac18h_mm", "ac96h_mm", "ac24h_mm", "prev24h_mm", "prev6h_mm")])
    return windows.withColumns(parts).withColumnsRenamed({"ac72h_mm": "ac72h_obs_mm", "ac18h_mm": "ac18h_obs_mm"})


def risk_points(data: Inputs, target: Column, gauge_target: Column | None = None, use_forecast: bool = True) -> DataFrame:
    """One row per unit and channel with windows, classes and risk."""
    windows = satellite_windows(data, target)
    if data.stations is not None or data.stations_24h is not None:
        windows = ground_windows(data, windows, gauge_target if gauge_target is not None else target)
    if use_forecast and data.forecast_grid is not None:
        windows = fc.attach_forecast(windows, fc.accumulate(data.forecast_grid, target, CELL), CELL)
    placed = spatial.locate_region(composed(windows), data.regions)
    return risk.evaluate(risk.both_channels(placed), data.regions)


def risk_summary(points: DataFrame, grid: DataFrame, target: Column) -> DataFrame:
    """One row: totals per channel and level, worst unit, data status."""
    g = F.col("hazard") == "geo"
    level = lambda c, p: [F.count_if(c & (F.col("rd") == i)).alias(f"{p}_rd{i}") for i in range(5)]
    # level first, then the slope channel, then 96 h rain, then input order
    worst = F.min(F.struct((-F.col("rd")).alias("r"), "hazard", (-F.col("ac96h_mm")).alias("a"), "ua_id"))
    totals = points.agg(F.count(F.lit(1)).alias("total"), F.count_if(g).alias("total_geo"), F.count_if(~g).alias("total_hidro"),
                        *level(F.lit(True), "all"), *level(g, "geo"), *level(~g, "hidro"), worst.alias("_w"))
    totals = totals.select("*", F.col("_w.ua_id").alias("max_rd_point"), (-F.col("_w.r")).alias("max_rd"), F.col("_w.hazard").alias("max_rd_hazard")).drop("_w")
    hours = hour_completeness(grid, target).withColumn("data_status", rain.data_status(F.col("missing_24h")))
    return with_row(totals, hours)


def snapshot_at(data: Inputs, instant: Column, now: Column, max_days: int = HISTORY_MAX_DAYS) -> DataFrame:
    """Observed-only replay; rows turn to no-data when the instant is in the future, too old or short of hours.

    The guard is one row, added as a scalar.
    """
    target = F.date_trunc("hour", instant)
    points = risk_points(Inputs(data.units, data.grid, data.regions), target, use_forecast=False)
    age_ok = (instant <= now) & (instant >= now - F.make_interval(days=F.lit(max_days)))
    guard = hour_completeness(data.grid, target).select(
        (age_ok & (F.col("files_ok") >= READY_HOURS)).alias("_ok"))
    out = with_row(points, guard)
    blank = {c: F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(0)) for c in ("icc_geo", "icc_hid", "rd_geo", "rd_hid", "rd")}
    blank |= {c: F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(0.0)) for c in ("ac96h_mm", "ac24h_mm", "intensity_mmh")}
    blank |= {"cpc": F.when(F.col("_ok"), F.col("cpc")), "nivel": F.when(F.col("_ok"), F.col("nivel")).otherwise(F.lit("Sem dado")),
              "source": F.when(F.col("_ok"), F.lit("SATELLITE")).otherwise(F.lit("NO_DATA")), "historical": F.lit(True)}
    return out.withColumns(blank).drop("_ok")


def timeline(data: Inputs, target: Column, frames: int = 96) -> DataFrame:
    """Risk per unit, channel and hour.

    Windows run per grid cell; the risk of a cell and hour is computed per
    (region, class) before units pick theirs up.
    """
    placed = spatial.locate_region(data.units, data.regions)
    windows = timeline_windows(data.grid, CELL, target, frames)
    kinds = risk.both_channels(placed.select(*CELL, "regiao_id", "RAGEO", "RAHID").distinct())
    kinds = kinds.select(*CELL, "regiao_id", "hazard", "ra_geo", "ra_hid").distinct()
    first = target - F.make_interval(hours=F.lit(frames - 1))
    spine = kinds.withColumn("hr", F.explode(F.sequence(first, target, F.expr("INTERVAL 1 HOUR"))))
    frames_of = spine.join(windows, [*CELL, "hr"], "left").fillna(
        0.0, ["intensity_mmh", "ac24h_mm", "ac96h_mm"])
    rated = risk.evaluate(frames_of, data.regions).select(
        *CELL, F.coalesce("regiao_id", F.lit(-1)).alias("_reg"), "hazard",
        F.coalesce("ra_geo", "ra_hid", F.lit(-1)).alias("_ra"), "hr", "rd")
    channels = risk.both_channels(placed).select(
        "ua_id", "hazard", *CELL, F.coalesce("regiao_id", F.lit(-1)).alias("_reg"), F.coalesce("ra_geo", "ra_hid", F.lit(-1)).alias("_ra"))
    return attach(channels, rated, [*CELL, "_reg", "hazard", "_ra"], "inner", ["ua_id"]).select("ua_id", "hazard", "hr", "rd")


def layers_at(lat: float, lon: float, points: DataFrame, regions: DataFrame, fire: DataFrame | None = None, tolerance_km: float = 1.0,
              roads: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """Everything near one location: its region and administrative area, and units, fire segments and roads within the tolerance.

    ``roads`` carries ``road_id`` and the ends of its segments, ``areas`` ``area_id`` and ``polygon``; the area is the first that holds the location.
    The location is one constant point, so every layer is a filter of its table: nothing is copied to grid cells or broadcast.
    """
    here = (F.lit(float(lat)), F.lit(float(lon)))

    def holding(df: DataFrame, layer: str, key: str) -> DataFrame:
        first = df.where(geo.ring_contains(F.col("polygon"), *here)).agg(F.min(key).alias("_id")).where("_id IS NOT NULL")
        return first.select(F.lit(layer).alias("layer"), F.col("_id").cast("string").alias("id"), F.lit(0.0).alias("distance_km"))

    def near(df: DataFrame, layer: str, key: str, distance: Column) -> DataFrame:
        return df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("id"), distance.alias("distance_km")).where(F.col("distance_km") <= tolerance_km)

    from_point = geo.haversine_km(F.col("lat"), F.col("lon"), *here)
    out = holding(regions, "region", "regiao_id").unionByName(near(points, "unit", "ua_id", from_point))
    if fire is not None:
        out = out.unionByName(near(fire, "fire", "trecho_id", from_point).distinct())
    if roads is not None:
        from_line = geo.segment_distance_km(*here, (F.col("lat1"), F.col("lon1")), (F.col("lat2"), F.col("lon2")))
        out = out.unionByName(near(roads, "road", "road_id", from_line).groupBy("layer", "id").agg(F.min("distance_km").alias("distance_km")))
    if areas is not None:
        out = out.unionByName(holding(areas, "area", "area_id"))
    return out
