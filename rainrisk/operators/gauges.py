"""Ground gauges: interpolation, coverage, suspects and the correction of satellite rain.

All distance work runs over distinct positions of units and stations; readings of
stations that share a position are added up before they meet a unit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CORRECTION, DRY_GUARD, PRIMARY, SUSPECT
from ..functions import geo, rain
from .rain import window_hours
from .scale import OrderedBlocks, attach, quantiles_of_ranked, with_row
from .spatial import pairs_within, positions


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key (by ``order``), merged map-side."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def station_places(stations: DataFrame, value: str, ordinal: str, coverage: str | None = None) -> DataFrame:
    """Collapse stations of one position: count, sum, first value by ordinal, dry and covered counts."""
    v = F.col(value)
    covered = F.col(coverage) >= DRY_GUARD["min_coverage_h"] if coverage else F.lit(False)
    covered = F.coalesce(covered, F.lit(False))
    return stations.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rain.ticks(v)).alias("_sum"),
        F.min(F.struct(F.col(ordinal).alias("o"), v.alias("v"))).alias("first"),
        F.count_if(covered).alias("n_covered"),
        F.count_if(covered & (v <= DRY_GUARD["max_gauge_mm"])).alias("n_dry"))


def anchor_estimates(units: DataFrame, stations: DataFrame, value: str = "value_mm", ordinal: str = "station_id",
                     coverage: str | None = None, radius_km: float = CORRECTION["radius_km"],
                     snap_km: float = CORRECTION["snap_km"]) -> DataFrame:
    """Inverse-distance-squared mean of the stations in the radius, per unit position.

    A station closer than ``snap_km`` replaces the mean; of several, the first in
    input order. ``d_min_km`` is then the distance of that station. Also counts the
    covered and dry stations for the dry-ground guard.
    """
    pairs = pairs_within(positions(units), station_places(stations, value, ordinal, coverage), radius_km)
    d, snap = F.col("distance_km"), F.col("distance_km") < snap_km
    w = F.when(~snap, F.lit(1.0) / (d * d))
    total = F.col("_sum") / F.lit(float(rain.TICKS_PER_MM))
    agg = pairs.groupBy("lat", "lon").agg(
        F.sum(w * total).alias("_num"), F.sum(w * F.col("n")).alias("_den"),
        F.min(F.when(snap, F.struct(F.col("first.o").alias("o"), F.col("first.v").alias("v"), d.alias("d")))).alias("_snap"),
        F.min(d).alias("_d"),
        F.sum("n_covered").alias("n_covered"), F.sum("n_dry").alias("n_dry"),
        F.min(F.when(F.col("n_covered") > 0, d)).alias("d_covered"))
    return agg.select("lat", "lon", F.coalesce(F.col("_snap.v"), F.col("_num") / F.col("_den")).alias("g24_mm"),
                      F.coalesce(F.col("_snap.d"), F.col("_d")).alias("d_min_km"), "n_covered", "n_dry", "d_covered")


def network_mean(units: DataFrame, stations: DataFrame, value: str = "value_mm", ordinal: str = "station_id", snap_km: float = 0.1, block: int = 128,
                 tile: int = 1024) -> DataFrame:
    """Inverse-distance-squared mean over all stations, per unit position; a station closer than ``snap_km`` replaces it, 0.0 without a station.

    Station positions travel in blocks of about ``block``, unit positions in tiles of about ``tile``, and each tile meets each block under a key of
    its own: the work is units times stations by definition, spread evenly over tiles times blocks. A unit adds up inside its row, so no list of pairs exists.
    """
    places = station_places(stations, value, ordinal)
    tiles = lambda df, size: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("long").alias("n")).scalar()
    count = tiles(places, block)
    blocks = (places.withColumn("_b", F.pmod(F.xxhash64("s_lat", "s_lon"), count)).groupBy("_b")
              .agg(F.sort_array(F.collect_list(F.struct("s_lat", "s_lon", "n", (F.col("_sum") / F.lit(float(rain.TICKS_PER_MM))).alias("total"), "first"))).alias("places")))
    spots = positions(units)
    spread = tiles(spots, tile)
    blocks = blocks.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
    met = (spots.withColumn("_u", F.pmod(F.xxhash64("lat", "lon"), spread))
           .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).join(blocks, ["_u", "_b"]))
    each = F.transform("places", lambda p: F.struct(geo.haversine_km(F.col("lat"), F.col("lon"), p["s_lat"], p["s_lon"]).alias("d"), p["n"].alias("n"),
                                                    p["total"].alias("total"), p["first"]["o"].alias("o"), p["first"]["v"].alias("v")))
    far = F.filter(each, lambda p: p["d"] >= snap_km)
    add = lambda name: F.aggregate(far, F.lit(0.0), lambda a, p: a + p[name] / (p["d"] * p["d"]))
    near = F.array_min(F.transform(F.filter(each, lambda p: p["d"] < snap_km), lambda p: F.struct(p["o"].alias("o"), p["v"].alias("v"))))
    sums = met.select("lat", "lon", add("total").alias("num"), add("n").alias("den"), near.alias("near")).groupBy("lat", "lon").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.min("near").alias("near"))
    mean = F.coalesce("near.v", F.try_divide("num", "den"), F.lit(0.0))
    return spots.join(sums, ["lat", "lon"], "left").select("lat", "lon", mean.alias("g24_mm"))


def dry_consensus(g24: Column, n_covered: Column, n_dry: Column, d_covered: Column) -> Column:
    """Ground is dry beyond doubt: enough covered stations, one near, nearly all of them dry."""
    g = DRY_GUARD
    return ((g24 <= g["max_gauge_mm"]) & (n_covered >= g["min_stations"]) & (d_covered <= g["max_nearest_km"])
            & (F.try_divide(n_dry, n_covered) >= g["min_fraction"]))


def correct_rain(windows: DataFrame, estimates: DataFrame, skip: Column | None = None) -> DataFrame:
    """Anchor satellite windows to the ground estimate of their position; rows of ``skip`` keep their windows.

    Adds ``correction`` (none, override, scale, add) and ``factor``. Both dry: nothing.
    Extreme satellite against dry ground: the last 24 h become the ground value.
    Otherwise scale by the clamped blend, or add the blend when the satellite is dry.
    """
    c = CORRECTION
    joined = attach(windows, estimates, ["lat", "lon"])
    g, s = F.col("g24_mm"), F.col("ac24h_mm")
    weight = rain.anchor_weight(F.col("d_min_km"))
    blend = weight * g + (F.lit(1.0) - weight) * s
    usable = g.isNotNull() & (F.coalesce(F.col("d_min_km"), F.lit(1e9)) <= c["radius_km"]) & (weight > 0)
    if skip is not None:
        usable &= ~F.coalesce(skip, F.lit(False))
    both_dry = (s <= c["dry_mm"]) & (g <= c["dry_mm"])
    override = (s >= DRY_GUARD["min_sat_mm"]) & dry_consensus(g, F.col("n_covered"), F.col("n_dry"), F.col("d_covered"))
    branch = (F.when(~F.coalesce(usable, F.lit(False)) | both_dry, F.lit("none"))
              .when(F.coalesce(override, F.lit(False)), F.lit("override"))
              .when(s > c["dry_mm"], F.lit("scale")).otherwise(F.lit("add")))
    factor = (F.when(F.col("correction") == "override", F.greatest(F.lit(0.0), F.least(F.lit(1.0), g / s)))
              .when(F.col("correction") == "scale",
                    F.greatest(F.lit(c["factor_min"]), F.least(F.lit(c["factor_max"]), blend / s))))
    out = joined.withColumn("correction", branch).withColumns({"factor": factor, "_blend": blend})
    how, f, b = F.col("correction"), F.col("factor"), F.col("_blend")

    def pick(name: str, override_value: Column, add_value: Column) -> Column:
        x = F.col(name)
        # the inner rounding takes the noise of binary sums away, so a half always goes up
        cents = lambda v: F.round(F.round(v, 6), 2)
        return (F.when(how == "override", cents(override_value)).when(how == "scale", cents(x * f))
                .when(how == "add", cents(add_value)).otherwise(x))

    longer = lambda x: F.greatest(F.lit(0.0), x - s) + g
    moved = {
        "intensity_mmh": pick("intensity_mmh", F.col("intensity_mmh") * f, F.col("intensity_mmh")),
        "ac18h_mm": pick("ac18h_mm", F.col("ac18h_mm") * f, F.col("ac18h_mm") + b * F.lit(0.8)),
        "ac24h_mm": pick("ac24h_mm", g, s + b),
        "ac72h_mm": pick("ac72h_mm", longer(F.col("ac72h_mm")), F.col("ac72h_mm") + b),
        "ac96h_mm": pick("ac96h_mm", longer(F.col("ac96h_mm")), F.col("ac96h_mm") + b),
    }
    out = out.withColumns(moved)
    ordered = rain.monotonic(*[F.col(n) for n in ("ac18h_mm", "ac24h_mm", "ac72h_mm", "ac96h_mm")])
    ordered = {n: F.when(how == "none", F.col(n)).otherwise(v) for n, v in ordered.items()}
    return out.withColumns(ordered).drop("_blend", "n_covered", "n_dry", "d_covered")


def correction_summary(corrected: DataFrame) -> DataFrame:
    """One row: corrected units, overrides, mean factor, strongest scale down and up."""
    f = F.col("factor")
    return corrected.agg(
        F.count_if(F.col("correction") != "none").alias("points_corrected"),
        F.count_if(F.col("correction") == "override").alias("points_ground_override"),
        F.round(F.sum(F.round(f * 1e9).cast("long")) / F.count(f) / F.lit(1e9), 3).alias("mean_factor"),
        F.round(F.min(F.when(f < 1, f)), 3).alias("max_downscale"),
        F.round(F.max(F.when(f > 1, f)), 3).alias("max_upscale"))


def stations_near(stations: DataFrame, units: DataFrame, radius_km: float = PRIMARY["radius_km"]) -> DataFrame:
    """Stations with at least one unit inside the radius (semi join by position)."""
    spots = positions(stations).withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
    near = pairs_within(positions(units), spots, radius_km).select(
        F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon")).distinct()
    return stations.join(near, ["lat", "lon"], "left_semi")


def point_series(units: DataFrame, stations: DataFrame, hourly: DataFrame, target: Column,
                 radius_km: float = PRIMARY["radius_km"], min_km: float = PRIMARY["min_distance_km"]) -> DataFrame:
    """Hourly inverse-distance-squared mean per unit position, over the stations that reported that hour.

    Only covered hours appear: an hour nobody measured is absent, never zero.
    """
    # at most one entry per hour and place, so a place carries at most 96 entries to its neighbours
    located = window_hours(hourly, target).join(stations.select("station_id", "lat", "lon"), "station_id")
    place_hours = located.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "hr").agg(
        F.sum(rain.ticks(F.col("mm"))).alias("_sum"), F.count(F.lit(1)).alias("n"))
    places = place_hours.groupBy("s_lat", "s_lon").agg(F.collect_list(F.struct("hr", "_sum", "n")).alias("_hours"))
    d = F.greatest(F.col("distance_km"), F.lit(min_km))
    pairs = pairs_within(positions(units), places, radius_km).withColumn("w", F.lit(1.0) / (d * d))
    return (pairs.select("lat", "lon", "w", F.inline("_hours"))
            .groupBy("lat", "lon", "hr").agg(
                (F.sum(F.col("w") * F.col("_sum")) / F.sum(F.col("w") * F.col("n")) / F.lit(float(rain.TICKS_PER_MM))).alias("mm")))


def point_coverage(series: DataFrame, target: Column) -> DataFrame:
    """Windows and covered hours per unit position from ``point_series``."""
    h = rain.hours_before(target, F.col("hr"))
    t = rain.ticks(F.col("mm"))
    sums = {"intensity_mmh": F.sum(F.when(h == 0, t))} | {f"ac{n}h_mm": F.sum(F.when(h < n, t)) for n in (18, 24, 72, 96)}
    agg = series.groupBy("lat", "lon").agg(
        *[c.alias(k) for k, c in sums.items()],
        F.count_if(h < 24).cast("int").alias("covered_24"), F.count(F.lit(1)).cast("int").alias("covered_96"),
        (F.count_if(h == 0) > 0).alias("covered_target"))
    return agg.select("lat", "lon", *[rain.mm_from_ticks(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums],
                      "covered_24", "covered_96", "covered_target")


def station_counts(units: DataFrame, stations: DataFrame, radius_km: float = PRIMARY["radius_km"]) -> DataFrame:
    """Stations in the radius per unit position."""
    places = stations.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(F.count(F.lit(1)).alias("n"))
    return pairs_within(positions(units), places, radius_km).groupBy("lat", "lon").agg(F.sum("n").alias("stations"))


def qualifies(coverage: float = PRIMARY["coverage"]) -> Column:
    return (F.col("covered_target") & (F.col("covered_24") >= math.ceil(coverage * 24))
            & (F.col("covered_96") >= math.ceil(coverage * 96)))


def apply_primary(windows: DataFrame, coverage: DataFrame, min_coverage: float = PRIMARY["coverage"],
                  label: str = "GAUGES") -> DataFrame:
    """Replace the windows of units whose position qualifies; adds ``source`` and ``from_gauges``."""
    names = ["intensity_mmh", "ac18h_mm", "ac24h_mm", "ac72h_mm", "ac96h_mm"]
    good = coverage.where(qualifies(min_coverage)).select("lat", "lon", *[F.col(n).alias(f"_g_{n}") for n in names])
    out = attach(windows, good, ["lat", "lon"])
    used = F.col("_g_ac24h_mm").isNotNull()
    return out.withColumns({n: F.coalesce(F.col(f"_g_{n}"), F.col(n)) for n in names} | {
        "from_gauges": used, "source": F.when(used, F.lit(label)).otherwise(F.lit("SATELLITE"))}).drop(*[f"_g_{n}" for n in names])


def station_day(stations: DataFrame, hourly: DataFrame, target: Column) -> DataFrame:
    """24 h total and number of reported hours per station, zero when it never reported."""
    day = window_hours(hourly, target, 24).groupBy("station_id").agg(
        F.sum(rain.ticks(F.col("mm"))).alias("_t"), F.count(F.lit(1)).alias("hours"))
    return stations.join(day, "station_id", "left").select(
        "station_id", "lat", "lon", (F.coalesce("_t", F.lit(0)) / F.lit(float(rain.TICKS_PER_MM))).alias("total_mm"),
        F.coalesce("hours", F.lit(0)).alias("hours"))


def suspect_stations(day: DataFrame, radius_km: float = SUSPECT["radius_km"], min_hours: int = SUSPECT["min_hours"]) -> DataFrame:
    """Dry stations whose neighbours are wet: exact median of the other stations' totals.

    Works on counts per (position, total), so a crowd of identical neighbours is one
    row; the station itself is taken out of its own neighbourhood by its count.
    """
    s = SUSPECT
    dry = day.where((F.col("hours") > 0) & (F.col("total_mm") <= s["dry_mm"])).withColumn(
        "counts", F.col("hours") >= min_hours)
    kinds = dry.select("lat", "lon", "total_mm", "counts").distinct().withColumnRenamed("total_mm", "own_mm")
    crowd = day.where(F.col("hours") >= min_hours).groupBy(
        F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "total_mm").agg(F.count(F.lit(1)).alias("n"))
    itself = (F.col("counts") & (F.col("lat") == F.col("s_lat")) & (F.col("lon") == F.col("s_lon"))
              & (F.col("own_mm") == F.col("total_mm")))
    near = (pairs_within(kinds, crowd, radius_km)
            .withColumn("n", F.col("n") - F.when(itself, F.lit(1)).otherwise(F.lit(0))).where("n > 0"))
    keys = ["lat", "lon", "own_mm", "counts"]
    merged = near.groupBy(*keys, "total_mm").agg(F.sum("n").alias("_n"))
    ranked = OrderedBlocks.of(merged, keys, ["total_mm"]).cumulative({
        "_upto": ("sum", F.col("_n"), True), "_all": ("total", F.col("_n"), True)})
    medians = quantiles_of_ranked(ranked, keys, "total_mm", {"median_mm": 0.5})
    wet = medians.where((F.col("n_values") >= s["min_neighbors"]) & (F.col("median_mm") >= s["wet_mm"]))
    return (dry.withColumnRenamed("total_mm", "own_mm").join(wet, keys)
            .select("station_id", F.col("own_mm").alias("total_mm"), F.col("n_values").alias("neighbors"), "median_mm"))


def gauge_summary(near: DataFrame, hourly: DataFrame, suspects: DataFrame, applied: DataFrame, target: Column) -> DataFrame:
    """One row: stations near, reporting in the target hour, suspect; units from gauges and fallback."""
    reporting = hourly.where(F.col("hr") == target).join(near, "station_id", "left_semi").agg(
        F.count_distinct("station_id").alias("stations_last_hour"))
    parts = [near.agg(F.count(F.lit(1)).alias("stations_near")), reporting,
             suspects.agg(F.count(F.lit(1)).alias("stations_suspect")),
             applied.agg(F.count(F.lit(1)).alias("points_total"), F.count_if("from_gauges").alias("points_gauge"))]
    out = parts[0]
    for p in parts[1:]:
        out = with_row(out, p)
    return out.withColumn("points_fallback", F.col("points_total") - F.col("points_gauge"))
