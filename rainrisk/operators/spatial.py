"""Distance, containment and kilometre-range joins that give Spark an equi-key.

Copies collapse first: the joins run over distinct positions or distinct ranges,
and results come back to the rows by key. Hot cells are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AXIS_CUTOFF_KM, EARTH_RADIUS_KM
from ..functions import geo
from .scale import OrderedBlocks, attach


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(size)).cast("long"), F.floor(hi / F.lit(size)).cast("long"))


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float,
                 left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("s_lat", "s_lon"),
                 salts: int = 4, on: list[str] | None = None) -> DataFrame:
    """Pairs at most ``radius_km`` apart, with ``distance_km``; ``on`` names shared equality columns.

    Every right row is copied to the grid cells its radius touches, every left row
    sits in one cell, so each pair meets exactly once. Both sides should be distinct
    positions. A crowded cell is split over ``salts`` tasks.
    """
    degrees = radius_km / geo.KM_PER_DEGREE * 1.0001
    size = max(degrees, 0.01)
    lat, lon = F.col(left_at[0]), F.col(left_at[1])
    r_lat, r_lon = F.col(right_at[0]), F.col(right_at[1])
    shrink = F.greatest(F.cos(F.radians(F.least(F.abs(r_lat) + F.lit(degrees), F.lit(89.9)))), F.lit(0.01))
    r_dlon = F.lit(degrees) / shrink
    tagged = left.withColumns({
        "_cy": F.floor(lat / F.lit(size)).cast("long"), "_cx": F.floor(lon / F.lit(size)).cast("long"),
        "_salt": F.pmod(F.xxhash64(lat, lon), F.lit(salts)).cast("int"), **_unit_vector(lat, lon, "_l")})
    keys = [*(on or []), "_cy", "_cx", "_salt"]
    tagged = spread_out(tagged, *keys)
    spread = (right.withColumns(_unit_vector(r_lat, r_lon, "_r"))
              .withColumn("_cy", F.explode(_cells(r_lat - F.lit(degrees), r_lat + F.lit(degrees), size)))
              .withColumn("_cx", F.explode(_cells(r_lon - r_dlon, r_lon + r_dlon, size)))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    spread = spread_out(spread, *keys)
    # candidates are cut by their chord (no trigonometry per pair), survivors by the distance itself
    chord2 = sum(((F.col(f"_l{a}") - F.col(f"_r{a}")) * (F.col(f"_l{a}") - F.col(f"_r{a}")) for a in "xyz"), F.lit(0.0))
    limit = (2 * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2))) ** 2 * (1 + 1e-6) + 1e-18
    return (tagged.join(spread, keys).where(chord2 <= limit)
            .drop("_cy", "_cx", "_salt", *[f"{side}{a}" for side in ("_l", "_r") for a in "xyz"])
            .withColumn("distance_km", geo.haversine_km(lat, lon, r_lat, r_lon)).where(F.col("distance_km") <= radius_km))


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition at the session's full width.

    Adaptive execution would merge these small inputs into a few tasks, although the
    join behind them multiplies the rows; an explicit number keeps the width.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _unit_vector(lat: Column, lon: Column, prefix: str) -> dict[str, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return {f"{prefix}x": F.cos(phi) * F.cos(lam), f"{prefix}y": F.cos(phi) * F.sin(lam), f"{prefix}z": F.sin(phi)}


def positions(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.select(lat, lon).distinct()


def nearest_within(points: DataFrame, others: DataFrame, other_id: str, radius_km: float,
                   point_at: tuple[str, str] = ("lat", "lon"), other_at: tuple[str, str] = ("lat", "lon"),
                   on: tuple[str, str] | None = None, how: str = "left") -> DataFrame:
    """Add the closest other row (``other_id``, ``distance_km``); smallest id on a tie.

    ``on`` optionally names an equality (point column, other column), e.g. the road.
    """
    p_key = [*point_at] + ([on[0]] if on else [])
    o_cols = [F.col(other_at[0]).alias("s_lat"), F.col(other_at[1]).alias("s_lon")]
    if on:
        o_cols.append(F.col(on[1]).alias(on[0]))
    places = others.groupBy(*o_cols).agg(F.min(other_id).alias("_other"))
    pairs = pairs_within(points.select(*p_key).distinct(), places, radius_km, point_at, on=[on[0]] if on else None)
    best = pairs.groupBy(*p_key).agg(F.min(F.struct("distance_km", "_other")).alias("_best"))
    best = best.select(*p_key, F.col("_best._other").alias(other_id), F.col("_best.distance_km").alias("distance_km"))
    return attach(points, best, p_key, how)


def containing_region(points: DataFrame, regions: DataFrame, order: str = "regiao_id", ring: str = "polygon",
                      cell: float = 0.25, name: str = "regiao_id") -> DataFrame:
    """Left-join every position with the first region (by ``order``) whose ring holds it.

    Rings are spread over the grid cells of their bounding box; a point only meets
    the rings of its own cell.
    """
    inside = _regions_of(positions(points), regions, order, ring, cell, name)
    return attach(points, inside.where(F.col(name).isNotNull()), ["lat", "lon"])


def _regions_of(spots: DataFrame, regions: DataFrame, order: str, ring: str, cell: float, name: str) -> DataFrame:
    """Distinct positions with their region or null, in one pass."""
    lats = F.transform(ring, lambda p: p["lat"])
    lons = F.transform(ring, lambda p: p["lon"])
    cover = (regions.where(F.size(ring) > 0)
             .select(F.col(order).alias("_region"), F.col(ring).alias("_ring"),
                     F.explode(_cells(F.array_min(lats), F.array_max(lats), cell)).alias("_cy"),
                     _cells(F.array_min(lons), F.array_max(lons), cell).alias("_xs"))
             .withColumn("_cx", F.explode("_xs")).drop("_xs"))
    keyed = spots.withColumns({
        "_cy": F.floor(F.col("lat") / F.lit(cell)).cast("long"),
        "_cx": F.floor(F.col("lon") / F.lit(cell)).cast("long")})
    holds = geo.ring_contains(F.col("_ring"), F.col("lat"), F.col("lon"))
    return keyed.join(cover, ["_cy", "_cx"], "left").groupBy(*spots.columns).agg(
        F.min(F.when(holds, F.col("_region"))).alias(name))


def axis_segments(regions: DataFrame, order: str = "regiao_id", axis: str = "eixo") -> DataFrame:
    """Consecutive vertex pairs of every axis; no rows for an empty axis."""
    a = F.col("_a")
    return (regions.where(F.size(axis) > 1)
            .select(F.col(order).alias("region"), F.col(axis).alias("_a"),
                    F.explode(F.sequence(F.lit(0), F.size(axis) - 2)).alias("seq"))
            .select("region", "seq",
                    F.get(a, F.col("seq"))["lat"].alias("lat1"), F.get(a, F.col("seq"))["lon"].alias("lon1"),
                    F.get(a, F.col("seq") + 1)["lat"].alias("lat2"), F.get(a, F.col("seq") + 1)["lon"].alias("lon2")))


def nearest_axis(points: DataFrame, segments: DataFrame, cutoff_km: float = AXIS_CUTOFF_KM,
                 name: str = "regiao_id") -> DataFrame:
    """Left-join every position with the region of the closest segment below the cutoff.

    Planar distance at the point; on equal distance the lower region wins. Adds
    ``name``, ``axis_km`` (distance), ``axis_seq`` and ``axis_t`` (place on the segment).
    """
    best = _axes_of(positions(points), segments, cutoff_km).where(F.col("_axis").isNotNull()).select(
        "lat", "lon", F.col("_axis.region").alias(name), F.col("_axis._d").alias("axis_km"),
        F.col("_axis.seq").alias("axis_seq"), F.col("_axis._t").alias("axis_t"))
    return attach(points, best, ["lat", "lon"])


def _axes_of(spots: DataFrame, segments: DataFrame, cutoff_km: float) -> DataFrame:
    """Distinct positions with the closest segment below the cutoff as ``_axis``, or null, in one pass."""
    degrees = cutoff_km / geo.PLANAR_KM_PER_DEGREE * 1.001
    size = max(degrees, 0.01)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    top = F.least(F.greatest(F.abs(low), F.abs(high)) + F.lit(degrees), F.lit(89.0))
    pad = F.lit(degrees) / F.cos(F.radians(top))
    spread = (segments
              .withColumn("_cy", F.explode(_cells(low - F.lit(degrees), high + F.lit(degrees), size)))
              .withColumn("_cx", F.explode(_cells(F.least("lon1", "lon2") - pad, F.greatest("lon1", "lon2") + pad, size))))
    keyed = spots.withColumns({
        "_cy": F.floor(F.col("lat") / F.lit(size)).cast("long"),
        "_cx": F.floor(F.col("lon") / F.lit(size)).cast("long")})
    here = (F.col("lat"), F.col("lon"))
    ends = ((F.col("lat1"), F.col("lon1")), (F.col("lat2"), F.col("lon2")))
    met = keyed.join(spread, ["_cy", "_cx"], "left").withColumns({
        "_d": geo.segment_distance_km(*here, *ends), "_t": geo.segment_parameter(*here, *ends)})
    return met.groupBy(*spots.columns).agg(
        F.min(F.when(F.col("_d") < cutoff_km, F.struct("_d", "region", "seq", "_t"))).alias("_axis"))


def locate_region(points: DataFrame, regions: DataFrame, cutoff_km: float = AXIS_CUTOFF_KM) -> DataFrame:
    """Region by containment, else by the nearest axis within the cutoff, else null."""
    inside = _regions_of(positions(points), regions, "regiao_id", "polygon", 0.25, "_inside")
    near = _axes_of(inside, axis_segments(regions), cutoff_km)
    found = near.select("lat", "lon", F.coalesce("_inside", F.col("_axis.region")).alias("regiao_id"))
    return attach(points, found.where("regiao_id IS NOT NULL"), ["lat", "lon"])


def ring_edges(regions: DataFrame, order: str = "regiao_id", ring: str = "polygon") -> DataFrame:
    """Every edge of every ring: ``region`` and ``r_lat1, r_lon1, r_lat2, r_lon2``; the last vertex joins the first."""
    r = F.col("_r")
    at = lambda i, a: F.get(r, i)[a]
    here, after = F.col("_i"), (F.col("_i") + 1) % F.size(r)
    return (regions.where(F.size(ring) > 1).select(F.col(order).alias("region"), F.col(ring).alias("_r"))
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_r") - 1)))
            .select("region", at(here, "lat").alias("r_lat1"), at(here, "lon").alias("r_lon1"), at(after, "lat").alias("r_lat2"), at(after, "lon").alias("r_lon2")))


def first_touched_region(segments: DataFrame, regions: DataFrame, key: str, order: str = "regiao_id", cell: float = 0.25) -> DataFrame:
    """First region (by ``order``) that each line touches: (key, ``order``), lines outside all regions with null.

    ``segments`` carries ``key, lat1, lon1, lat2, lon2``, one row per segment of a line. A line touches a region when a vertex lies inside it or a
    segment meets one of its edges, ends included. Vertices go through the containment join as distinct positions; segments and
    edges meet in the grid cells that both bounding boxes share, so a long line or a ring of many edges is spread over its cells.
    """
    ends = [segments.select(key, F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon")) for i in (1, 2)]
    vertices = ends[0].unionByName(ends[1]).distinct()
    held = containing_region(vertices, regions, order, name="_region").where("_region IS NOT NULL").select(key, "_region")
    lines = (segments.select(key, "lat1", "lon1", "lat2", "lon2").distinct()
             .withColumn("_cy", F.explode(_cells(F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), cell)))
             .withColumn("_cx", F.explode(_cells(F.least("lon1", "lon2"), F.greatest("lon1", "lon2"), cell))))
    edges = (ring_edges(regions, order)
             .withColumn("_cy", F.explode(_cells(F.least("r_lat1", "r_lat2"), F.greatest("r_lat1", "r_lat2"), cell)))
             .withColumn("_cx", F.explode(_cells(F.least("r_lon1", "r_lon2"), F.greatest("r_lon1", "r_lon2"), cell))))
    point = lambda prefix, i: (F.col(f"{prefix}lat{i}"), F.col(f"{prefix}lon{i}"))
    meets = geo.segments_meet(point("", 1), point("", 2), point("r_", 1), point("r_", 2))
    crossed = lines.join(edges, ["_cy", "_cx"]).where(meets).select(key, F.col("region").alias("_region"))
    every = segments.select(key, F.lit(None).cast(regions.schema[order].dataType).alias("_region"))
    return every.unionByName(held).unionByName(crossed).groupBy(key).agg(F.min("_region").alias(order))


def lines_near(points: DataFrame, segments: DataFrame, key: str, tolerance_km: float) -> DataFrame:
    """Lines at most ``tolerance_km`` from each distinct position: ``lat, lon``, key, ``distance_km`` (planar, of the closest segment).

    Both sides are dealt out before the join: the planner takes a segment for one row, whatever the cells it is copied to, and would broadcast the copies.
    """
    degrees = tolerance_km / geo.PLANAR_KM_PER_DEGREE * 1.001
    size = max(degrees, 0.01)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    pad = F.lit(degrees) / F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(high)) + F.lit(degrees), F.lit(89.0))))
    spread = (segments.select(key, "lat1", "lon1", "lat2", "lon2")
              .withColumn("_cy", F.explode(_cells(low - F.lit(degrees), high + F.lit(degrees), size)))
              .withColumn("_cx", F.explode(_cells(F.least("lon1", "lon2") - pad, F.greatest("lon1", "lon2") + pad, size))))
    keyed = positions(points).withColumns({"_cy": F.floor(F.col("lat") / F.lit(size)).cast("long"), "_cx": F.floor(F.col("lon") / F.lit(size)).cast("long")})
    d = geo.segment_distance_km(F.col("lat"), F.col("lon"), (F.col("lat1"), F.col("lon1")), (F.col("lat2"), F.col("lon2")))
    return (spread_out(keyed, "_cy", "_cx").join(spread_out(spread, "_cy", "_cx"), ["_cy", "_cx"]).withColumn("distance_km", d).where(F.col("distance_km") <= tolerance_km)
            .groupBy("lat", "lon", key).agg(F.min("distance_km").alias("distance_km")))


def grid_cell(lat: Column, lon: Column, lat0: float, lon0: float, step: float) -> tuple[Column, Column]:
    """Index of the nearest grid node."""
    return (F.round((lat - F.lit(lat0)) / F.lit(step)).cast("int"), F.round((lon - F.lit(lon0)) / F.lit(step)).cast("int"))


def range_pairs(left: DataFrame, right: DataFrame, road: str, left_range: tuple[str, str], right_range: tuple[str, str],
                width: float = 5.0, pad: float = 0.0, salts: int = 4) -> DataFrame:
    """Rows of the same road whose closed ranges come within ``pad`` of each other.

    Both ranges are cut into buckets of ``width``; a pair is kept only in the first
    bucket it shares, so no pair repeats. Feed distinct ranges.
    """
    l0, l1 = F.col(left_range[0]) - F.lit(pad), F.col(left_range[1]) + F.lit(pad)
    r0, r1 = F.col(right_range[0]), F.col(right_range[1])
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    a = (left.withColumn("_lb", bucket(l0)).withColumn("_bucket", F.explode(F.sequence("_lb", bucket(l1))))
         .withColumn("_salt", F.pmod(F.xxhash64(*left_range), F.lit(salts)).cast("int")))
    a = spread_out(a, road, "_bucket", "_salt")
    b = (right.withColumn("_rb", bucket(r0)).withColumn("_bucket", F.explode(F.sequence("_rb", bucket(r1))))
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    b = spread_out(b, road, "_bucket", "_salt")
    return (a.join(b, [road, "_bucket", "_salt"])
            .where((F.col("_bucket") == F.greatest("_lb", "_rb")) & (F.greatest(l0, r0) <= F.least(l1, r1)))
            .drop("_bucket", "_salt", "_lb", "_rb"))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def sample_line(segments: DataFrame, key: str, n: int = 7) -> DataFrame:
    """``n`` evenly spaced points from the first to the last vertex of every line.

    Each segment yields the samples that fall on it, so no join is needed; a sample
    on a shared vertex belongs to the earlier segment.
    """
    size = F.sqrt(F.pow(F.col("lat2") - F.col("lat1"), 2) + F.pow(F.col("lon2") - F.col("lon1"), 2))
    walk = OrderedBlocks.of(segments.withColumn("_len", size), [key], ["seq"]).cumulative({
        "_before": ("sum", F.col("_len"), False), "_total": ("total", F.col("_len"), True)})
    step = F.col("_total") / F.lit(float(n - 1))
    eps = F.lit(1e-9)
    first = F.ceil(F.col("_before") / step - eps).cast("int")
    last = F.floor((F.col("_before") + F.col("_len")) / step + eps).cast("int")
    picked = (walk.where("_len > 0").withColumns({"_f": first, "_l": F.least(last, F.lit(n - 1))}).where("_f <= _l")
              .withColumn("sample", F.explode(F.sequence("_f", "_l")))
              .withColumn("_t", (F.col("sample") * step - F.col("_before")) / F.col("_len")))
    at = lambda a: F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * F.col("_t")
    best = F.min_by(F.struct(at("lat").alias("lat"), at("lon").alias("lon")), F.col("seq"))
    return picked.groupBy(key, "sample").agg(best.alias("_p")).select(key, "sample", "_p.lat", "_p.lon")


def densify(segments: DataFrame, steps: int) -> DataFrame:
    """Points at a fixed number of steps per segment, interpolated linearly (km likewise when present)."""
    t = F.col("step") / F.lit(float(steps))
    out = segments.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    for a in ("lat", "lon", "km"):
        if f"{a}1" in segments.columns:
            out = out.withColumn(a, F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * t)
    return out
