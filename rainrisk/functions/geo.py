"""Distances and geometry tests as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..constants import EARTH_RADIUS_KM

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0
PLANAR_KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_dlat) * F.sin(half_dlat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def lon_0_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + F.lit(360.0)).otherwise(lon)


def ring_contains(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd ray casting over ``array<struct<lat,lon>>``; null or empty ring is false."""
    n = F.size(ring)

    def crossings(acc: Column, i: Column) -> Column:
        a = F.get(ring, i)
        b = F.get(ring, F.pmod(i + n - 1, n))
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        reach = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"] + F.lit(1e-12)) + a["lon"]
        # the guarded denominator is only zero for edges that do not straddle
        return acc + F.when(straddles, F.when(lon < reach, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))

    odd = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossings) % 2 == 1
    return F.when(n > 0, odd).otherwise(F.lit(False))


def planar_offset_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(x, y) in km of a vertex seen from (lat0, lon0), flat-earth at lat0."""
    x = (lon - lon0) * F.lit(PLANAR_KM_PER_DEGREE) * F.cos(F.radians(lat0))
    y = (lat - lat0) * F.lit(PLANAR_KM_PER_DEGREE)
    return x, y


def segment_parameter(lat: Column, lon: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Position 0..1 on segment a-b closest to the point; 0 for a degenerate segment."""
    x1, y1 = planar_offset_km(a[0], a[1], lat, lon)
    x2, y2 = planar_offset_km(b[0], b[1], lat, lon)
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 < 1e-12, F.lit(0.0)).otherwise(-(x1 * dx + y1 * dy) / F.greatest(length2, F.lit(1e-12)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def segment_distance_km(lat: Column, lon: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Planar distance in km from the point to segment a-b."""
    x1, y1 = planar_offset_km(a[0], a[1], lat, lon)
    x2, y2 = planar_offset_km(b[0], b[1], lat, lon)
    t = segment_parameter(lat, lon, a, b)
    px, py = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    return F.sqrt(px * px + py * py)


def segments_meet(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether the closed segments a-b and c-d have a point in common; points are (lat, lon)."""
    def side(p, q, r):
        return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def share(x0, x1, y0, y1):
        return F.greatest(F.least(x0, x1), F.least(y0, y1)) <= F.least(F.greatest(x0, x1), F.greatest(y0, y1))

    boxes = share(a[0], b[0], c[0], d[0]) & share(a[1], b[1], c[1], d[1])
    return boxes & (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)


def swap_axes(coords: Column) -> Column:
    """GeoJSON ``[[lon, lat, ...]]`` to ``array<struct<lat,lon>>``."""
    return F.transform(coords, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))


def largest(rings: Column) -> Column:
    """Ring with most vertices; the first one on a tie."""
    return F.aggregate(
        F.slice(rings, 2, F.size(rings)), F.get(rings, F.lit(0)),
        lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))


def ring_to_geojson(ring: Column, kind: Column) -> Column:
    """GeoJSON geometry text from ``array<struct<lat,lon>>``; null below two vertices."""
    line = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    closed = F.when(F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1), line).otherwise(
        F.concat(line, F.slice(line, 1, 1)))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))
    polyline = F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")))
    return F.when(F.size(ring) < 2, F.lit(None)).when(
        (kind == "polygon") & (F.size(ring) >= 3), polygon).otherwise(polyline)
