"""Lines against polygons, compared with exact clipping."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from rainrisk.operators import risk, spatial
from rainrisk.plans import cycle

LINE = "road_id long, seq int, lat1 double, lon1 double, lat2 double, lon2 double"
RING = "regiao_id int, polygon array<struct<lat:double,lon:double>>"


def clipped(segment, ring):
    """Whether a closed segment meets a closed convex polygon, by cutting it at every edge in exact numbers."""
    (y1, x1), (y2, x2) = segment
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))
    low, high = Fraction(0), Fraction(1)
    for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]):
        at = lambda y, x: ((by - ay) * (x - ax) - (bx - ax) * (y - ay)) * (1 if area > 0 else -1)  # noqa: E731, B023
        start, end = at(y1, x1), at(y2, x2)
        if start < 0 and end < 0:
            return False
        if start == end:
            continue
        cut = Fraction(start, start - end)
        low, high = (max(low, cut), high) if start < 0 else (low, min(high, cut)) if end < 0 else (low, high)
    return low <= high


def test_first_touched_region_against_exact_clipping(spark):
    rng = random.Random(3)
    spot = lambda: (rng.randrange(12), rng.randrange(12))
    rings = []
    while len(rings) < 12:
        ring = [spot(), spot(), spot()]
        if (ring[1][0] - ring[0][0]) * (ring[2][1] - ring[0][1]) != (ring[1][1] - ring[0][1]) * (ring[2][0] - ring[0][0]):
            rings.append(ring)
    lines = {k: [(spot(), spot()) for _ in range(rng.randrange(1, 3))] for k in range(300)}
    table = spark.createDataFrame([(k, i, *map(float, (*a, *b))) for k, parts in lines.items() for i, (a, b) in enumerate(parts)], LINE)
    regions = spark.createDataFrame([(i, [(float(y), float(x)) for y, x in ring]) for i, ring in enumerate(rings)], RING)
    for chosen in (range(12), range(6, 12), range(3)):
        got = {r["road_id"]: r["regiao_id"] for r in spatial.first_touched_region(table, regions.where(F.col("regiao_id").isin(*chosen)), "road_id").collect()}
        assert got == {k: min((i for i in chosen if any(clipped(s, rings[i]) for s in parts)), default=None) for k, parts in lines.items()}


def test_lines_of_nothing(spark):
    none, regions = spark.createDataFrame([], LINE), spark.createDataFrame([], RING)
    assert spatial.first_touched_region(none, regions, "road_id").count() == 0
    one = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0)], LINE)
    assert spatial.first_touched_region(one, regions, "road_id").collect() == [(1, None)]
    spots = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (50.0, 0.0)], "lat double, lon double")
    assert [tuple(r) for r in spatial.lines_near(spots, one, "road_id", 1.0).collect()] == [(0.0, 0.0, 1, 0.0)]


def test_layers_at_copy_no_line_to_cells(spark):
    """Every layer is a filter of its table: a line of any length stays one row, and no join or broadcast is planned."""
    roads = spark.createDataFrame([(1, 0, -80.0, -170.0, 80.0, 170.0), (2, 0, 0.05, -1.0, 0.05, 1.0), (2, 1, 0.01, 1.0, 0.01, -1.0), (3, 0, 2.0, 2.0, 2.0, 2.0)], LINE)
    areas = spark.createDataFrame([(i, [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)]) for i in (7, 5)], "area_id int, polygon array<struct<lat:double,lon:double>>")
    units = spark.createDataFrame([(8, 0.0, 0.0), (9, 0.0, 0.1), (9, 0.0, 0.1), (10, 1.0, 0.0), (11, None, 0.0)], "ua_id long, lat double, lon double")
    out = cycle.layers_at(0.0, 0.0, units, risk.default_regions(spark), tolerance_km=20.0, roads=roads, areas=areas)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    got = sorted((r["layer"], r["id"], round(r["distance_km"], 3)) for r in out.collect())
    assert got == [("area", "5", 0.0), ("road", "1", 0.0), ("road", "2", 1.113), ("unit", "8", 0.0), ("unit", "9", 11.119), ("unit", "9", 11.119)]
