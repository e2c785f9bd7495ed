"""Range look-ups by sweeps against loops over all pairs."""

import random

import pytest

from rainrisk.operators import intervals, scale, sweep


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    value = lambda: rng.randrange(0, 60) / 2
    left = [(i, rng.choice("abc"), *sorted((value(), value()))) for i in range(120)] + [(120, "a", None, 3.0), (121, None, 1.0, 2.0), (122, "b", 9.0, 4.0), (123, "none", 1.0, 2.0)]
    right = [(i, rng.choice("abd"), *sorted((value(), value() / rng.choice([1, 8])))) for i in range(70)] + [(70, "a", None, 3.0), (71, "a", 8.0, 2.0), (72, "b", 5.0, 5.0)]
    right += [(i, "c", 0.0, 30.0) for i in range(73, 76)]
    rng.shuffle(right)
    return (left, right, spark.createDataFrame(left, "ua_id int, road string, km0 double, km1 double").repartition(3),
            spark.createDataFrame(right, "seq int, road string, r0 double, r1 double").repartition(4))


def test_first_overlap(tables):
    left, right, l, r = tables
    meets = lambda x, y: x[1] == y[1] and None not in (*x, *y) and max(x[2], y[2]) <= min(x[3], y[3])
    want = {x[0]: min((y[0] for y in right if meets(x, y)), default=None) for x in left}
    assert {u.ua_id: u.seq for u in intervals.first_overlap(l, r, "seq", ["seq"]).collect()} == want and None in want.values()


def test_first_containing(tables):
    left, right, l, r = tables
    holds = lambda x, y: x[1] == y[1] and None not in (x[1], x[2], *y) and y[2] <= x[2] <= y[3]
    want = {x[0]: min((y[0] for y in right if holds(x, y)), default=None) for x in left}
    assert {u.ua_id: u.seq for u in intervals.first_containing(l, r, "seq", ["seq"], "km0").collect()} == want


def test_nearest_on_road(tables):
    left, right, l, r = tables
    want = {}
    for i, road, a, b in left:
        m = None if a is None else (a + b) / 2
        near = [(max(0.0, y[2] - m, m - y[3]), y[0]) for y in right if m is not None and y[1] == road and None not in y and y[2] <= y[3]]
        want[i] = min((n for n in near if n[0] <= 1.5), default=(None, None))
    assert {u.ua_id: (u.dist_km, u.seq) for u in intervals.nearest_on_road(l, r, "seq", cutoff_km=1.5).collect()} == want


def test_count_inside(tables):
    left, right, l, r = tables
    want = {y[0]: sum(x[1] == y[1] and x[2] is not None and None not in y and y[2] - 0.5 <= x[2] <= y[3] + 0.5 for x in left) for y in right}
    assert {a.seq: a.observed for a in intervals.count_inside(r, l).collect()} == want


def test_crowd_over_one_place_makes_no_pairs(spark, monkeypatch):
    """All ranges of a road hold all its positions: nodes keep one row, also where high nodes are known by their parts."""
    monkeypatch.setattr(sweep, "GRAIN", 3)
    ranges = spark.range(400).selectExpr("'r' AS road", "CAST(id AS double) / 1000 AS r0", "1000 - CAST(id AS double) / 1000 AS r1", "named_struct('i', id) AS row")
    spots = spark.range(300).selectExpr("'r' AS road", "CAST(id + 1 AS double) AS _x")
    places = sweep.Places(ranges, spots, "road", "r0", "r1")
    got = sweep.first_holding(places, ranges, spots, "r0", "r1", "row").collect()
    assert len(got) == 300 and {g.row.i for g in got} == {0}


def test_next_value_over_blocks(spark):
    rows = [("k", i, i if i % 7 == 0 else None) for i in range(50)]
    blocks = scale.OrderedBlocks.of(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"])
    got = {r.i: r.n for r in blocks.cumulative({"n": ("ahead", blocks.rows["v"], False)}).collect()}
    assert got == {i: next((j for j in range(i + 1, 50) if j % 7 == 0), None) for i in range(50)}
