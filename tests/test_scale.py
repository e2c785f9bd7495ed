"""A third or more of the rows on one key, small partitions, exact results."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from rainrisk.operators import intervals, scale, spatial


def hot(spark, n=3000):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", round(rng.gauss(10, 5), 2), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double, id int").repartition(6)


def test_exact_quantiles_with_hot_key(spark):
    rows, df = hot(spark)
    got = {r.k: r for r in scale.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    for k in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == k]
        assert abs(got[k].p50 - statistics.median(v)) < 1e-9 and abs(got[k].p90 - np.percentile(v, 90)) < 1e-9
        assert got[k].n_values == len(v)


def test_index_quantile_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "k string, v double")
    # (6-1)*0.5 = 2.5 picks index 2; (6-1)*0.9 = 4.5 picks index 4
    r = scale.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}, "index").first()
    assert (r.p50, r.p90) == (2.0, 4.0)


def test_numbering_spreads_over_blocks(spark):
    rows, df = hot(spark)
    blocks = scale.OrderedBlocks.of(df, ["k"], ["v", "id"])
    got = blocks.cumulative({"rn": ("sum", F.lit(1), True), "top": ("max", F.col("id"), False), "prev": ("last", F.col("id"), False), "before": ("prev", F.col("id"), False), "after": ("next", F.col("id"), False), "n": ("total", F.lit(1), True)}).collect()
    for k in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        have = {r.id: r for r in got if r.k == k}
        for i, w in enumerate(want):
            r = have[w[2]]
            assert (r.rn, r.n) == (i + 1, len(want))
            assert r.prev == r.before == (want[i - 1][2] if i else None)
            assert r.after == (want[i + 1][2] if i + 1 < len(want) else None)
            assert r.top == (max(x[2] for x in want[:i]) if i else None)


def test_blocks_really_split_a_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, df = hot(spark)
        n = scale.OrderedBlocks.of(df, ["k"], ["v", "id"]).rows.where("k = 'hot'").select(scale.BLOCK).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert n > 1


def test_top_per_group_cuts_before_the_shuffle(spark):
    _, df = hot(spark)
    out = scale.top_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_pairs_match_brute_force(spark):
    rng = random.Random(11)
    left = [(round(rng.uniform(-24, -23), 3), round(rng.uniform(-46, -45), 3)) for _ in range(120)]
    right = [(round(rng.uniform(-24, -23), 3), round(rng.uniform(-46, -45), 3)) for _ in range(80)] + left[:5]
    la, lb = spark.createDataFrame(set(left), "lat double, lon double"), spark.createDataFrame(set(right), "s_lat double, s_lon double")
    got = {(r.lat, r.lon, r.s_lat, r.s_lon) for r in spatial.pairs_within(la, lb, 12.0).collect()}
    from tests.test_gauges import _km

    assert got == {(*a, *b) for a in set(left) for b in set(right) if _km(*a, *b) <= 12.0}


def test_pairs_have_no_cross_product(spark):
    la, lb = spark.createDataFrame([(-23.5, -45.5)], "lat double, lon double"), spark.createDataFrame([(-23.5, -45.5)], "s_lat double, s_lon double")
    plan = spatial.pairs_within(la, lb, 12.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_ranges_meet_once(spark):
    left = spark.createDataFrame([("r", 0.0, 40.0), ("r", 7.0, 7.0)], "road string, km0 double, km1 double")
    right = spark.createDataFrame([("r", 3.0, 38.0), ("r", 40.0, 41.0), ("r", 50.0, 60.0), ("q", 0.0, 99.0)], "road string, r0 double, r1 double")
    got = sorted((r.km0, r.r0) for r in spatial.range_pairs(left, right, "road", ("km0", "km1"), ("r0", "r1")).collect())
    assert got == [(0.0, 3.0), (0.0, 40.0), (7.0, 3.0)]


def test_copies_collapse_but_every_row_answers(spark):
    units = spark.createDataFrame([(i, "r", 1.0, 1.4) for i in range(500)] + [(500, "r", 80.0, 80.4)], "ua_id int, road string, km0 double, km1 double")
    seg = spark.createDataFrame([(i, "r", 0.0, 2.0) for i in range(100, 200)], "trecho_id int, road string, r0 double, r1 double")
    got = {r.ua_id: r.trecho_id for r in intervals.nearest_on_road(units, seg, "trecho_id").collect()}
    assert len(got) == 501 and set(got.values()) == {100, None} and got[500] is None


def test_region_lookup_order_and_axis_fallback(spark):
    ring = lambda a, b, c, d: [(a, c), (a, d), (b, d), (b, c)]
    rows = [(1, ring(-24.0, -23.0, -46.0, -45.0), []), (2, ring(-23.5, -22.5, -46.0, -45.0), []), (3, [], [(-21.0, -45.0), (-21.0, -44.0)])]
    regions = spark.createDataFrame(rows, "regiao_id int, polygon array<struct<lat:double,lon:double>>, eixo array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([("both", -23.2, -45.5), ("second", -22.7, -45.5), ("axis", -21.1, -44.5), ("far", -19.0, -44.5)], "ua_id string, lat double, lon double")
    got = {r.ua_id: r.regiao_id for r in spatial.locate_region(pts, regions).collect()}
    assert got == {"both": 1, "second": 2, "axis": 3, "far": None}


def test_nearest_on_the_same_road(spark):
    pts = spark.createDataFrame([("a", -23.5, -45.5, "r1"), ("b", -23.5, -45.5, "r2"), ("c", -23.5, -45.5, "r9")], "ua_id string, lat double, lon double, road string")
    seg = spark.createDataFrame([("s1", -23.501, -45.5, "r2"), ("s2", -23.504, -45.5, "r1"), ("s3", -23.503, -45.5, "r1"), ("s0", -23.503, -45.5, "r1")], "seg string, lat double, lon double, rodovia string")
    got = {r.ua_id: r.seg for r in spatial.nearest_within(pts, seg, "seg", 0.5, on=("road", "rodovia")).collect()}
    assert got == {"a": "s0", "b": "s1", "c": None}
    assert {r.ua_id: r.seg for r in spatial.nearest_within(pts, seg, "seg", 0.5).collect()} == {"a": "s1", "b": "s1", "c": "s1"}


def test_attach_splits_a_hot_key(spark):
    big = spark.range(4000).select(F.col("id").alias("ua_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("k"))
    look = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, v int")
    got = scale.attach(big, look, ["k"]).groupBy("v").count().collect()
    assert {(r.v, r["count"]) for r in got} == {(1, 2800), (None, 1200)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used = scale.attach(big, look, ["k"]).where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 1


def test_guard_is_a_scalar(spark):
    from rainrisk import fixtures as fx
    from rainrisk.operators.risk import default_regions
    from rainrisk.plans import cycle

    sf = "/root/testdata/sf0.001"
    data = cycle.Inputs(fx.units(spark, sf), fx.grid_hourly(spark, sf, 96), default_regions(spark))
    plan = cycle.snapshot_at(data, fx.target(), fx.target())._jdf.queryExecution().executedPlan().toString()
    assert "ubquery#" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from rainrisk import fixtures as fx

    plan = fx.gauge_hourly(spark, "/root/testdata/sf0.001", 96)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
