"""Kilometre intervals: first match, overlap shares, union, complement and even splits.

Every operator collapses identical ranges before it joins or orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SAME_ROAD_CUTOFF_KM
from . import sweep
from .scale import OrderedBlocks, attach, numbered
from .spatial import overlap_length, range_pairs


def _ranges(df: DataFrame, road: str, a: str, b: str) -> DataFrame:
    return df.select(road, a, b).distinct()


def _taken(left: DataFrame, hit: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    return attach(left, hit, on).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in take])


def _best_rows(right: DataFrame, road: str, right_range: tuple[str, str], order: str, take: list[str]) -> DataFrame:
    """Distinct ranges with their first row; a range that ends before it starts holds nothing."""
    a, b = right_range
    return right.where(F.col(a) <= F.col(b)).groupBy(road, a, b).agg(F.min(F.struct(order, *[c for c in take if c != order])).alias("_row"))


def first_overlap(left: DataFrame, right: DataFrame, order: str, take: list[str], road: str = "road",
                  left_range: tuple[str, str] = ("km0", "km1"), right_range: tuple[str, str] = ("r0", "r1")) -> DataFrame:
    """Left join with the first right row (by ``order``) whose closed range overlaps: one that holds the start, or one that starts inside."""
    ranges = _best_rows(right, road, right_range, order, take)
    a, b = left_range
    spans = _ranges(left, road, a, b).where(F.col(a) <= F.col(b))
    spots = spans.select(road, F.explode(F.array(a, b)).alias("_x")).distinct()
    places = sweep.Places(ranges, spots, road, *right_range)
    starts = spans.select(road, F.col(a).alias("_x")).distinct()
    held = sweep.first_holding(places, ranges, starts, *right_range, "_row").withColumnRenamed("_x", a)
    inside = sweep.first_starting(places, ranges, spans, right_range[0], "_row", a, b)
    hit = spans.join(held, [road, a]).select(road, a, b, "_row").unionByName(inside).groupBy(road, a, b).agg(F.min("_row").alias("_row"))
    return _taken(left, hit, [road, a, b], take)


def first_containing(left: DataFrame, right: DataFrame, order: str, take: list[str], at: str, road: str = "road",
                     right_range: tuple[str, str] = ("r0", "r1")) -> DataFrame:
    """Left join with the first right row whose closed range holds the position."""
    ranges = _best_rows(right, road, right_range, order, take)
    spots = left.select(road, F.col(at).alias("_x")).distinct()
    hit = sweep.first_holding(sweep.Places(ranges, spots, road, *right_range), ranges, spots, *right_range, "_row")
    return _taken(left, hit.withColumnRenamed("_x", at), [road, at], take)


def longest_overlap(left: DataFrame, right: DataFrame, label: str, road: str = "road",
                    left_range: tuple[str, str] = ("km0", "km1"), right_range: tuple[str, str] = ("r0", "r1"),
                    width: float = 5.0) -> DataFrame:
    """Left join with the label of the single longest overlap, adding ``overlap_km``; smallest label on a tie."""
    places = right.groupBy(road, *right_range).agg(F.min(label).alias("_label"))
    o = overlap_length(*[F.col(c) for c in (*left_range, *right_range)])
    best = (range_pairs(_ranges(left, road, *left_range), places, road, left_range, right_range, width)
            .withColumn("_o", o).where("_o > 0")
            .groupBy(road, *left_range).agg(F.min(F.struct((-F.col("_o")).alias("o"), "_label")).alias("_b")))
    return attach(left, best, [road, *left_range]).select(
        *left.columns, F.col("_b._label").alias(label), (-F.col("_b.o")).alias("overlap_km"))


def majority_class(left: DataFrame, right: DataFrame, cls: str, road: str = "road",
                   left_range: tuple[str, str] = ("km0", "km1"), right_range: tuple[str, str] = ("r0", "r1"),
                   width: float = 5.0) -> DataFrame:
    """Left join with the class of the largest summed overlap; highest class on a tie, null without overlap."""
    places = right.groupBy(road, *right_range, cls).agg(F.count(F.lit(1)).alias("_n"))
    o = F.round(overlap_length(*[F.col(c) for c in (*left_range, *right_range)]) * F.lit(1e6)).cast("long") * F.col("_n")
    per_class = (range_pairs(_ranges(left, road, *left_range), places, road, left_range, right_range, width)
                 .groupBy(road, *left_range, cls).agg(F.sum(o).alias("_o")).where("_o > 0"))
    best = per_class.groupBy(road, *left_range).agg(F.max(F.struct("_o", cls)).alias("_b")).select(
        road, *left_range, F.col(f"_b.{cls}").alias(cls), (F.col("_b._o") / F.lit(1e6)).alias("overlap_km"))
    return attach(left, best, [road, *left_range])


def nearest_on_road(units: DataFrame, segments: DataFrame, segment_id: str, road: str = "road",
                    unit_range: tuple[str, str] = ("km0", "km1"), segment_range: tuple[str, str] = ("r0", "r1"),
                    cutoff_km: float = SAME_ROAD_CUTOFF_KM) -> DataFrame:
    """Left join with the closest segment of the same road within the cutoff, by the middle of the unit.

    Adds ``segment_id`` and ``dist_km`` (0 inside the segment); smallest id on a tie.
    """
    mid = (F.col(unit_range[0]) + F.col(unit_range[1])) / F.lit(2.0)
    a, b = segment_range
    ranges = segments.where(F.col(a) <= F.col(b)).groupBy(road, a, b).agg(F.min(segment_id).alias("_seg"))
    spots = units.select(road, mid.alias("_x")).distinct()
    inside = sweep.first_holding(sweep.Places(ranges, spots, road, a, b), ranges, spots, a, b, "_seg")
    beside = sweep.nearest_ends(ranges, spots, road, a, b, "_seg").join(inside, [road, "_x"], "left")
    option = lambda d, seg: F.when(seg.isNotNull() & (d <= cutoff_km), F.struct(d.alias("d"), seg.alias("seg")))
    x, left, right = F.col("_x"), F.col("_left"), F.col("_right")
    best = F.least(option(F.lit(0.0), F.col("_seg")), option(x - left["at"], left["row"]), option(right["at"] - x, right["row"]))
    found = beside.select(road, F.col("_x").alias("_m"), best.alias("_b")).where("_b IS NOT NULL")
    return attach(units.withColumn("_m", mid), found, [road, "_m"]).select(
        *units.columns, F.col("_b.seg").alias(segment_id), F.col("_b.d").alias("dist_km"))


def count_inside(areas: DataFrame, units: DataFrame, road: str = "road", area_range: tuple[str, str] = ("r0", "r1"),
                 at: str = "km0", pad: float = 0.5) -> DataFrame:
    """Units per area whose position lies in the range widened by ``pad``; zero when none."""
    spots = units.groupBy(road, F.col(at).alias("_x")).agg(F.count(F.lit(1)).alias("observed"))
    a, b = area_range
    spans = _ranges(areas, road, a, b).select(road, a, b, (F.col(a) - F.lit(pad)).alias("_lo"), (F.col(b) + F.lit(pad)).alias("_hi"))
    n = sweep.count_between(spots, spans.select(road, "_lo", "_hi").distinct(), road, "observed", "_lo", "_hi")
    return attach(areas, spans.join(n, [road, "_lo", "_hi"]).select(road, a, b, "observed"), [road, a, b]).fillna(0, ["observed"])


def union_intervals(intervals: DataFrame, keys: list[str], a: str = "a", b: str = "b", kind: str = "kind") -> DataFrame:
    """Merge overlapping or touching ranges per key, with the sorted set of kinds."""
    distinct = intervals.select(*keys, a, b, kind).distinct()
    blocks = OrderedBlocks.of(distinct, keys, [a, b, kind]).extend({"_reach": ("max", F.col(b), False)})
    starts = F.when(F.col("_reach").isNull() | (F.col(a) > F.col("_reach")), 1).otherwise(0)
    return (blocks.cumulative({"_island": ("sum", starts.cast("long"), True)})
            .groupBy(*keys, "_island").agg(F.min(a).alias(a), F.max(b).alias(b),
                                           F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("kinds"))
            .drop("_island"))


def complement_intervals(intervals: DataFrame, lengths: DataFrame, keys: list[str], length: str = "length",
                         a: str = "a", b: str = "b") -> DataFrame:
    """Free ranges inside [0, length] per key; the whole range when a key has no interval."""
    distinct = intervals.select(*keys, a, b).distinct()
    walk = OrderedBlocks.of(distinct, keys, [a, b]).cumulative({"_reach": ("max", F.col(b), False)})
    before = walk.select(*keys, F.coalesce("_reach", F.lit(0.0)).alias("free0"), F.col(a).alias("free1"))
    reach = distinct.groupBy(*keys).agg(F.max(b).alias("_end"))
    tail = lengths.join(reach, keys, "left").select(
        *keys, F.greatest(F.coalesce("_end", F.lit(0.0)), F.lit(0.0)).alias("free0"), F.col(length).alias("free1"))
    gaps = attach(before, lengths, keys, "inner").select(*keys, "free0", F.least("free1", length).alias("free1"))
    return gaps.unionByName(tail).where("free1 > free0")


def split_evenly(intervals: DataFrame, counts: DataFrame, keys: list[str], n: str = "n", a: str = "a", b: str = "b") -> DataFrame:
    """Cut the concatenated disjoint ranges of a key into n equal units, mapped back to real offsets.

    A unit that spans several ranges keeps its longest piece (the first on a tie).
    """
    size = F.col(b) - F.col(a)
    walk = OrderedBlocks.of(intervals.select(*keys, a, b), keys, [a, b]).cumulative({
        "_before": ("sum", size, False), "_total": ("total", size, True)})
    step = F.col("_total") / F.col(n)
    end = F.col("_before") + size
    eps = F.lit(1e-9)
    pieces = (attach(walk, counts.select(*keys, n), keys, "inner").where((F.col(n) > 0) & (F.col("_total") > 0))
              .withColumn("unit", F.explode(F.sequence(
                  F.greatest(F.lit(1), F.floor(F.col("_before") / step + eps).cast("int") + 1),
                  F.least(F.col(n).cast("int"), F.greatest(F.lit(1), F.ceil(end / step - eps).cast("int"))))))
              .withColumns({"_s": F.greatest((F.col("unit") - 1) * step, F.col("_before")),
                            "_e": F.least(F.col("unit") * step, end)})
              .where("_s < _e")
              .withColumns({"start": F.col(a) + F.col("_s") - F.col("_before"), "stop": F.col(a) + F.col("_e") - F.col("_before")}))
    best = F.min(F.struct((-F.round(F.col("_e") - F.col("_s"), 9)).alias("l"), "start", "stop"))
    return pieces.groupBy(*keys, "unit").agg(best.alias("_b")).select(*keys, "unit", "_b.start", "_b.stop")


def slice_plan(plan: DataFrame, keys: list[str], a: str = "km0", b: str = "km1", n: str = "n") -> DataFrame:
    """Equal slices of planned ranges, ordered along the key; neighbours meet halfway between them.

    Needs a total order by start inside a key. Adds ``km_ini``, ``km_fim``,
    ``km_lo``, ``km_hi`` and whether the first border comes from the plan.
    """
    width = (F.col(b) - F.col(a)) / F.col(n)
    cut = (plan.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
           .select(*keys, F.round(F.col(a) + F.col("_i") * width, 3).alias("km_ini"),
                   F.round(F.col(a) + (F.col("_i") + 1) * width, 3).alias("km_fim"), (F.col("_i") == 0).alias("planned_start")))
    order = ["km_ini", "km_fim"]
    there = OrderedBlocks.of(cut, keys, order).cumulative({
        "_prev": ("prev", F.col("km_fim"), False), "_next": ("next", F.col("km_ini"), False)})
    half = lambda x, y: (x + y) / F.lit(2.0)
    return there.select(*keys, *order, "planned_start",
                       F.coalesce(half(F.col("_prev"), F.col("km_ini")), F.col("km_ini")).alias("km_lo"),
                       F.coalesce(half(F.col("km_fim"), F.col("_next")), F.col("km_fim")).alias("km_hi"))


def km_to_offset(km: Column, km_min: Column, km_max: Column, length: Column) -> Column:
    """Linear km to offset along an axis, clamped at 0.001 km tolerance; null outside."""
    share = (km - km_min) / F.greatest(km_max - km_min, F.lit(1e-12))
    inside = (km >= km_min - F.lit(0.001)) & (km <= km_max + F.lit(0.001))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * length
    return F.when(~inside, F.lit(None)).when(km_max == km_min, F.lit(0.0)).otherwise(clamped)


def km_at(t: Column, km0: Column, km1: Column) -> Column:
    """Km of a position 0..1 between two posts."""
    return km0 + t * (km1 - km0)


def proportional_split(runs: DataFrame, keys: list[str], target: str = "n", size: str = "size", order: str = "seq") -> DataFrame:
    """Share ``target`` units among the runs of a key by largest remainder, at least one per run.

    Surplus from the minimum is taken back one unit at a time from the runs whose
    count exceeds their share most; both corrections are ranks, so they stay parallel.
    """
    total = runs.groupBy(*keys).agg(F.sum(size).alias("_total"))
    raw = F.col(size) / F.col("_total") * F.col(target)
    base = (attach(runs, total, keys, "inner").where("_total > 0").withColumn("_raw", raw)
            .withColumn("_base", F.greatest(F.lit(1), F.floor("_raw").cast("int"))))
    balance = base.groupBy(*keys).agg((F.sum("_base") - F.max(target)).cast("long").alias("_over"))
    base = attach(base, balance, keys, "inner")
    give = numbered(base.where("_over < 0").select(*keys, order, "_over", (-F.round(F.col("_raw") - F.col("_base"), 9)).alias("_k")),
                    keys, ["_k", order], "_rank").where("_rank <= -_over").select(*keys, order, F.lit(1).alias("_d"))
    steps = base.where("_over > 0 AND _base > 1").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_base") - 1)))
    take = numbered(steps.select(*keys, order, "_over", "_j", (-F.round(F.col("_base") - F.col("_raw") - F.col("_j") + 1, 9)).alias("_k")),
                    keys, ["_k", order, "_j"], "_rank").where("_rank <= _over").groupBy(*keys, order).agg(
                        (-F.count(F.lit(1))).cast("int").alias("_d"))
    delta = give.unionByName(take)
    return base.join(delta, [*keys, order], "left").select(
        *runs.columns, (F.col("_base") + F.coalesce("_d", F.lit(0))).cast("int").alias("allotted"))
