"""Ranges along a road by sweeps: first, nearest and count without a list of overlapping pairs.

The ends of the ranges and the looked-up positions of a road get whole-number places in one pass over ordered blocks. A range is then the union of
at most two nodes on each level of a binary tree over the places, and a position lies in one node of each level. Nodes keep only their best row, so what
a position meets grows with the logarithm of the road's ends, however many ranges lie over each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scale import OrderedBlocks, attach

#: A node above this level is known by its parts of this level, so that no key has more than 2**GRAIN positions.
GRAIN = 16


def _shift(how: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{how}", value, by)


def _nodes(lo: Column, hi: Column, levels: Column) -> Column:
    """Array of (level, node) that make up the places lo..hi; empty when lo > hi."""
    one = F.lit(1).cast("long")

    def on(level: Column) -> Column:
        a, b = _shift("right", lo + _shift("left", one, level) - one, level), _shift("right", hi + one, level)
        node = lambda is_in, at: F.when(is_in & (a < b), F.struct(level.alias("level"), at.alias("node")))
        return F.array(node(a % 2 == 1, a), node(b % 2 == 1, b - one))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), levels), on)), lambda n: n.isNotNull())


class Places:
    """Whole-number places of range ends (even) and other positions (odd between two ends, or equal to an end) on each road."""

    def __init__(self, ranges: DataFrame, spots: DataFrame, road: str, lo: str, hi: str):
        ends = ranges.select(road, F.explode(F.array(lo, hi)).alias("_x"), F.lit(1).alias("_end"))
        marks = ends.unionByName(spots.select(road, "_x", F.lit(0).alias("_end"))).where("_x IS NOT NULL").groupBy(road, "_x").agg(F.max("_end").cast("long").alias("_end"))
        blocks = OrderedBlocks.of(marks, [road], ["_x"])
        self.road = road
        self.table = blocks.cumulative({"_k": ("sum", F.col("_end"), True)}).select(road, "_x", (F.col("_k") * 2 + 1 - F.col("_end")).alias("_place"))
        #: levels up to the one whose first node holds all places, from the largest number of marks on a road
        most = blocks.rows.groupBy(road).agg(F.sum("_end").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        self.levels = most.select(F.ceil(F.log2(F.col("n") * 2 + 2)).cast("int").alias("l")).scalar()

    def of(self, rows: DataFrame, x: str, name: str) -> DataFrame:
        """Rows with the place of column ``x``; rows without one go."""
        return rows.join(self.table.select(self.road, F.col("_x").alias(x), F.col("_place").alias(name)), [self.road, x])


def first_holding(places: Places, ranges: DataFrame, spots: DataFrame, lo: str, hi: str, row: str) -> DataFrame:
    """(road, ``_x``, row): the smallest ``row`` of the closed ranges that hold each distinct position."""
    road = places.road
    placed = places.of(places.of(ranges, lo, "_lo"), hi, "_hi").withColumn("_levels", places.levels).select(
        road, row, F.explode(_nodes(F.col("_lo"), F.col("_hi"), F.col("_levels"))).alias("_n"))
    level, node = F.col("_n.level"), F.col("_n.node")
    up = F.greatest(level - GRAIN, F.lit(0))
    parts = F.sequence(_shift("left", node, up), _shift("left", node + 1, up) - 1)
    nodes = placed.select(road, row, level.alias("_level"), F.explode(parts).alias("_node")).groupBy(road, "_level", "_node").agg(F.min(row).alias(row))
    met = (places.of(spots.select(road, "_x"), "_x", "_p").withColumn("_level", F.explode(F.sequence(F.lit(0), places.levels)))
           .withColumn("_node", _shift("right", F.col("_p"), F.least(F.col("_level"), F.lit(GRAIN)))))
    return met.join(nodes, [road, "_level", "_node"]).groupBy(road, "_x").agg(F.min(row).alias(row))


def first_starting(places: Places, ranges: DataFrame, spans: DataFrame, lo: str, row: str, after: str, upto: str) -> DataFrame:
    """(road, after, upto, row): the smallest ``row`` of the ranges that start after one position and no later than another."""
    road = places.road
    starts = places.of(ranges, lo, "_lo").groupBy(road, "_lo").agg(F.min(row).alias(row))
    nodes = (starts.withColumn("_level", F.explode(F.sequence(F.lit(0), places.levels))).withColumn("_node", _shift("right", F.col("_lo"), F.col("_level")))
             .groupBy(road, "_level", "_node").agg(F.min(row).alias(row)))
    wanted = places.of(places.of(spans.select(road, after, upto), after, "_a"), upto, "_b").withColumn("_levels", places.levels)
    parts = wanted.select(road, after, upto, F.explode(_nodes(F.col("_a") + 1, F.col("_b"), F.col("_levels"))).alias("_n")).select(
        road, after, upto, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    return attach(parts, nodes, [road, "_level", "_node"], "inner").groupBy(road, after, upto).agg(F.min(row).alias(row))


def count_between(spots: DataFrame, spans: DataFrame, road: str, n: str, lo: str, hi: str) -> DataFrame:
    """(road, lo, hi, ``n``): sum of ``n`` over the positions ``_x`` in each closed span; running sums, two look-ups a span."""
    ends = spans.select(road, F.explode(F.array(lo, hi)).alias("_x"), F.lit(0).cast("long").alias(n))
    marks = spots.select(road, "_x", F.col(n).cast("long").alias(n)).unionByName(ends).where("_x IS NOT NULL").groupBy(road, "_x").agg(F.sum(n).alias(n))
    run = OrderedBlocks.of(marks, [road], ["_x"]).cumulative({"_upto": ("sum", F.col(n), True)})
    low = run.select(road, F.col("_x").alias(lo), (F.col("_upto") - F.col(n)).alias("_before"))
    high = run.select(road, F.col("_x").alias(hi), "_upto")
    return spans.select(road, lo, hi).join(low, [road, lo]).join(high, [road, hi]).select(
        road, lo, hi, F.greatest(F.col("_upto") - F.col("_before"), F.lit(0)).alias(n))


def nearest_ends(ranges: DataFrame, spots: DataFrame, road: str, lo: str, hi: str, row: str) -> DataFrame:
    """(road, ``_x``, ``_left``, ``_right``): the closest range end at or before and the closest start at or after each position, as (at, smallest row)."""
    none = F.lit(None).cast(ranges.schema[row].dataType)
    at = lambda x, end, start: ranges.select(road, F.col(x).alias("_x"), end.alias("_e"), start.alias("_s"), F.lit(0).alias("_ask"))
    asked = spots.select(road, "_x", none.alias("_e"), none.alias("_s"), F.lit(1).alias("_ask"))
    marks = (at(hi, F.col(row), none).unionByName(at(lo, none, F.col(row))).unionByName(asked).where("_x IS NOT NULL")
             .groupBy(road, "_x").agg(F.min("_e").alias("_e"), F.min("_s").alias("_s"), F.max("_ask").alias("_ask")))
    here = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("at"), F.col(c).alias("row")))
    swept = OrderedBlocks.of(marks, [road], ["_x"]).cumulative({"_left": ("last", here("_e"), True), "_right": ("ahead", here("_s"), True)})
    return swept.where("_ask = 1").select(road, "_x", "_left", "_right")
