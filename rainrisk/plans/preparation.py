"""Unit generation, class assignment and the segment hub."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..operators import intervals, network, sequences


def generate_units(axes: DataFrame, critical: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Units by linear referencing.

    Sectors (``n_sr``) fill the merged critical ranges of a key, regular units
    (``n_utb``) its free ranges. ``axes`` has ``length``; critical ranges ``a, b, kind``.
    """
    merged = intervals.union_intervals(critical, keys)
    free = intervals.complement_intervals(merged, axes, keys)
    sectors = intervals.split_evenly(merged, wanted.withColumnRenamed("n_sr", "n"), keys).withColumn("tipo", F.lit("SR"))
    regular = intervals.split_evenly(free.withColumnsRenamed({"free0": "a", "free1": "b"}), wanted.withColumnRenamed("n_utb", "n"), keys)
    return sectors.unionByName(regular.withColumn("tipo", F.lit("UTB"))).select(
        *keys, "tipo", F.col("unit").alias("ordem_no_grupo"), "start", "stop")


def assign_classes(units: DataFrame, classified: DataFrame, quotas: DataFrame, keys: list[str], order: str, cls: str = "cls") -> DataFrame:
    """Suggested class by majority overlap, then official quotas by rank."""
    suggested = intervals.majority_class(units, classified, cls).withColumnRenamed(cls, "suggested")
    return sequences.allocate_quota(suggested, quotas, keys, "suggested", order)


def segment_hub(units: DataFrame, segments: DataFrame, key: str = "trecho_id") -> tuple[DataFrame, DataFrame]:
    """(segments with the roll-up of their units, one crosswalk row per unit)."""
    assigned = intervals.nearest_on_road(units, segments, key)
    hub = network.attach_rollup(segments, network.segment_rollup(assigned, key), key)
    return hub, assigned.select("ua_id", key, "dist_km")


def with_segment_ids(roads: DataFrame) -> DataFrame:
    return roads.withColumn("trecho_id", text.segment_id(*[F.col(c) for c in ("rodovia", "km_ini", "km_fim", "orientacao", "municipio")]))
