"""Fire product, analytics payload and dashboard as sets of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import analytics, fire


def fire_product(segments: DataFrame, samples: DataFrame, horizons: list[str]) -> DataFrame:
    """Statistics and class per segment and horizon, every segment present."""
    stats = fire.segment_statistics(samples, ["trecho_id", "horizonte"])
    return fire.segment_product(segments, stats, F.array(*[F.lit(h) for h in horizons]))


def analytics_payload(points: DataFrame, cycles: DataFrame, history: DataFrame, regions: DataFrame,
                      product: DataFrame | None = None, hourly: DataFrame | None = None) -> dict[str, DataFrame]:
    """One DataFrame per block of the analytics page; ``hourly`` are the hours of ``operators.analytics.hourly_by_region``."""
    esc = analytics.described(analytics.escalation(history), points)
    blocks = {
        "headline": analytics.headline(points, cycles), "series": analytics.series_span(cycles),
        "regional": analytics.regional_summary(points, regions), "unassigned": analytics.unassigned_points(points, regions),
        "escalation": analytics.escalation_counts(esc), "rising": analytics.rising(esc), "falling": analytics.falling(esc),
        "steady": analytics.steady(esc), "distributions": analytics.distributions(points),
        "bins": analytics.distribution_bins(points), "ops": analytics.operations(cycles), "recent": analytics.latest_cycles(cycles)}
    if hourly is not None:
        blocks["hourly"], blocks["hourly_totals"] = hourly, analytics.region_hour_totals(hourly)
    if product is not None:
        blocks["fire_horizons"] = fire.class_counts(product, ["horizonte"])
        blocks["fire_transitions"] = fire.transitions(fire.class_map(product))
    return blocks


def dashboard(points: DataFrame, product: DataFrame) -> dict[str, DataFrame]:
    return {"top_units": analytics.top_units(points), "by_region": analytics.region_matrix(points),
            "fire_offices": fire.office_matrix(product), "fire_top": fire.top_segments(product)}
