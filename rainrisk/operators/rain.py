"""Trailing rain windows, hour completeness and the frame-by-frame timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import WINDOW_HOURS
from ..functions import rain
from .scale import attach


def window_hours(hourly: DataFrame, target: Column, hours: int = 96, hour: str = "hr") -> DataFrame:
    """Keep the hours that end at the target; a range filter the scan can prune partitions with."""
    oldest = target - F.make_interval(hours=F.lit(hours - 1))
    return hourly.where((F.col(hour) >= oldest) & (F.col(hour) <= target))


def trailing_windows(hourly: DataFrame, keys: list[str], target: Column, hour: str = "hr", mm: str = "mm",
                     sizes: tuple[int, ...] = WINDOW_HOURS) -> DataFrame:
    """Intensity of the target hour and trailing sums per key in one pass; an absent hour adds nothing."""
    h = rain.hours_before(target, F.col(hour))
    t = rain.ticks(rain.clean_sentinel(F.col(mm)))
    sums = {"intensity_mmh": F.sum(F.when(h == 0, t))}
    sums |= {f"ac{n}h_mm": F.sum(F.when(h < n, t)) for n in sizes}
    out = window_hours(hourly, target, max(sizes), hour).groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    return out.select(*keys, *[rain.mm_from_ticks(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums])


def unit_windows(units: DataFrame, cell_windows: DataFrame, cell: list[str]) -> DataFrame:
    """Windows of the nearest grid cell per unit, zero where the cell never reported."""
    measures = [c for c in cell_windows.columns if c not in cell]
    return attach(units, cell_windows, cell).fillna(0.0, measures)


def hour_completeness(hours: DataFrame, target: Column, hour: str = "hr", ok: str | None = None) -> DataFrame:
    """One row: readable hours of 96, missing hours of the last 24 and 96."""
    kept = window_hours(hours if ok is None else hours.where(ok), target, 96, hour).groupBy(hour).agg(
        F.count(F.lit(1)).alias("_n"))
    h = rain.hours_before(target, F.col(hour))
    return kept.agg(F.count(F.lit(1)).cast("int").alias("files_ok"),
                    (F.lit(24) - F.count_if(h < 24)).cast("int").alias("missing_24h"),
                    (F.lit(96) - F.count(F.lit(1))).cast("int").alias("missing_96h"))


def mesh_complete_hours(hourly: DataFrame, mesh_size: Column | int, hour: str = "hr", cell: list[str] | None = None) -> DataFrame:
    """Hours whose number of cells equals the mesh; any other length counts as missing."""
    counted = hourly.select(hour, *(cell or [])).distinct() if cell else hourly
    size = F.lit(mesh_size) if isinstance(mesh_size, int) else mesh_size
    return counted.groupBy(hour).agg(F.count(F.lit(1)).alias("n_cells")).withColumn("ok", F.col("n_cells") == size)


def timeline_windows(hourly: DataFrame, keys: list[str], target: Column, frames: int = 96, hour: str = "hr",
                     mm: str = "mm") -> DataFrame:
    """Per key and each of the past ``frames`` hours: intensity, trailing 24 and 96 h sums.

    The hours are first summed per (key, hour), so a key has at most 96 rows when the
    window runs; sums stop at the oldest hour, as the series holds 96 hours only.
    """
    filled = (window_hours(hourly, target, 96, hour)
              .groupBy(*keys, hour).agg(F.sum(rain.ticks(rain.clean_sentinel(F.col(mm)))).alias("_t")))
    spine = (filled.select(*keys).distinct()
             .withColumn(hour, F.explode(F.sequence(target - F.expr("INTERVAL 95 HOURS"), target, F.expr("INTERVAL 1 HOUR")))))
    dense = spine.join(filled, [*keys, hour], "left").fillna(0, ["_t"])
    w = Window.partitionBy(*keys).orderBy(hour)
    back = lambda n: F.sum("_t").over(w.rowsBetween(-(n - 1), 0))
    return (dense.withColumns({"_24": back(24), "_96": back(96)})
            .where(F.col(hour) > target - F.make_interval(hours=F.lit(frames)))
            .select(*keys, hour, rain.mm_from_ticks(F.col("_t")).alias("intensity_mmh"),
                    rain.mm_from_ticks(F.col("_24")).alias("ac24h_mm"),
                    rain.mm_from_ticks(F.col("_96")).alias("ac96h_mm")))


def hourly_totals(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Sum of raw readings per key and UTC hour."""
    hour = F.date_trunc("hour", F.col(ts)).alias("hr")
    return readings.groupBy(*keys, hour).agg(
        (F.sum(rain.ticks(F.col(value))) / F.lit(float(rain.TICKS_PER_MM))).alias("mm"),
        F.count(F.lit(1)).alias("qtd"))


def sliding_accumulations(hourly: DataFrame, keys: list[str], hours: int, hour: str = "hr", mm: str = "mm") -> DataFrame:
    """Sum over every window of ``hours`` that advances by one hour (also valid on a stream)."""
    return (hourly.groupBy(*keys, F.window(hour, f"{hours} hours", "1 hour").alias("w"))
            .agg(F.sum(rain.ticks(F.col(mm))).alias("_t"))
            .select(*keys, F.col("w.end").alias("window_end"), rain.mm_from_ticks(F.col("_t")).alias("total_mm")))
