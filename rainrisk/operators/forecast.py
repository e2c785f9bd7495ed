"""Forecast run choice and accumulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FORECAST
from .scale import attach


def choose_run(grid: DataFrame, t0: Column) -> DataFrame:
    """Newest run at or before t0 that holds t0, t0+6 and t0+24 (one row, or none)."""
    lead = (F.unix_timestamp(t0) - F.unix_timestamp("run")) / 3600
    limit = FORECAST["max_lead_h"] - max(FORECAST["horizons"])
    base = F.floor(F.unix_timestamp(t0) / F.lit(FORECAST["run_step_h"] * 3600)) * F.lit(FORECAST["run_step_h"] * 3600)
    back = (base - F.unix_timestamp("run")) / 3600
    valid = (F.unix_timestamp("valid") - F.unix_timestamp(t0)) / 3600
    wanted = [0, *FORECAST["horizons"]]
    # the plain range on run prunes the scan; the exact limits follow
    oldest = t0 - F.make_interval(hours=F.lit((FORECAST["lookback_runs"] + 1) * FORECAST["run_step_h"]))
    recent = grid.where((F.col("run") <= t0) & (F.col("run") > oldest))
    return (recent.where((lead >= 0) & (lead <= limit) & (back <= FORECAST["lookback_runs"] * FORECAST["run_step_h"])
                       & (F.unix_timestamp("run") % F.lit(FORECAST["run_step_h"] * 3600) == 0) & valid.isin(wanted))
            .groupBy("run").agg(*[F.max((valid == w).cast("int")).alias(f"_{w}") for w in wanted])
            .where(" AND ".join(f"_{w} = 1" for w in wanted))
            .agg(F.max("run").alias("run")).where("run IS NOT NULL"))


def accumulate(grid: DataFrame, t0: Column, cell: list[str], acc: str = "acc_mm") -> DataFrame:
    """Rain of the next 6 and 24 h per cell of the chosen run, never negative.

    The run is a one-row table that joins on equality, so only its rows are read on.
    """
    at = lambda h: F.max(F.when(F.col("valid") == t0 + F.make_interval(hours=F.lit(h)), F.col(acc)))
    moments = [t0 + F.make_interval(hours=F.lit(h)) for h in (0, *FORECAST["horizons"])]
    rows = grid.where(F.col("valid").isin(moments)).join(choose_run(grid, t0), "run").groupBy("run", *cell).agg(
        at(0).alias("_0"), *[at(h).alias(f"_{h}") for h in FORECAST["horizons"]])
    return rows.select("run", *cell, *[
        F.round(F.greatest(F.lit(0.0), F.col(f"_{h}") - F.col("_0")), 2).alias(f"ac{h}h_prev") for h in FORECAST["horizons"]])


def attach_forecast(units: DataFrame, forecast: DataFrame, on: list[str]) -> DataFrame:
    """Left join of forecast sums as ``prev6h_mm``, ``prev24h_mm``; null when absent."""
    renamed = forecast.select(*on, F.col("ac6h_prev").alias("prev6h_mm"), F.col("ac24h_prev").alias("prev24h_mm"))
    return attach(units, renamed, on)


def forecast_view(units: DataFrame) -> DataFrame:
    """Forecast rows per unit: sums and mean intensity of the next day."""
    return units.withColumn("intensity_prev_mmh", F.round(F.col("prev24h_mm") / F.lit(24.0), 1))
