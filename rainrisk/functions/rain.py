"""Rain arithmetic. Sums run on integer ticks of 0.0001 mm, so that a total does
not depend on the order in which a cluster adds the hours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CORRECTION, DEGRADED_MISSING_24H, SATELLITE_LAG_H

TICKS_PER_MM = 10000


def ticks(mm: Column) -> Column:
    return F.round(mm * F.lit(float(TICKS_PER_MM))).cast("long")


def mm_from_ticks(total: Column, digits: int = 2) -> Column:
    """Half-up rounding in integer arithmetic, then one division."""
    unit = TICKS_PER_MM // 10 ** digits
    return F.floor((total + F.lit(unit // 2)) / F.lit(unit)).cast("double") / F.lit(float(10 ** digits))


def clean_sentinel(mm: Column) -> Column:
    return F.when((mm > 1e30) | (mm < 0), F.lit(0.0)).otherwise(mm)


def satellite_target_hour(now: Column) -> Column:
    return F.date_trunc("hour", now - F.expr(f"INTERVAL {SATELLITE_LAG_H} HOURS"))


def gauge_target_hour(now: Column) -> Column:
    return F.date_trunc("hour", now) - F.expr("INTERVAL 1 HOUR")


def hours_before(target: Column, hour: Column) -> Column:
    """0 for the target hour, 1 for the hour before it, ..."""
    return ((F.unix_timestamp(target) - F.unix_timestamp(hour)) / 3600).cast("int")


def data_status(missing_24h: Column, limit: int = DEGRADED_MISSING_24H) -> Column:
    return F.when(missing_24h < limit, F.lit("ok")).otherwise(F.lit("degraded"))


def source_label(gauge_units: Column, total_units: Column, gauges: str = "GAUGES", satellite: str = "SATELLITE") -> Column:
    return (F.when(gauge_units == 0, F.lit(satellite))
            .when(gauge_units < total_units, F.lit(f"{gauges} + {satellite}"))
            .otherwise(F.lit(gauges)))


def compose_windows(ac72: Column, ac18: Column, ac96: Column, ac24: Column, prev24: Column, prev6: Column) -> dict[str, Column]:
    """Observed + forecast windows when both forecasts exist, else observed only."""
    both = prev24.isNotNull() & prev6.isNotNull()
    return {
        "ac96h_mm": F.when(both, F.round(ac72 + prev24, 2)).otherwise(ac96),
        "ac24h_mm": F.when(both, F.round(ac18 + prev6, 2)).otherwise(ac24),
        "fonte_chuva": F.when(both, F.lit("WRF")).otherwise(F.lit("OBS_ONLY")),
    }


def monotonic(ac18: Column, ac24: Column, ac72: Column, ac96: Column) -> dict[str, Column]:
    """Windows grow with their length: 18 <= 24 <= 72 <= 96 h."""
    a24 = F.greatest(ac24, ac18)
    a72 = F.greatest(ac72, a24)
    return {"ac18h_mm": ac18, "ac24h_mm": F.round(a24, 2), "ac72h_mm": F.round(a72, 2),
            "ac96h_mm": F.round(F.greatest(ac96, a72), 2)}


def anchor_weight(d_min: Column, radius_km: float = CORRECTION["radius_km"],
                  max_weight: float = CORRECTION["max_weight"]) -> Column:
    return F.lit(max_weight) * F.greatest(F.lit(0.0), F.lit(1.0) - d_min / F.lit(radius_km))


def alternative_windows(ac24: Column) -> dict[str, Column]:
    """Feeds that only carry a daily total: four equal days, mean hourly intensity."""
    return {"ac24h_mm": ac24, "ac96h_mm": ac24 * F.lit(4.0), "intensity_mmh": ac24 / F.lit(24.0)}


def needs_refetch(hour: Column, now: Column, last_check: Column, ok: Column,
                  fresh_h: int = 4, stale_h: int = 24, recheck_h: int = 24) -> Column:
    """Late-data policy by age: absent or fresh hours always, old ones never, between once a day."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(hour)) / 3600
    since = (F.unix_timestamp(now) - F.unix_timestamp(last_check)) / 3600
    return (F.when(~F.coalesce(ok, F.lit(False)), F.lit(True))
            .when(age < fresh_h, F.lit(True))
            .when(age >= stale_h, F.lit(False))
            .otherwise(last_check.isNull() | (since > recheck_h)))
