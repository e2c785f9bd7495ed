"""Rain index, classes and the risk matrix as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CPC_EXPONENT, DRY_AC96_MM, LEVELS, RD_MATRIX


def cpc(intensity: Column, ac96: Column, k_geo: Column) -> Column:
    """Intensity over the critical envelope K * ac96^-0.9."""
    envelope = k_geo * F.pow(F.greatest(ac96, F.lit(DRY_AC96_MM)), F.lit(CPC_EXPONENT))
    return (F.when((ac96 <= DRY_AC96_MM) | (intensity < 0), F.lit(0.0))
            .when(envelope <= 0, F.lit(None).cast("double"))
            .otherwise(intensity / envelope))


def class_from_breaks(value: Column, breaks: Column) -> Column:
    """Number of ascending thresholds reached; null value is class 0."""
    return F.size(F.filter(breaks, lambda b: F.coalesce(value >= b, F.lit(False))))


def combine(ra: Column, icc: Column) -> Column:
    """Matrix lookup, both inputs clamped to 0..4."""
    flat = F.array(*[F.lit(v) for row in RD_MATRIX for v in row])
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(4), c))
    return F.get(flat, (clamp(ra) * 5 + clamp(icc)).cast("int"))


def rd_distribution(ra_dist: Column, icc: Column) -> Column:
    """``map<int,int>`` RA class -> units becomes RD level -> units; non-positive counts drop out."""
    entries = F.filter(F.map_entries(ra_dist), lambda e: e["value"] > 0)

    def units_at(level: int) -> Column:
        return F.aggregate(entries, F.lit(0), lambda acc, e: acc + F.when(
            combine(e["key"], icc) == level, e["value"].cast("int")).otherwise(F.lit(0)))

    levels = F.array(*[F.struct(F.lit(i).alias("key"), units_at(i).alias("value")) for i in range(5)])
    return F.map_from_entries(F.filter(levels, lambda e: e["value"] > 0))


def worst_level(dist: Column) -> Column:
    return F.coalesce(F.array_max(F.map_keys(dist)), F.lit(0))


def max_class(dist: Column) -> Column:
    """Highest class with at least one unit."""
    return F.array_max(F.map_keys(F.map_filter(dist, lambda k, v: v > 0)))


def level_label(rd: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in LEVELS]), rd.cast("int"))


def heat_intensity(rd: Column, ac96: Column) -> Column:
    rain = F.least(F.coalesce(ac96, F.lit(0.0)) / F.lit(200.0), F.lit(1.0)) * F.lit(0.6)
    return F.greatest(F.lit(0.15), F.coalesce(rd, F.lit(0)) / F.lit(4.0), rain)


def level_vector(levels: Column) -> Column:
    """``map<string,int>`` level -> count to an array of five counts."""
    return F.transform(F.sequence(F.lit(0), F.lit(4)),
                       lambda i: F.coalesce(F.try_element_at(levels, i.cast("string")), F.lit(0)))
