"""Fire-risk value checks and classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import RF_LIMITS, RF_NO_DATA, RF_RANK


def valid_rf(value: Column) -> Column:
    """Finite values in 0..5, capped at 1; anything else is null."""
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= 5)
    return F.when(ok, F.least(value, F.lit(1.0)))


def rf_class(value: Column) -> Column:
    l1, l2, l3, l4 = RF_LIMITS
    return (F.when(value.isNull() | F.isnan(value), F.lit(RF_NO_DATA))
            .when(value < l1, F.lit("minimo")).when(value <= l2, F.lit("baixo"))
            .when(value <= l3, F.lit("medio")).when(value <= l4, F.lit("alto"))
            .otherwise(F.lit("critico")))


def rf_rank(name: Column) -> Column:
    """1 (lowest) to 5; null for the class without data."""
    chain = F.when(name == "minimo", F.lit(RF_RANK["minimo"]))
    for key in ("baixo", "medio", "alto", "critico"):
        chain = chain.when(name == key, F.lit(RF_RANK[key]))
    return chain


def horizon_slug(name: Column, drop_spaces: bool = False) -> Column:
    slug = F.lower(F.replace(name, F.lit("+"), F.lit("")))
    return F.replace(slug, F.lit(" "), F.lit("")) if drop_spaces else slug
