"""SQL names for the core formulas. They are SQL-bodied, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import EARTH_RADIUS_KM, RD_MATRIX, RF_LIMITS

_MATRIX = ", ".join(str(v) for row in RD_MATRIX for v in row)

SQL_FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE":
        f"{2 * EARTH_RADIUS_KM}D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2D), 2D) + cos(radians(lat1)) "
        "* cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2D), 2D))))",
    "cpc_index(intensity DOUBLE, ac96 DOUBLE, k DOUBLE) RETURNS DOUBLE":
        "CASE WHEN ac96 <= 0.5D OR intensity < 0D THEN 0D WHEN k <= 0D THEN NULL "
        "ELSE intensity / (k * pow(greatest(ac96, 0.5D), -0.9D)) END",
    "class_from_breaks(value DOUBLE, breaks ARRAY<DOUBLE>) RETURNS INT":
        "size(filter(breaks, b -> coalesce(value >= b, false)))",
    "risk_level(ra INT, icc INT) RETURNS INT":
        f"get(array({_MATRIX}), greatest(0, least(4, ra)) * 5 + greatest(0, least(4, icc)))",
    "rf_class(value DOUBLE) RETURNS STRING":
        "CASE WHEN value IS NULL OR isnan(value) THEN 'SEM_DADO' "
        f"WHEN value < {RF_LIMITS[0]}D THEN 'minimo' WHEN value <= {RF_LIMITS[1]}D THEN 'baixo' "
        f"WHEN value <= {RF_LIMITS[2]}D THEN 'medio' WHEN value <= {RF_LIMITS[3]}D THEN 'alto' ELSE 'critico' END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
