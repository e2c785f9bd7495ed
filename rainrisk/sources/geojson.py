"""GeoJSON readers for units, regions, axes and fire products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import geo, text
from ..operators.risk import UNIT_COMMON, UNIT_GEO, UNIT_HID, default_regions
from .tables import exists

_UNIT_TYPES = {"regiao_id": "int", "extensao_km": "double", "ordem_no_grupo": "int", "km_inicial": "double", "km_final": "double",
               "centroide_lon": "double", "centroide_lat": "double", "buffer_lateral_m": "int", "RAGEO": "int", "RAHID": "int",
               "icc_geo_thresholds": "thresholds", "icc_hid_thresholds": "thresholds",
               "trecho_critico_geo": "bool", "trecho_critico_hid": "bool"}


def features(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One row per feature: string properties, geometry type and coordinates as JSON text."""
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.type", "f.geometry.coordinates")


def _rings(kind: str, coordinates: str = "coordinates"):
    """Rings or lines of the four geometry types as ``array<array<struct<lat,lon>>>``."""
    pts = "array<array<double>>"
    parse = lambda schema: F.from_json(F.col(coordinates), schema)
    k = F.col(kind)
    lines = (F.when(k == "LineString", F.array(parse(pts)))
             .when(k.isin("Polygon", "MultiLineString"), parse(f"array<{pts}>"))
             .when(k == "MultiPolygon", F.transform(parse(f"array<array<{pts}>>"), lambda poly: poly[0])))
    lines = F.when(k == "Polygon", F.slice(lines, 1, 1)).otherwise(lines)
    return F.transform(lines, geo.swap_axes)


def units(spark: SparkSession, path: str, hazard: str) -> DataFrame:
    """Analysis units of one channel; features without at least two vertices are left out."""
    names = list(UNIT_COMMON + (UNIT_GEO if hazard == "geo" else UNIT_HID))
    raw = features(spark, path, names).withColumn("_rings", _rings("type"))
    cast = {"int": text.to_int, "double": text.to_float, "bool": text.to_bool, "thresholds": text.parse_thresholds}
    cols = [cast[_UNIT_TYPES[n]](F.col(n)).alias(n) if n in _UNIT_TYPES else F.col(n) for n in names]
    ring = F.when(F.col("type") == "MultiLineString", F.flatten("_rings")).otherwise(geo.largest(F.col("_rings")))
    out = raw.where(F.size("_rings") > 0).select(
        *cols, ring.alias("geometry"), F.when(F.col("type").endswith("Polygon"), "polygon").otherwise("polyline").alias("geometry_type"))
    mid = lambda a: F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p[a]) / F.size("geometry")
    return out.where(F.size("geometry") >= 2).withColumns({
        "lat": F.coalesce("centroide_lat", mid("lat")), "lon": F.coalesce("centroide_lon", mid("lon")), "hazard": F.lit(hazard)})


def regions(spark: SparkSession, path: str, axes: DataFrame | None = None) -> DataFrame:
    """Regions with old or new attribute names; the largest ring of a MultiPolygon."""
    names = ["regiao_id", "id", "regiao_nome", "nome", "sigla_rodovia", "rodovia", "k_geo", "cpc_breaks", "hid24h_breaks"]
    raw = features(spark, path, names).withColumn("_rings", _rings("type"))
    out = raw.select(
        F.coalesce(text.to_int(F.col("regiao_id")), text.to_int(F.col("id"))).alias("regiao_id"),
        F.coalesce("regiao_nome", "nome").alias("regiao_nome"), F.coalesce("sigla_rodovia", "rodovia").alias("sigla_rodovia"),
        text.to_float(F.col("k_geo")).alias("k_geo"), text.parse_thresholds(F.col("cpc_breaks")).alias("cpc_breaks"),
        text.parse_thresholds(F.col("hid24h_breaks")).alias("hid24h_breaks"), geo.largest(F.col("_rings")).alias("polygon"))
    out = out.where(F.col("regiao_id").isNotNull())
    known = default_regions(spark).select("regiao_id", *[F.col(c).alias(f"_{c}") for c in ("k_geo", "cpc_breaks", "hid24h_breaks")])
    out = out.join(known, "regiao_id", "left").withColumns(
        {c: F.coalesce(c, f"_{c}") for c in ("k_geo", "cpc_breaks", "hid24h_breaks")}).drop("_k_geo", "_cpc_breaks", "_hid24h_breaks")
    if axes is None:
        return out.withColumn("eixo", F.array().cast("array<struct<lat:double,lon:double>>"))
    return out.join(axes, "regiao_id", "left")


def axes(spark: SparkSession, path: str) -> DataFrame:
    """Axis vertices per region, several lines flattened; the last feature of a region wins."""
    raw = features(spark, path, ["regiao_id", "id"]).withColumn("_rings", _rings("type")).withColumn("_o", F.monotonically_increasing_id())
    rows = raw.select(F.coalesce(text.to_int(F.col("regiao_id")), text.to_int(F.col("id"))).alias("regiao_id"),
                      F.flatten("_rings").alias("eixo"), "_o").where(F.col("regiao_id").isNotNull())
    return rows.groupBy("regiao_id").agg(F.max_by("eixo", "_o").alias("eixo"))


def regions_or_default(spark: SparkSession, *paths: str) -> DataFrame:
    """First file that exists, else the built-in rectangles; they stand in only for files of the local or default file system.

    A path with a scheme of its own was configured on purpose, so its absence is an error.
    """
    for path in paths:
        if path and exists(spark, path):
            return regions(spark, path)
        if path and "://" in path:
            raise FileNotFoundError(path)
    return default_regions(spark)


def fire_product(spark: SparkSession, path: str, segments: DataFrame | None = None) -> DataFrame:
    """Fire classes of one file; the no-data product of the segment table when the file is missing."""
    from ..operators.fire import without_product

    if not exists(spark, path):
        if segments is None:
            raise FileNotFoundError(path)
        return without_product(segments)
    names = ["trecho_id", "rodovia", "regional", "horizonte", "rf_classe", "rf_valor", "rf_p90", "rf_media"]
    raw = features(spark, path, names)
    return raw.select("trecho_id", "rodovia", "regional", "horizonte", "rf_classe",
                      *[text.to_float(F.col(c)).alias(c) for c in ("rf_valor", "rf_p90", "rf_media")])
