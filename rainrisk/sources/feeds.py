"""Readers for gauge, station, camera and alternative feeds (JSON rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import CORRECTION, STATION_BOX
from ..functions import text
from ..operators.gauges import last_per_key

GAUGE_ROW = ("latitude string, longitude string, value string, max_date string, qtd string, measurement_gap string, "
             "station_name string, station_owner string, city string, station_prefix_id string, date string")
ALTERNATIVE_ROW = ("codigo string, id string, nome string, latitude string, lat string, longitude string, lon string, "
                   "municipio string, chuva_mm string, chuva string, horas string, datahora string, data_hora string")
CAMERA_ROW = ("id bigint, rodovia string, km string, nome string, local string, lat string, lng string, status string, "
              "sentido string")


def json_rows(spark: SparkSession, path: str, row: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a document ``{key: [...]}`` or of a bare list.

    A bare list becomes one record per element in multi-line mode, so its fields sit
    at the top level next to the (then null) wrapper keys.
    """
    wrapped = ", ".join(f"{k} array<struct<{_struct(row)}>>" for k in keys)
    docs = spark.read.schema(f"{wrapped}, {row}").option("multiLine", True).json(path)
    names = [c.split()[0] for c in row.split(", ")]
    inner = F.coalesce(*[F.when(F.size(k) > 0, F.col(k)) for k in keys], F.array(F.struct(*names)))
    return docs.select(F.explode(inner).alias("r")).select("r.*")


def _struct(row: str) -> str:
    return ",".join(":".join(c.split(" ", 1)) for c in row.split(", "))


def in_station_box(lat: Column, lon: Column) -> Column:
    (a, b), (c, d) = STATION_BOX["lat"], STATION_BOX["lon"]
    return (lat > a) & (lat < b) & (lon > c) & (lon < d)


def gauges_now(rows: DataFrame) -> DataFrame:
    """Stations with a valid place and a value of at least zero; coverage = readings x gap."""
    out = rows.select(
        F.col("station_prefix_id").alias("station_id"), text.to_float(F.col("latitude")).alias("lat"),
        text.to_float(F.col("longitude")).alias("lon"), text.to_float(F.col("value")).alias("value_mm"),
        text.parse_timestamp(F.col("max_date")).alias("observed_at"),
        (text.to_float(F.col("qtd")) * text.to_float(F.col("measurement_gap")) / F.lit(60.0)).alias("coverage_hours"),
        *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("station_name", "name"), ("station_owner", "owner"), ("city", "city"))])
    return out.where(in_station_box(F.col("lat"), F.col("lon")) & (F.col("value_mm") >= 0))


def fresh(stations: DataFrame, now: Column, hours: int = CORRECTION["max_age_h"]) -> DataFrame:
    """Stations without a time, or seen within the last hours."""
    seen = F.col("observed_at")
    return stations.where(seen.isNull() | (seen >= now - F.make_interval(hours=F.lit(hours))))


def station_list(rows: DataFrame, order: str) -> DataFrame:
    """Station id to place; the last valid row of an id wins."""
    valid = rows.select(F.col("station_prefix_id").alias("station_id"), text.to_float(F.col("latitude")).alias("lat"),
                        text.to_float(F.col("longitude")).alias("lon"), F.col(order))
    valid = valid.where(F.col("station_id").isNotNull() & in_station_box(F.col("lat"), F.col("lon")))
    return last_per_key(valid, ["station_id"], order).select("station_id", "lat", "lon")


def gauge_hours(rows: DataFrame, order: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Hourly value per station: known hour, at least one reading, finite and not negative; last row wins."""
    value = text.to_float(F.col("value"))
    valid = rows.select(F.col("station_prefix_id").alias("station_id"), text.parse_gauge_hour(F.col("date")).alias("hr"),
                        value.alias("mm"), F.coalesce(text.to_int(F.col("qtd")), F.lit(0)).alias("qtd"), F.col(order))
    valid = valid.where(F.col("station_id").isNotNull() & F.col("hr").isNotNull() & (F.col("qtd") > 0)
                        & (F.col("mm") >= 0) & (F.col("mm") < F.lit(float("inf"))))
    if start is not None:
        valid = valid.where((F.col("hr") >= start) & (F.col("hr") <= end))
    return last_per_key(valid, ["station_id", "hr"], order).select("station_id", "hr", "mm", "qtd")


def alternative_gauges(rows: DataFrame) -> DataFrame:
    """Second feed with other field names and four date formats; rows at (0, 0) or with bad numbers drop out."""
    number = lambda *names: F.coalesce(*[F.col(n) for n in names], F.lit("0")).try_cast("double")
    when = text.parse_first_format(F.coalesce("datahora", "data_hora"), (
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm"))
    out = rows.select(
        F.coalesce("codigo", "id", F.lit("")).alias("station_id"), F.coalesce("nome", F.lit("")).alias("name"),
        number("latitude", "lat").alias("lat"), number("longitude", "lon").alias("lon"), "municipio",
        number("chuva_mm", "chuva").alias("value_mm"), F.coalesce("horas", F.lit("1")).try_cast("int").alias("hours"),
        when.alias("observed_at"))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("value_mm").isNotNull() & F.col("hours").isNotNull()
    return out.where(known & ~((F.col("lat") == 0) & (F.col("lon") == 0)))


def cameras(rows: DataFrame) -> DataFrame:
    """Camera list with label, stream path and state flags, sorted by road, km, id."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    road, km = clean("rodovia"), clean("km")
    label = (F.when((road == "") & (km == ""), F.coalesce(F.nullif("nome", F.lit("")), F.concat(F.lit("Câmera "), F.col("id").cast("string"))))
             .when(road == "", km).when(km == "", road).otherwise(F.concat(road, F.lit(" · "), km)))
    status = F.coalesce(F.col("status").try_cast("int"), F.lit(0))
    return rows.select(
        "id", road.alias("rodovia"), km.alias("km"), clean("nome").alias("nome"), clean("local").alias("local"),
        F.coalesce(text.to_float(F.col("lat")), F.lit(0.0)).alias("lat"), F.coalesce(text.to_float(F.col("lng")), F.lit(0.0)).alias("lng"),
        status.alias("status"), clean("sentido").alias("sentido"), label.alias("label"),
        F.concat(F.lit("cam_"), F.col("id").cast("string"), F.lit("/stream.m3u8")).alias("stream_path"),
        (status == 2).alias("maintenance"), (status == 1).alias("online")).orderBy("rodovia", "km", "id")
