"""Writers: feeds, products, stores and reports. Every write replaces whole partitions or appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import FIRE_HORIZONS
from ..functions import fire, geo, rain
from ..operators.scale import with_row

HAZARD_LABELS = {"geo": "Encosta", "hidro": "Inundação"}
# --- fixed values: accepted channel names -----------------------------------
HAZARD_SYNONYMS = {"geo": ("geo",), "encosta": ("geo",), "hidro": ("hidro",), "inundacao": ("hidro",),
                   "all": ("geo", "hidro"), "": ("geo", "hidro")}


def select_channel(points: DataFrame, hazard: str | None) -> DataFrame:
    """One channel by any of its names, or both."""
    try:
        return points.where(F.col("hazard").isin(*HAZARD_SYNONYMS[(hazard or "").strip().lower()]))
    except KeyError:
        raise ValueError(f"unknown channel {hazard!r}") from None


def at_least(points: DataFrame, min_rd: int) -> DataFrame:
    if min_rd not in range(5):
        raise ValueError("min_rd must be 0..4")
    return points.where(F.coalesce("rd", F.lit(0)) >= min_rd)


def public_properties(points: DataFrame, drop: tuple[str, ...] = ("geometry", "geometry_type")) -> DataFrame:
    """Feed columns with channel label and monitoring state."""
    label = F.coalesce(*[F.when(F.col("hazard") == k, F.lit(v)) for k, v in HAZARD_LABELS.items()], F.col("hazard"))
    state = F.when(F.col("source") == "NO_DATA", F.lit("indisponivel")).otherwise(F.lit("ativo"))
    return points.select(F.col("hazard"), label.alias("hazard_label"),
                         *[c for c in points.columns if c not in ("hazard", *drop)], state.alias("monitoramento"))


def feature_lines(points: DataFrame, hazard: str | None = None, min_rd: int = 0) -> DataFrame:
    """One GeoJSON feature per row as text."""
    kept = at_least(select_channel(points, hazard), min_rd)
    geometry = (geo.ring_to_geojson(F.col("geometry"), F.col("geometry_type")) if "geometry" in kept.columns
                else F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))))
    names = public_properties(kept).columns
    props = public_properties(kept.withColumn("geometry_json", geometry)).select(
        "geometry_json", F.to_json(F.struct(*[c for c in names])).alias("p"))
    shape = F.coalesce("geometry_json", F.lit("null"))
    return props.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.col("p"), F.lit("}")).alias("value"))


def feed_header(points: DataFrame, hazard: str | None = None, min_rd: int = 0) -> DataFrame:
    """One row with the number of features and the levels in the feed."""
    kept = at_least(select_channel(points, hazard), min_rd)
    return kept.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce("rd", F.lit(0)) == i).alias(f"rd{i}") for i in range(5)])


def write_feed(points: DataFrame, path: str, hazard: str | None = None, min_rd: int = 0) -> None:
    feature_lines(points, hazard, min_rd).write.mode("overwrite").text(path + "/features")
    feed_header(points, hazard, min_rd).write.mode("overwrite").json(path + "/header")


def observed_or_first(product: DataFrame) -> DataFrame:
    """Rows of the observed horizon, or of the first horizon in name order when there is none.

    The choice is one row, taken from a distributed minimum, and joins on equality.
    """
    order = F.when(F.col("horizonte") == FIRE_HORIZONS[0], F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("horizonte")))
    pick = product.agg(F.min_by("horizonte", order).alias("horizonte"))
    return product.join(pick, "horizonte", "left_semi")


def write_fire_product(product: DataFrame, path: str) -> None:
    """All horizons partitioned by date and horizon; plus the observed layer on its own."""
    product.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_referencia", "horizonte").parquet(path + "/all")
    observed_or_first(product).write.mode("overwrite").parquet(path + "/observed")


def write_fire_exports(product: DataFrame, path: str) -> None:
    """JSON per horizon slug and a table without geometry."""
    product.withColumn("slug", fire.horizon_slug(F.col("horizonte"), drop_spaces=True)).write.mode("overwrite").partitionBy("slug").json(path + "/horizons")
    product.drop("geometry").write.mode("overwrite").csv(path + "/table", header=True)


def sample_documents(samples: DataFrame) -> DataFrame:
    """One document per mesh and hour: header and values in mesh order with 4 decimals.

    A document is one list by contract; its length is the number of units of a mesh.
    """
    value = rain.mm_from_ticks(rain.ticks(F.col("mm")), 4)
    packed = samples.groupBy("mesh", "hour").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(
        F.collect_list(F.struct("position", value.alias("v")))).alias("_s"))
    return packed.select("mesh", "hour", "n", F.transform("_s", lambda s: s["v"]).alias("samples"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Replace only the hours present; an empty batch is refused."""
    if samples.isEmpty():
        raise ValueError("refusing to write an empty sample set")
    docs = sample_documents(samples).withColumns({"mesh_key": F.col("mesh"), "hour_key": F.date_format("hour", "yyyyMMddHH")})
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mesh_key", "hour_key").json(path)


def compact_tail(rows: DataFrame, keep: int, order: str, tie: str) -> DataFrame:
    """Newest ``keep`` rows."""
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(keep)


def append_cycle(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def report_rows(points: DataFrame, n: int = 10) -> DataFrame:
    from ..operators.network import tagged_report

    return tagged_report(points, n)


def write_report(points: DataFrame, path: str, n: int = 10) -> None:
    """CSV of the worst units per channel; at most 2n rows, hence one file."""
    report_rows(points, n).orderBy("hazard", "posicao").coalesce(1).write.mode("overwrite").csv(path, header=True)


def alert_lines(alerts: DataFrame, first: int = 50) -> DataFrame:
    """Text lines of the worst alerts with their place in the list."""
    order = [F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), F.col("ua_id"), F.col("hazard")]
    top = alerts.orderBy(*order).limit(first)
    # at most ``first`` rows reach this window
    place = F.row_number().over(Window.orderBy(*order))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("- ["), F.col("ua_id").cast("string"), F.lit("] RD"), F.col("rd").cast("string"), F.lit(" ("), blank("nivel"),
                    F.lit(") | RA"), blank("ra"), F.lit(" | 24h="), blank("ac24h_mm"), F.lit("mm 96h="), blank("ac96h_mm"),
                    F.lit("mm | "), blank("region_name"))
    return top.select(place.alias("line_no"), line.alias("line"))


def alert_message(alerts: DataFrame, threshold: int = 3, first: int = 50) -> DataFrame:
    """One row: subject and body; the body holds the first lines and says how many more there are."""
    n = alerts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rd"), F.lit(0)).alias("max_rd"))
    body = alert_lines(alerts, first).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("_b"))
    out = with_row(n, body)
    more = F.when(F.col("n") > first, F.concat(F.lit("\n... (+"), (F.col("n") - first).cast("string"), F.lit(" units)"))).otherwise(F.lit(""))
    return out.select(F.format_string(f"%d unit(s) at risk (RD>={threshold}) - max RD%d", "n", "max_rd").alias("subject"),
                      F.concat("_b", more).alias("body"), "n")


#: names of a zone in the notification payload (wire format) and the column each is read from
ZONE_FIELDS = {"id": "ua_id", "nome": "nome", "rodovia": "sigla_rodovia", "km": "km", "rd": "rd", "nivel": "nivel", "ra": "ra", "lat": "lat", "lon": "lon",
               "ac24h_mm": "ac24h_mm", "ac96h_mm": "ac96h_mm", "region": "region_name"}


def alert_zones(alerts: DataFrame, first: int = 100) -> DataFrame:
    """One row ``zones``: the worst alerts as an array of structs, worst first; columns the table lacks are null."""
    order = [F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), F.col("ua_id"), F.col("hazard")]
    place = F.struct((-F.col("rd")).alias("r"), (-F.coalesce("ac96h_mm", F.lit(0.0))).alias("a"), "ua_id", "hazard")
    zone = F.struct(*[(F.col(c) if c in alerts.columns else F.lit(None).cast("string")).alias(n) for n, c in ZONE_FIELDS.items()])
    top = alerts.orderBy(*order).limit(first).select(F.struct(place.alias("place"), zone.alias("zone")).alias("z"))
    return top.agg(F.transform(F.sort_array(F.collect_list("z")), lambda z: z["zone"]).alias("zones"))


def alert_notice(alerts: DataFrame, at: Column, source: Column, status: Column, channel: str | None = None, system: str = "", roads: str = "",
                 threshold: int = 3, first: int = 50, zones: int = 100) -> DataFrame:
    """One row of a notification of a cycle: ``subject``, ``text`` with its header lines, and ``payload``, the JSON of a web hook.

    The text lists the ``first`` worst alerts and counts the rest, the payload carries ``zones`` of them and the whole count.
    ``system`` and ``roads`` name the sender and its roads; without alerts the lists are empty and the count is 0.
    """
    label = HAZARD_LABELS.get(channel or "", "")
    head = " ".join(x for x in (f"[{system}]" if system else "", f"[{label}]" if label else "") if x)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")
    lines = [F.lit("Alert - contingency plan" + (f" ({roads})" if roads else "")), F.lit(f"Channel: {label or 'all'}"), F.concat(F.lit("Time (UTC): "), stamp),
             F.concat(F.lit("Rain source: "), F.coalesce(source, F.lit("-")), F.lit(" (status: "), F.coalesce(status, F.lit("-")), F.lit(")")), F.lit(""),
             F.concat(F.col("n").cast("string"), F.lit(f" unit(s) with dynamic risk >= {threshold}:")), F.lit(""), F.col("body")]
    message = with_row(alert_message(alerts, threshold, first), alert_zones(alerts, zones))
    out = message.select((F.concat(F.lit(head + " "), "subject") if head else F.col("subject")).alias("subject"), F.concat_ws("\n", *lines).alias("text"), "n", "zones")
    payload = F.struct(F.concat_ws("\n", "subject", "text").alias("text"), "subject", stamp.alias("timestamp"), F.col("n").alias("count"), F.lit(threshold).alias("threshold"), "zones")
    return out.select("subject", "text", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def channel_extract(units: DataFrame, hazard: str) -> DataFrame:
    """Units of one channel: columns of the other channel dropped, sorted by id."""
    other = ("RAHID", "icc_hid_thresholds", "trecho_critico_hid") if hazard == "geo" else ("RAGEO", "icc_geo_thresholds", "trecho_critico_geo")
    return units.drop(*other).withColumn("hazard", F.lit(hazard)).orderBy("ua_id")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """A one-row aggregate as JSON text."""
    stats.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def run_record(df: DataFrame, step: str, day: Column, outcome: str) -> DataFrame:
    """One status row of a step and date, with the number of rows produced."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(step).alias("step"), day.alias("day"), F.lit(outcome).alias("outcome"), "rows")

