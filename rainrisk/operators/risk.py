"""Risk per unit and channel, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import NO_RA, OUT_OF_COVERAGE, PROTOCOL, REGIONS
from ..functions import rain, risk, text
from .gauges import correction_summary
from .scale import constant_table, with_row

REGION_SCHEMA = ("regiao_id int, regiao_nome string, sigla_rodovia string, k_geo double, cpc_breaks array<double>, "
                 "hid24h_breaks array<double>, polygon array<struct<lat:double,lon:double>>, "
                 "eixo array<struct<lat:double,lon:double>>")
UNIT_COMMON = ("ua_id", "regiao_id", "regiao_nome", "sigla_rodovia", "escala", "tipo", "extensao_km", "ordem_no_grupo",
               "km_inicial", "km_final", "subtrecho_der", "municipio", "regional", "residencia_dr", "uba_nome",
               "uba_codigo", "jurisdicao", "conservado_por", "centroide_lon", "centroide_lat", "buffer_lateral_m")
UNIT_GEO = ("RAGEO", "icc_geo_thresholds", "trecho_critico_geo")
UNIT_HID = ("RAHID", "icc_hid_thresholds", "trecho_critico_hid")


def default_regions(spark: SparkSession) -> DataFrame:
    """The four built-in regions; they have no axis."""
    rows = [(i, n, r, k, c, h, [{"lat": p[0], "lon": p[1]} for p in ring], []) for i, n, r, k, c, h, ring in REGIONS]
    return constant_table(spark, rows, REGION_SCHEMA)


def region_view(regions: DataFrame) -> DataFrame:
    """Regions with the legacy aliases and defaults of the public snapshot."""
    return regions.select(
        F.col("regiao_id").alias("id"), F.col("regiao_nome").alias("nome"), F.col("sigla_rodovia").alias("rodovia"),
        "regiao_id", "regiao_nome", "sigla_rodovia", F.coalesce("k_geo", F.lit(0.0)).alias("k_geo"),
        F.coalesce("cpc_breaks", F.array().cast("array<double>")).alias("cpc_breaks"),
        F.coalesce("hid24h_breaks", F.array().cast("array<double>")).alias("hid24h_breaks"))


def protocol(spark: SparkSession) -> DataFrame:
    out = constant_table(spark, list(PROTOCOL), "rd int, cor string, descricao string, responsavel_principal string, prontidao boolean, vistoria boolean, acoes array<string>")
    return out.withColumn("nivel", risk.level_label(F.col("rd")))


def protocol_actions(table: DataFrame) -> DataFrame:
    """One row per level and action, split into agency and text."""
    agency, what = text.split_action(F.col("acao"))
    return table.select("rd", "nivel", F.posexplode("acoes").alias("ordem", "acao")).select(
        "rd", "nivel", "ordem", agency.alias("orgao"), what.alias("texto"))


def native_attributes(units: DataFrame, hazard: str) -> DataFrame:
    """Native columns of one channel that exist; lat/lon fall back from the centroid."""
    wanted = UNIT_COMMON + (UNIT_GEO if hazard == "geo" else UNIT_HID)
    cols = [c for c in wanted if c in units.columns]
    alias = [F.coalesce(f"centroide_{a}", a).alias(a) if f"centroide_{a}" in units.columns else F.col(a)
             for a in ("lat", "lon") if a in units.columns]
    return units.select(*cols, *alias, F.lit(hazard).alias("hazard"))


def without_data(units: DataFrame, label: str = "Sem dado") -> DataFrame:
    """Rows for a cycle without rain: zeros, level text, source NO_DATA."""
    zero, none = F.lit(0.0), F.lit(0)
    return units.withColumns({
        "ac96h_mm": zero, "ac24h_mm": zero, "intensity_mmh": zero, "cpc": F.lit(None).cast("double"),
        "icc_geo": none, "icc_hid": none, "rd_geo": none, "rd_hid": none, "rd": none,
        "nivel": F.lit(label), "source": F.lit("NO_DATA")})


def both_channels(units: DataFrame, geo: str = "RAGEO", hid: str = "RAHID") -> DataFrame:
    """One row per unit and channel with its own RA; the rain columns ride along once."""
    channels = F.array(
        F.struct(F.lit("geo").alias("hazard"), F.col(geo).cast("int").alias("ra_geo"), F.lit(None).cast("int").alias("ra_hid")),
        F.struct(F.lit("hidro").alias("hazard"), F.lit(None).cast("int").alias("ra_geo"), F.col(hid).cast("int").alias("ra_hid")))
    return units.withColumn("_c", F.explode(channels)).select("*", "_c.*").drop("_c")


def evaluate(points: DataFrame, regions: DataFrame, geo_dist: str | None = None, hid_dist: str | None = None) -> DataFrame:
    """Classes and risk of rows with ``regiao_id, ac96h_mm, ac24h_mm, intensity_mmh, ra_geo, ra_hid``.

    Optional map columns carry the units per RA class of a stretch and take
    precedence over the scalar class. A stretch reports its worst level.
    """
    limits = regions.select("regiao_id", F.col("k_geo").alias("_k"), F.col("cpc_breaks").alias("_cb"),
                            F.col("hid24h_breaks").alias("_hb"), F.col("regiao_nome").alias("region_name"))
    df = points.join(limits, "regiao_id", "left")
    inside = F.col("_k").isNotNull()
    index = risk.cpc(F.col("intensity_mmh"), F.col("ac96h_mm"), F.col("_k"))
    df = df.withColumn("_cpc", F.when(inside, index)).withColumns({
        "icc_geo": F.when(inside, risk.class_from_breaks(F.col("_cpc"), F.col("_cb"))).otherwise(0),
        "icc_hid": F.when(inside, risk.class_from_breaks(F.col("ac24h_mm"), F.col("_hb"))).otherwise(0)})
    if geo_dist or hid_dist:
        def spread(name, scalar):
            one = F.when(F.col(scalar).isNotNull(), F.create_map(F.coalesce(F.col(scalar), F.lit(0)), F.lit(1)))
            given = F.map_filter(F.col(name), lambda k, v: v > 0) if name else F.lit(None).cast("map<int,int>")
            return F.when(F.size(F.coalesce(given, F.create_map().cast("map<int,int>"))) > 0, given).otherwise(one)
        df = df.withColumns({"_dg": spread(geo_dist, "ra_geo"), "_dh": spread(hid_dist, "ra_hid")}).withColumns({
            "rd_geo_dist": F.when(inside, risk.rd_distribution(F.col("_dg"), F.col("icc_geo"))),
            "rd_hid_dist": F.when(inside, risk.rd_distribution(F.col("_dh"), F.col("icc_hid")))})
        rg, rh = risk.worst_level(F.col("rd_geo_dist")), risk.worst_level(F.col("rd_hid_dist"))
        ra = F.greatest(F.array_max(F.map_keys("_dg")), F.array_max(F.map_keys("_dh")))
        known = F.col("_dg").isNotNull() | F.col("_dh").isNotNull()
    else:
        rg = F.when(inside & F.col("ra_geo").isNotNull(), risk.combine(F.col("ra_geo"), F.col("icc_geo"))).otherwise(0)
        rh = F.when(inside & F.col("ra_hid").isNotNull(), risk.combine(F.col("ra_hid"), F.col("icc_hid"))).otherwise(0)
        ra = F.greatest("ra_geo", "ra_hid")
        known = F.col("ra_geo").isNotNull() | F.col("ra_hid").isNotNull()
    df = df.withColumns({"rd_geo": rg, "rd_hid": rh}).withColumn("rd", F.greatest("rd_geo", "rd_hid"))
    label = F.when(~inside, F.lit(OUT_OF_COVERAGE)).when(~known, F.lit(NO_RA)).otherwise(risk.level_label(F.col("rd")))
    rounded = {c: F.when(inside, F.round(c, 1)).otherwise(F.col(c)) for c in ("ac96h_mm", "ac24h_mm", "intensity_mmh")}
    df = df.withColumns({"cpc": F.round("_cpc", 2), "nivel": label, "ra": F.when(inside & known, ra), **rounded})
    if geo_dist or hid_dist:
        worst = F.when(F.col("rd_geo") >= F.col("rd_hid"), F.try_element_at("rd_geo_dist", F.col("rd"))).otherwise(
            F.try_element_at("rd_hid_dist", F.col("rd")))
        df = df.withColumn("rd_unidades", worst)
    return df.drop("_k", "_cb", "_hb", "_cpc", "_dg", "_dh")


def level_rollup(points: DataFrame) -> DataFrame:
    """Units per level and channel, with a ``total`` row."""
    levels = [F.count_if(F.col("rd") == i).alias(f"rd{i}") for i in range(5)]
    return points.rollup("hazard").agg(F.count(F.lit(1)).alias("units"), *levels).withColumn(
        "hazard", F.coalesce("hazard", F.lit("total")))


def worst_units(points: DataFrame, ordinal: str = "ua_id") -> DataFrame:
    """Worst unit per channel: level, then 96 h rain, then input order."""
    rest = [c for c in points.columns if c not in ("hazard", "rd", "ac96h_mm", ordinal)]
    best = F.min(F.struct((-F.col("rd")).alias("_r"), (-F.col("ac96h_mm")).alias("_a"), F.col(ordinal),
                          F.struct("rd", "ac96h_mm", *rest).alias("_row")))
    return points.groupBy("hazard").agg(best.alias("_b")).select("hazard", f"_b.{ordinal}", "_b._row.*")


def worst_unit(points: DataFrame, ordinal: str = "ua_id") -> DataFrame:
    """Worst unit of both channels; the slope channel wins an equal level."""
    return worst_units(points, ordinal).orderBy(F.col("rd").desc(), F.col("hazard")).limit(1)


def stretch_distribution(stretches: DataFrame, dist: str = "dist", icc: str = "icc") -> DataFrame:
    """Distribution of levels of every stretch with its worst level and the units in it."""
    out = stretches.withColumn("rd_dist", risk.rd_distribution(F.col(dist), F.col(icc)))
    return out.withColumns({"rd": risk.worst_level(F.col("rd_dist")), "ra": risk.max_class(F.col(dist))}).withColumn(
        "rd_unidades", F.try_element_at("rd_dist", F.col("rd")))


def cycle_record(points: DataFrame) -> DataFrame:
    """One telemetry row of a cycle: level vectors, alerts, worst level, maxima and mean of the slope channel.

    Rain figures cover the slope rows that have rain of the last 24 hours; without any, maxima are 0 and the mean is null.
    """
    geo, hid = F.col("hazard") == "geo", F.col("hazard") == "hidro"
    vector = lambda cond: F.array(*[F.count_if(cond & (F.col("rd") == i)).cast("int") for i in range(5)])
    wet = geo & F.col("ac24h_mm").isNotNull()
    mean = F.sum(F.when(wet, rain.ticks(F.col("ac24h_mm")))) / F.nullif(F.count_if(wet), F.lit(0)) / F.lit(float(rain.TICKS_PER_MM))
    top = lambda name, digits: F.round(F.coalesce(F.greatest(F.max(F.when(wet, F.col(name))), F.lit(0.0)), F.lit(0.0)), digits)
    return points.agg(
        vector(F.lit(True)).alias("by_level"), vector(geo).alias("by_level_geo"), vector(hid).alias("by_level_hidro"),
        F.count_if(F.col("rd") >= 3).cast("int").alias("alert_count"), F.max("rd").alias("max_rd"), risk.level_label(F.max("rd")).alias("max_rd_name"),
        top("ac24h_mm", 1).alias("ac24h_max"), F.round(mean, 1).alias("ac24h_mean"), top("ac96h_mm", 1).alias("ac96h_max"), top("intensity_mmh", 2).alias("intensity_max"))


def gauge_blocks(points: DataFrame, stations_near: DataFrame, stations_recent: DataFrame, error: str | None = None) -> DataFrame:
    """One row for the cycle record: ``gauge`` (correction of satellite rain) and ``gauge_primary`` (units measured on the ground).

    ``points`` carries ``from_gauges``, ``correction`` and ``factor``; a unit counts once, by its slope row.
    """
    rows = points.where(F.col("hazard") == "geo")
    fixed = correction_summary(rows).select("points_corrected", "mean_factor")
    counts = [fixed, rows.agg(F.count_if("from_gauges").alias("points_gauge")), stations_near.agg(F.count(F.lit(1)).alias("stations_near")),
              stations_recent.agg(F.count(F.lit(1)).alias("stations_recent"))]
    row = counts[0]
    for one in counts[1:]:
        row = with_row(row, one)
    return row.select(
        F.struct((F.col("points_corrected") > 0).alias("applied"), "mean_factor", "stations_recent", "points_corrected").alias("gauge"),
        F.struct((F.col("points_gauge") > 0).alias("applied"), "points_gauge", "stations_near", F.lit(error).cast("string").alias("error")).alias("gauge_primary"))


def refresh_attributes(computed: DataFrame, static: DataFrame, key: str = "ua_id") -> DataFrame:
    """Take static columns from the new table and keep the computed ones."""
    kept = [c for c in computed.columns if c not in static.columns]
    return computed.select(key, *kept).join(static, key)


def summary_actions(points: DataFrame, table: DataFrame) -> DataFrame:
    """One row: worst level, its protocol, counts of critical and attention units."""
    totals = points.agg(
        F.coalesce(F.max("rd"), F.lit(0)).alias("rd"), F.count(F.lit(1)).alias("total_pontos"),
        F.count_if(F.col("rd") >= 3).alias("total_critico"), F.count_if(F.col("rd") == 2).alias("total_atencao"))
    return totals.join(table, "rd").withColumn("acoes_necessarias", F.col("rd") >= 1)


def critical_units(points: DataFrame) -> DataFrame:
    return points.where(F.col("rd") >= 3).orderBy(F.col("rd").desc(), "ua_id", "hazard")


def attention_units(points: DataFrame) -> DataFrame:
    return points.where(F.col("rd") == 2).orderBy(F.coalesce("ac24h_mm", F.lit(0.0)).desc(), "ua_id", "hazard")
