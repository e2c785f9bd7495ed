from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text
from ..operators import intervals, network, spatial
from ..plans import preparation
from . import query
from .gauges import hav

OV = "u.road = s.road AND GREATEST(u.km0, s.r0) <= LEAST(u.km1, s.r1)"
LEN = "GREATEST(0e0, LEAST(u.km1, s.r1) - GREATEST(u.km0, s.r0))"


@query("JOIN-13 SRC-20", fx.sql_with("units stretches", {}, f"SELECT u.ua_id, arg_min(s.ra, s.ord) AS ra, MIN(s.ord) AS ord FROM units u LEFT JOIN stretches s ON {OV} GROUP BY u.ua_id"))
def first_official_stretch(spark, sf):
    return intervals.first_overlap(fx.units(spark, sf), fx.stretches(spark, sf), "ord", ["ra", "ord"]).select("ua_id", "ra", "ord")


@query("JOIN-14 AGG-23", fx.sql_with("units stretches", {"s1": "SELECT *, CASE WHEN d4>0 THEN 4 WHEN d3>0 THEN 3 WHEN d2>0 THEN 2 WHEN d1>0 THEN 1 WHEN d0>0 THEN 0 END AS worst FROM stretches"},
       "SELECT u.ua_id, arg_min(s.ra, s.ord) AS ra, arg_min(COALESCE(s.worst, -1), s.ord) AS worst FROM units u LEFT JOIN s1 s ON u.road = s.road AND u.km0 BETWEEN s.r0 AND s.r1 GROUP BY u.ua_id"))
def stretch_at_km(spark, sf):
    from ..functions.risk import max_class

    s = fx.stretches(spark, sf).withColumn("worst", F.coalesce(max_class(F.col("dist")), F.lit(-1)))
    return intervals.first_containing(fx.units(spark, sf), s, "ord", ["ra", "worst"], "km0").select("ua_id", "ra", "worst")


NEAR = """SELECT u.ua_id, u.road, u.km0, u.km1, u.RAGEO, u.RAHID, u.trecho_critico_geo, u.trecho_critico_hid, MIN(d) AS dist_km, arg_min(trecho_id, (d, trecho_id)) AS trecho_id FROM units u LEFT JOIN (
    SELECT u.ua_id AS k, s.trecho_id, GREATEST(0e0, s.r0 - (u.km0+u.km1)/2e0, (u.km0+u.km1)/2e0 - s.r1) AS d FROM units u JOIN segments s USING (road)
    WHERE GREATEST(0e0, s.r0 - (u.km0+u.km1)/2e0, (u.km0+u.km1)/2e0 - s.r1) <= 1.5e0) x ON x.k = u.ua_id GROUP BY ALL"""


@query("JOIN-15 WIN-04 CMP-12", fx.sql_with("units segments", {"nr": NEAR}, "SELECT ua_id, trecho_id, ROUND(dist_km, 6) AS dist_km FROM nr"))
def unit_segment_crosswalk(spark, sf):
    _, cross = preparation.segment_hub(_hub_units(spark, sf), fx.segments(spark, sf))
    return cross.withColumn("dist_km", F.round("dist_km", 6))


def _hub_units(spark, sf):
    return fx.units(spark, sf).withColumnsRenamed({"RAGEO": "ra_geo", "RAHID": "ra_hid"})


@query("AGG-20 JOIN-17 SNK-10 CMP-12", fx.sql_with("units segments", {"nr": NEAR}, """SELECT s.trecho_id, COUNT(n.ua_id) AS n_uas, MAX(n.RAGEO) AS ra_geo_max, MAX(n.RAHID) AS ra_hid_max,
    COALESCE(bool_or(trecho_critico_geo), FALSE) AS trecho_critico_geo, COALESCE(bool_or(trecho_critico_hid), FALSE) AS trecho_critico_hid FROM segments s LEFT JOIN nr n USING (trecho_id) GROUP BY s.trecho_id"""))
def segment_hub(spark, sf):
    hub, _ = preparation.segment_hub(_hub_units(spark, sf), fx.segments(spark, sf))
    return hub.select("trecho_id", "n_uas", "ra_geo_max", "ra_hid_max", "trecho_critico_geo", "trecho_critico_hid")


@query("AGG-20 SCL-42", fx.sql_with("units segments", {"nr": NEAR}, "SELECT trecho_id, row_number() OVER (PARTITION BY trecho_id ORDER BY km0, ua_id) AS posicao, ua_id, RAGEO AS ra_geo, ROUND(km0, 3) AS km_inicial FROM nr WHERE trecho_id IS NOT NULL"))
def segment_unit_lists(spark, sf):
    assigned = intervals.nearest_on_road(_hub_units(spark, sf), fx.segments(spark, sf), "trecho_id")
    detail = F.from_json("uas_risco", "ra_geo int, km_inicial double")
    return network.segment_unit_list(assigned).withColumn("d", detail).select("trecho_id", "posicao", "ua_id", "d.ra_geo", "d.km_inicial")


@query("SET-04", fx.sql_with("units segments", {"nr": NEAR}, "SELECT ua_id FROM nr WHERE trecho_id IS NULL"))
def unassigned_units(spark, sf):
    u = fx.units(spark, sf)
    got = intervals.nearest_on_road(u, fx.segments(spark, sf), "trecho_id").where("trecho_id IS NOT NULL")
    return u.select("ua_id").join(got.select("ua_id"), "ua_id", "left_anti")


@query("JOIN-16", fx.sql_with("units stations", {}, f"SELECT u.ua_id, arg_min(s.station_id, (ROUND({hav('u', 's')}, 9), s.station_id)) AS station_id, ROUND(MIN({hav('u', 's')}), 6) AS distance_km FROM units u LEFT JOIN stations s ON {hav('u', 's')} <= 3 GROUP BY u.ua_id"))
def nearest_station(spark, sf):
    out = spatial.nearest_within(fx.units(spark, sf), fx.stations(spark, sf), "station_id", 3.0)
    return out.select("ua_id", "station_id", F.round("distance_km", 6).alias("distance_km"))


@query("JOIN-18", fx.sql_with("units stretches", {}, f"""SELECT ua_id, kind, ROUND(overlap_km, 6) AS overlap_km FROM units LEFT JOIN (
    SELECT u.ua_id, s.kind, {LEN} AS overlap_km, row_number() OVER (PARTITION BY u.ua_id ORDER BY {LEN} DESC, s.kind) AS rn FROM units u JOIN stretches s ON {OV} WHERE {LEN} > 0) x USING (ua_id) WHERE COALESCE(rn, 1) = 1"""))
def longest_overlap(spark, sf):
    out = intervals.longest_overlap(fx.units(spark, sf), fx.stretches(spark, sf), "kind")
    return out.select("ua_id", "kind", F.round("overlap_km", 6).alias("overlap_km"))


MAJ = f"""SELECT ua_id, arg_max(ra, (o, ra)) AS ra FROM (SELECT u.ua_id, s.ra, SUM(ROUND({LEN}*1e6)::BIGINT) AS o FROM units u JOIN stretches s ON {OV} GROUP BY ALL HAVING o > 0) GROUP BY ua_id"""


@query("JOIN-27", fx.sql_with("units stretches", {"mj": MAJ}, "SELECT ua_id, mj.ra FROM units LEFT JOIN mj USING (ua_id)"))
def majority_class(spark, sf):
    return intervals.majority_class(fx.units(spark, sf), fx.stretches(spark, sf), "ra").select("ua_id", "ra")


@query("AGG-35 FLT-17", fx.sql_with("units stretches", {}, "SELECT s.ord, COUNT(u.ua_id) AS observed FROM stretches s LEFT JOIN units u ON u.road = s.road AND u.km0 BETWEEN s.r0 - 0.5e0 AND s.r1 + 0.5e0 GROUP BY s.ord"))
def critical_stretch_audit(spark, sf):
    return intervals.count_inside(fx.stretches(spark, sf), fx.units(spark, sf)).select("ord", "observed")


@query("FLT-17", fx.sql_with("units stretches", {}, "SELECT u.ua_id, arg_min(s.kind, s.ord) AS kind FROM units u JOIN stretches s ON u.road = s.road AND u.km0 BETWEEN s.r0 - 0.001e0 AND s.r1 + 0.001e0 GROUP BY u.ua_id"))
def study_area_units(spark, sf):
    areas = fx.stretches(spark, sf).withColumns({"r0": F.col("r0") - 0.001, "r1": F.col("r1") + 0.001})
    return intervals.first_containing(fx.units(spark, sf), areas, "ord", ["kind"], "km0").where("kind IS NOT NULL").select("ua_id", "kind")


@query("FLT-18", fx.sql_with("segments", {}, "SELECT trecho_id, road FROM segments WHERE road IN ('Brand#3', 'Brand#7')"))
def included_roads(spark, sf):
    return fx.segments(spark, sf).where(F.col("road").isin("Brand#3", "Brand#7")).select("trecho_id", "road")


@query("AGG-21 AGG-39", fx.sql_with("units", {}, "SELECT road, string_agg(DISTINCT municipio, ';' ORDER BY municipio) AS municipios, string_agg(DISTINCT escala, ';' ORDER BY escala) AS escalas, COUNT(*) AS n, SUM(ROUND((km1-km0)*1e6)::BIGINT)::DOUBLE/1e6 AS km FROM units GROUP BY road"))
def road_attributes(spark, sf):
    return fx.units(spark, sf).groupBy("road").agg(network.distinct_joined("municipio").alias("municipios"), network.distinct_joined("escala").alias("escalas"),
                                                   F.count(F.lit(1)).alias("n"), network.exact_total(F.col("km1") - F.col("km0")).alias("km"))


@query("AGG-22", fx.sql_with("units", {}, "SELECT road, arg_max(cls, (n, cls)) AS mode, MAX(n) AS n FROM (SELECT road, cls, COUNT(*) AS n FROM units GROUP BY ALL) GROUP BY road"))
def road_mode_class(spark, sf):
    return network.mode_per_group(fx.units(spark, sf), ["road"], "cls")


@query("AGG-37", fx.sql_with("units", {}, "SELECT road, ROUND(SUM(cls)/COUNT(*)::DOUBLE, 6) AS score, LEAST(1e0, COUNT(*)/20e0) AS confidence, (SELECT arg_max(cls, (n, cls)) FROM (SELECT cls, COUNT(*) AS n FROM units v WHERE v.road=u.road GROUP BY cls)) AS mode FROM units u GROUP BY road"))
def class_histogram_score(spark, sf):
    return network.histogram_score(fx.units(spark, sf), ["road"], "cls").withColumn("score", F.round("score", 6))


@query("AGG-24 SNK-09 SRC-14 SRC-15", fx.sql_with("segments", {}, """SELECT COUNT(*) AS segments, SUM(ROUND(extensao*1e6)::BIGINT)::DOUBLE/1e6 AS total_length, COUNT(DISTINCT road) AS roads, COUNT(*) FILTER (monitored) AS monitored,
    SUM(ROUND(extensao*1e6)::BIGINT) FILTER (monitored)::DOUBLE/1e6 AS monitored_length, string_agg(DISTINCT tipo_pista, ';' ORDER BY tipo_pista) AS surface_types, MIN(r0) AS min_km, MAX(r1) AS max_km FROM segments"""))
def road_statistics(spark, sf):
    from ..sources.tables import road_table

    roads = road_table(fx.segments(spark, sf), {"road": "rodovia", "extensao": "extensao", "tipo_pista": "tipo_pista", "monitored": "monitored", "r0": "km_ini", "r1": "km_fim"})
    return network.road_statistics(roads, F.col("monitored"))


@query("AGG-25", fx.sql_with("units", {}, 'SELECT road, COUNT(*) FILTER (escala=\'25K\') AS "25K", COUNT(*) FILTER (escala=\'10K\') AS "10K", COUNT(*) FILTER (escala=\'1K\') AS "1K" FROM units GROUP BY road'))
def road_scale_counts(spark, sf):
    return network.pivot_counts(fx.units(spark, sf), ["road"], "escala", ["25K", "10K", "1K"])


@query("AGG-39", fx.sql_with("segments", {}, "SELECT road, arg_min(regional, trecho_id) AS regional, COUNT(*) AS n FROM segments GROUP BY road"))
def dissolved_roads(spark, sf):
    return network.dissolve(fx.segments(spark, sf), "road", "trecho_id", ["regional"])


@query("AGG-40", fx.sql_with("segments stretches", {"o": "SELECT road, SUM(r1-r0) AS official FROM stretches GROUP BY road"}, """SELECT road, official, measured, ROUND(COALESCE(measured, 0e0) - official, 6) AS difference
    FROM o LEFT JOIN (SELECT road, SUM(ROUND(extensao*1e6)::BIGINT)::DOUBLE/1e6 AS measured FROM segments GROUP BY road) m USING (road)"""))
def road_length_audit(spark, sf):
    official = fx.stretches(spark, sf).groupBy("road").agg(network.exact_total(F.col("r1") - F.col("r0")).alias("official"))
    return network.length_audit(fx.segments(spark, sf), official, "road", "extensao", "official")


AUDIT = {"e": "SELECT road, ra, SUM(r1-r0) AS km_expected FROM stretches GROUP BY ALL", "g": "SELECT road, GREATEST(cls, 0)::INT AS ra, SUM(ROUND((km1-km0)*1e6)::BIGINT)::DOUBLE/1e6 AS km_observed FROM units GROUP BY ALL",
         "a": """SELECT road, ra, COALESCE(km_expected, 0e0) AS km_expected, COALESCE(km_observed, 0e0) AS km_observed FROM e FULL JOIN g USING (road, ra)"""}


def _audit(spark, sf):
    e = fx.stretches(spark, sf).groupBy("road", "ra").agg(network.exact_total(F.col("r1") - F.col("r0")).alias("km_expected"))
    g = fx.units(spark, sf).groupBy("road", F.greatest("cls", F.lit(0)).alias("ra")).agg(network.exact_total(F.col("km1") - F.col("km0")).alias("km_observed"))
    return network.quota_audit(g, e, ["road", "ra"])


@query("AGG-33", fx.sql_with("units stretches", AUDIT, """SELECT *, ROUND(km_observed-km_expected, 6) AS error_km, ROUND(ABS(km_observed-km_expected), 6) AS abs_error_km,
    CASE WHEN km_expected > 0 THEN ROUND((km_observed-km_expected)*100e0/km_expected, 4) END AS error_pct, ROUND(LEAST(km_observed, km_expected), 6) AS matched_km FROM a"""))
def quota_audit(spark, sf):
    return _audit(spark, sf)


@query("AGG-33", fx.sql_with("units stretches", AUDIT, "SELECT ROUND(SUM(ROUND(LEAST(km_observed, km_expected), 6))*100e0/SUM(km_expected), 6) AS agreement_pct FROM a"))
def quota_agreement(spark, sf):
    return network.quota_agreement(_audit(spark, sf)).withColumn("agreement_pct", F.round("agreement_pct", 6))


@query("AGG-34", fx.sql_with("segments", {"p": "SELECT road, tipo_pista, SUM(ROUND(extensao*1e6)::BIGINT) AS l, SUM(trecho_id%7) AS c FROM segments GROUP BY ALL"}, """SELECT road, tipo_pista, ROUND((l*100e0)/SUM(l) OVER (PARTITION BY road), 6) AS length_pct,
    ROUND((c*100e0)/SUM(c) OVER (PARTITION BY road), 6) AS count_pct FROM p"""))
def class_share_by_length(spark, sf):
    s = fx.segments(spark, sf).withColumn("units", F.col("trecho_id") % 7)
    out = network.class_share(s, "road", "tipo_pista", "extensao", "units")
    return out.withColumns({c: F.round(c, 6) for c in ("length_pct", "count_pct")})


@query("JOIN-22", fx.sql_with("points", {}, "SELECT ua_id, hazard, rd, ac96h_mm FROM points QUALIFY row_number() OVER (PARTITION BY ua_id ORDER BY rd DESC, ac96h_mm DESC, hazard) = 1"))
def worse_channel(spark, sf):
    return network.worse_channel(fx.points(spark, sf)).select("ua_id", "hazard", "rd", "ac96h_mm")


@query("TOP-04", fx.sql_with("points", {"w": "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY ua_id ORDER BY rd DESC, ac96h_mm DESC, hazard) = 1"}, "SELECT ua_id, hazard, rd FROM w WHERE rd > 0 ORDER BY rd DESC, ac96h_mm DESC, ua_id LIMIT 4"))
def focal_units(spark, sf):
    return network.focal_units(fx.points(spark, sf)).select("ua_id", "hazard", "rd")


@query("TOP-09", fx.sql_with("points", {"w": "SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY ua_id ORDER BY rd DESC, ac96h_mm DESC, hazard) = 1",
       "f": "SELECT *, 0 AS o FROM w WHERE rd > 0 ORDER BY rd DESC, ac96h_mm DESC, ua_id LIMIT 4"}, """SELECT ua_id, rd FROM (SELECT ua_id, rd, ac96h_mm, 0 AS o FROM f WHERE regiao_id=3 UNION ALL SELECT ua_id, rd, ac96h_mm, 1 FROM w WHERE regiao_id=3) ORDER BY o, rd DESC, ac96h_mm DESC, ua_id LIMIT 1"""))
def panel_unit(spark, sf):
    return network.panel_unit(fx.points(spark, sf), 3).select("ua_id", "rd")


@query("JOIN-23", fx.sql_with("points", {}, "SELECT ua_id, g.rd AS rd_geo, h.rd AS rd_hid FROM (SELECT * FROM points WHERE hazard='geo' AND rd>0) g FULL JOIN (SELECT * FROM points WHERE hazard='hidro' AND rd>1) h USING (ua_id)"))
def channel_pairs(spark, sf):
    p = fx.points(spark, sf).where(((F.col("hazard") == "geo") & (F.col("rd") > 0)) | ((F.col("hazard") == "hidro") & (F.col("rd") > 1)))
    return network.channel_pairs(p.drop("rd_geo", "rd_hid"), ["rd"])


@query("JOIN-30", fx.sql_with("points", {"w": "SELECT ua_id, hazard FROM points QUALIFY row_number() OVER (PARTITION BY hazard ORDER BY rd DESC, ac96h_mm DESC, ua_id) = 1 ORDER BY rd DESC, hazard LIMIT 1"}, """SELECT ua_id, w.hazard AS max_hazard, RAGEO AS ra_geo, RAHID AS ra_hid, rd FROM points JOIN w USING (ua_id, hazard)"""))
def alert_context(spark, sf):
    from ..operators.risk import worst_unit

    p = fx.points(spark, sf)
    return network.alert_context(p.drop("rd_geo", "rd_hid"), worst_unit(p))


@query("JOIN-24", fx.sql_with("segments units", {}, "SELECT DISTINCT road, r0 FROM segments WHERE monitored AND (road, r0) NOT IN (SELECT road, floor(km0) FROM units)"))
def monitored_without_units(spark, sf):
    s, u = fx.segments(spark, sf).where("monitored"), fx.units(spark, sf).select("road", F.floor("km0").cast("double").alias("r0"))
    return network.roads_without_units(s, u, ["road", "r0"])


@query("TOP-08", fx.sql_with("units", {}, "SELECT road, row_number() OVER (PARTITION BY road ORDER BY (km0+km1)/2e0, ua_id) AS posicao, ua_id FROM units"))
def units_along_road(spark, sf):
    return network.units_along_road(fx.units(spark, sf), "road", (F.col("km0") + F.col("km1")) / 2.0)


@query("SET-03 SNK-06 CMP-09", fx.sql_with("points", {}, "SELECT hazard, posicao, ua_id, rd FROM (SELECT *, row_number() OVER (PARTITION BY hazard ORDER BY rd DESC, ac96h_mm DESC, ua_id)::INT AS posicao FROM points) WHERE posicao <= 10"))
def report_rows(spark, sf):
    from ..sinks.outputs import report_rows as rows

    return rows(fx.points(spark, sf)).select("hazard", "posicao", "ua_id", "rd")


@query("SET-06", fx.sql_with("points", {}, "SELECT ua_id, 'left' AS side FROM points WHERE hazard='geo' AND rd>=2 AND ua_id NOT IN (SELECT ua_id FROM points WHERE hazard='hidro' AND rd>=2) UNION ALL SELECT ua_id, 'right' FROM points WHERE hazard='hidro' AND rd>=2 AND ua_id NOT IN (SELECT ua_id FROM points WHERE hazard='geo' AND rd>=2)"))
def channel_id_difference(spark, sf):
    p = fx.points(spark, sf).where("rd >= 2")
    return network.id_difference(p.where("hazard = 'geo'"), p.where("hazard = 'hidro'"), "ua_id")


@query("WIN-04", fx.sql_with("segments", {}, "SELECT road, trecho_id, extensao FROM segments QUALIFY row_number() OVER (PARTITION BY road ORDER BY extensao DESC, trecho_id) = 1"))
def longest_segment_per_road(spark, sf):
    return network.keep_first(fx.segments(spark, sf), ["road"], [F.col("extensao").desc(), F.col("trecho_id")]).select("road", "trecho_id", "extensao")


@query("SCL-26", fx.sql_with("segments", {}, "SELECT trecho_id AS k, substr(sha1(road || '|' || (r0::BIGINT)::VARCHAR || '||' || regional || '|' || tipo_pista), 1, 16) AS segment_id FROM segments"))
def segment_ids(spark, sf):
    s = fx.segments(spark, sf)
    return s.select(F.col("trecho_id").alias("k"), text.segment_id(F.col("road"), F.col("r0").cast("long"), F.lit(None), F.col("regional"), F.col("tipo_pista")).alias("segment_id"))


@query("SCL-26", fx.sql_with("units", {"u5": "SELECT ua_id // 100 AS mesh_of, ua_id, lat, CASE WHEN lon < 0 THEN lon + 360e0 ELSE lon END AS lon FROM units"}, "SELECT mesh_of, substr(sha1(COUNT(*)::VARCHAR || string_agg(printf('|%.6f,%.6f', lat, lon), '' ORDER BY ua_id)), 1, 12) AS mesh, COUNT(*) AS n_points FROM u5 GROUP BY mesh_of"))
def mesh_hashes(spark, sf):
    u = fx.units(spark, sf).withColumn("mesh_of", F.floor(F.col("ua_id") / 100).cast("long"))
    return network.mesh_hash(u, "ua_id", ["mesh_of"])


@query("TOP-10", fx.sql_with("units", {}, "SELECT road, km0, ua_id FROM units"))
def ordered_units(spark, sf):
    return fx.units(spark, sf).select("road", "km0", "ua_id").orderBy("road", "km0", "ua_id")


@query("AGG-36 SRC-20", fx.sql_with("units", {}, "SELECT escala, COUNT(*) AS observed, CASE escala WHEN '25K' THEN 63 WHEN '10K' THEN 335 ELSE 411 END::BIGINT AS official FROM units GROUP BY escala"))
def scale_totals(spark, sf):
    from ..constants import UNIT_QUOTAS
    from ..operators.scale import constant_table

    official = constant_table(spark, [(s, n) for _, _, s, n, _ in UNIT_QUOTAS], "escala string, n int").groupBy("escala").agg(F.sum("n").alias("official"))
    return fx.units(spark, sf).groupBy("escala").agg(F.count(F.lit(1)).alias("observed")).join(official, "escala")
