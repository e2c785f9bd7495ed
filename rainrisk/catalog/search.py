from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import predicates
from . import query

RULE = {"layerId": "encosta", "join": "and", "conditions": [
    {"field": "rd", "op": "gte", "value": "2"}, {"field": "ac24h_mm", "op": "lt", "value": "120.5"},
    {"field": "sigla_rodovia", "op": "contains", "value": "uil"}, {"field": "regiao_nome", "op": "not_empty"}]}
EITHER = {"layerId": "inundacao", "join": "or", "conditions": [
    {"field": "rd", "op": "eq", "value": "4"}, {"field": "regiao_id", "op": "lte", "value": "1"}, {"field": "regiao_nome", "op": "empty"}]}


def _points(spark, sf, hazard):
    return fx.points(spark, sf).where(F.col("hazard") == hazard).withColumnRenamed("region_name", "regiao_nome")


@query("FLT-08 FLT-09 FLT-10 CMP-13", fx.sql_with("points", {}, "SELECT ua_id FROM points WHERE hazard='geo' AND rd_geo::VARCHAR = '2' AND ac24h_mm < 120.5e0 AND lower(sigla_rodovia) LIKE '%uil%' AND COALESCE(region_name, '') <> ''"))
def search_all_conditions(spark, sf):
    # the level is a choice field, so it compares as text: equality instead of an ordering
    rule = RULE | {"conditions": [{"field": "rd", "op": "eq", "value": "2"}, *RULE["conditions"][1:]]}
    return predicates.search(_points(spark, sf, "geo"), "encosta", [rule]).select("ua_id")


@query("FLT-09 FLT-10", fx.sql_with("points", {}, "SELECT ua_id FROM points WHERE hazard='hidro' AND (rd_hid = 4 OR COALESCE(regiao_id, 0) <= 1 OR region_name IS NULL)"))
def search_any_condition(spark, sf):
    return predicates.search(_points(spark, sf, "hidro"), "inundacao", [EITHER]).select("ua_id")


@query("FLT-08", fx.sql_with("points", {}, "SELECT ua_id, hazard, source <> 'no_data' AND lower(source) <> 'no_data' AS text_ne, COALESCE(regiao_id, 0) <> 2 AS number_ne, cpc > 10 AS number_gt, cpc >= 10 AS number_gte, region_name IS NULL AS is_empty, ua_id%2=0 AS bool_eq FROM points"))
def search_atoms(spark, sf):
    c = predicates.condition
    p = fx.points(spark, sf)
    return p.select("ua_id", "hazard", c(F.col("source"), "ne", "NO_DATA").alias("text_ne"), c(F.col("regiao_id"), "ne", "2", "number").alias("number_ne"),
                    c(F.col("cpc"), "gt", "10", "number").alias("number_gt"), c(F.col("cpc"), "gte", 10, "number").alias("number_gte"),
                    c(F.col("region_name"), "empty", None).alias("is_empty"), c(F.col("ua_id") % 2 == 0, "eq", "true", "bool").alias("bool_eq"))


@query("FLT-12", fx.sql_with("fire_classes", {}, "SELECT trecho_id, horizonte FROM fire_classes WHERE rf_classe='critico'"))
def simple_search(spark, sf):
    return predicates.simple_search(fx.fire_classes(spark, sf), "fireRisk", "rf_classe", "CRITICO").select("trecho_id", "horizonte")


@query("FLT-13 SET-05", fx.sql_with("segments", {}, "SELECT DISTINCT regional AS value FROM segments"))
def field_values(spark, sf):
    return predicates.field_values(fx.segments(spark, sf), "regional")


@query("FLT-14", fx.sql_with("segments", {}, "SELECT trecho_id FROM segments WHERE tipo_pista='DUP' AND regional='ECONOMY' AND lower(road) LIKE '%d#1%'"))
def road_filter(spark, sf):
    roads = fx.segments(spark, sf).withColumnRenamed("road", "rodovia")
    return predicates.road_filter(roads, tipo_pista="DUP", regional="ECONOMY", name="D#1").select("trecho_id")


@query("FLT-19", fx.sql_with("segments", {}, "SELECT trecho_id, road AS rodovia, CASE WHEN trecho_id%2=0 THEN regional ELSE tipo_pista END AS regional, '' AS municipio, extensao FROM segments"))
def normalized_roads(spark, sf):
    s = fx.segments(spark, sf).select("trecho_id", F.col("road").alias("Rodovia_"), F.when(F.col("trecho_id") % 2 == 0, F.col("regional")).alias("regional"),
                                      F.col("tipo_pista").alias("CodRegiona"), F.col("extensao").alias("Extensao_"))
    return predicates.normalized_roads(s, {"trecho_id": (["trecho_id"], -1), "rodovia": (["rodovia", "Rodovia_"], ""), "regional": (["regional", "CodRegiona"], ""),
                                           "municipio": (["municipio", "Municipio"], ""), "extensao": (["extensao_m", "Extensao_"], 0.0)})


@query("FLT-20", fx.sql_with("units", {}, "SELECT ua_id, CASE WHEN trecho_critico_geo AND trecho_critico_hid THEN 'both' WHEN trecho_critico_geo THEN 'slope' ELSE 'flood' END AS member FROM units WHERE trecho_critico_geo OR trecho_critico_hid"))
def hazard_membership(spark, sf):
    has = F.filter(F.array(F.when(F.col("trecho_critico_geo"), F.lit("slope")), F.when(F.col("trecho_critico_hid"), F.lit("flood"))), lambda x: x.isNotNull())
    u = fx.units(spark, sf).withColumn("hazards", has).where(F.size("hazards") > 0)
    slope, flood = F.array_contains("hazards", "slope"), F.array_contains("hazards", "flood")
    return u.select("ua_id", F.when(slope & flood, "both").when(slope, "slope").otherwise("flood").alias("member"))
