from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import PROTOCOL
from ..functions import risk as rk, text
from ..operators import risk, spatial
from ..plans import cycle
from ..sinks import outputs
from . import query
from .gauges import hav
from .rain import CELL_WINDOWS, COMPOSED_CTES, HOURS, T, TIMELINE, TXT, UNIT_WINDOWS, inputs

IN_BOX = "u.lat < lat1 AND u.lat >= lat0 AND u.lon < lon1 AND u.lon >= lon0"
# the rectangles as plain bounds: a vertical edge counts once, the point on the left border is inside
PLACED = f"SELECT u.ua_id, MIN(regiao_id) AS regiao_id FROM units u LEFT JOIN regions r ON {IN_BOX} GROUP BY u.ua_id"
LABEL = "['Monitoramento','Observação','Atenção','Alerta','Alerta Máximo'][(rd+1)]"


def matrix(ra: str, icc: str) -> str:
    return f"(CASE WHEN {ra}=0 OR {icc}=0 THEN 0 ELSE LEAST(4, {ra}+{icc}-1) END)"


def half_up(c: str, digits: int) -> str:
    return f"ROUND({c}::DECIMAL(18,6), {digits})::DOUBLE"


def evaluated(source: str, a96: str, a24: str) -> str:
    """Risk per unit and channel over ``source`` (unit columns and windows)."""
    cpc = f"(CASE WHEN {a96} <= 0.5e0 THEN 0e0 ELSE intensity_mmh/(k_geo*pow({a96}, -0.9e0)) END)"
    breaks = lambda v, b: f"len([x FOR x IN {b} IF {v} >= x])"
    return f"""SELECT *, {LABEL} AS lv FROM (SELECT s.*, h.hazard, p.regiao_id, CASE WHEN p.regiao_id IS NOT NULL THEN {cpc} END AS cpc,
        CASE WHEN p.regiao_id IS NULL THEN 0 ELSE {breaks(cpc, 'cpc_breaks')} END::INT AS icc_geo, CASE WHEN p.regiao_id IS NULL THEN 0 ELSE {breaks(a24, 'hid24h_breaks')} END::INT AS icc_hid,
        CASE WHEN p.regiao_id IS NULL THEN 0 WHEN h.hazard='geo' THEN {matrix('RAGEO', breaks(cpc, 'cpc_breaks'))} ELSE {matrix('RAHID', breaks(a24, 'hid24h_breaks'))} END::INT AS rd
        FROM {source} s JOIN placed p USING (ua_id) LEFT JOIN regions r USING (regiao_id), (VALUES ('geo'),('hidro')) h(hazard))"""


BASE_CTES = {"cw": CELL_WINDOWS, "uw": UNIT_WINDOWS, "placed": PLACED, "ev": evaluated("uw", "ac96h_mm", "ac24h_mm")}
LIVE_CTES = COMPOSED_CTES | {"placed": PLACED, "ev": evaluated("cp", "use96", "use24")}
NIVEL = "CASE WHEN regiao_id IS NULL THEN 'Fora de cobertura' ELSE lv END"


def observed(spark, sf):
    return cycle.risk_points(inputs(spark, sf), fx.target(), use_forecast=False)


def live(spark, sf):
    return cycle.risk_points(inputs(spark, sf, forecast_grid=fx.forecast_grid(spark, sf)), fx.target())


@query("JOIN-01 SRC-10", fx.sql_with("units regions", {"placed": PLACED}, "SELECT ua_id, regiao_id FROM placed"))
def units_in_regions(spark, sf):
    return spatial.containing_region(fx.units(spark, sf), risk.default_regions(spark)).select("ua_id", "regiao_id")


def planar(p: str) -> str:
    x1, y1 = f"((a.lon-{p}.lon)*111.32e0*cos(radians({p}.lat)))", f"((a.lat-{p}.lat)*111.32e0)"
    x2, y2 = f"((b.lon-{p}.lon)*111.32e0*cos(radians({p}.lat)))", f"((b.lat-{p}.lat)*111.32e0)"
    t = f"GREATEST(0e0, LEAST(1e0, -({x1}*({x2}-{x1})+{y1}*({y2}-{y1}))/(pow({x2}-{x1},2)+pow({y2}-{y1},2))))"
    return f"sqrt(pow({x1}+{t}*({x2}-{x1}),2)+pow({y1}+{t}*({y2}-{y1}),2))"


AXIS = f"""SELECT u.ua_id, MIN(d) AS axis_km, arg_min(region, (d, region)) AS region FROM units u JOIN (
    SELECT u.ua_id, a.region, {planar('u')} AS d FROM units u, axis_vertices a JOIN axis_vertices b ON a.region=b.region AND b.seq=a.seq+1) x USING (ua_id) WHERE d < 5 GROUP BY u.ua_id"""


@query("JOIN-02 SRC-09", fx.sql_with("units axis_vertices", {"ax": AXIS}, "SELECT ua_id, region AS regiao_id, ROUND(axis_km, 6) AS axis_km FROM units LEFT JOIN ax USING (ua_id)"))
def nearest_axis(spark, sf):
    seg = spatial.axis_segments(fx.axes(spark, sf))
    out = spatial.nearest_axis(fx.units(spark, sf), seg, 5.0)
    return out.select("ua_id", "regiao_id", F.round("axis_km", 6).alias("axis_km"))


@query("JOIN-03 JOIN-20", fx.sql_with("units regions axis_vertices", {"placed": PLACED, "ax": AXIS}, """SELECT ua_id, COALESCE(placed.regiao_id, ax.region) AS regiao_id
    FROM units LEFT JOIN placed USING (ua_id) LEFT JOIN ax USING (ua_id)"""))
def unit_region_lookup(spark, sf):
    regions = risk.default_regions(spark).drop("eixo").join(fx.axes(spark, sf), "regiao_id", "full_outer")
    return spatial.locate_region(fx.units(spark, sf), regions, 5.0).select("ua_id", "regiao_id")


@query("CMP-01 SCL-02 SCL-03 SCL-04 SCL-06 SCL-07", fx.sql_with("grid_hourly units forecast_grid regions", LIVE_CTES, f"""SELECT ua_id, hazard, regiao_id, fonte_chuva, icc_geo, icc_hid, rd, {NIVEL} AS nivel,
    ROUND(cpc, 2) AS cpc FROM ev"""))
def risk_points(spark, sf):
    return live(spark, sf).select("ua_id", "hazard", "regiao_id", "fonte_chuva", "icc_geo", "icc_hid", "rd", "nivel", "cpc")


@query("CMP-01 AGG-08 AGG-09 FLT-22", fx.sql_with("grid_hourly units forecast_grid regions", LIVE_CTES | {"w": """SELECT ua_id, rd, hazard FROM (SELECT ua_id, rd, hazard,
    row_number() OVER (PARTITION BY hazard ORDER BY rd DESC, ROUND(CASE WHEN regiao_id IS NULL THEN use96 ELSE ROUND(use96::DECIMAL(18,4), 1)::DOUBLE END, 6) DESC, ua_id) AS rn FROM ev) WHERE rn=1 ORDER BY rd DESC, hazard LIMIT 1"""}, f"""SELECT COUNT(*) AS total,
    COUNT(*) FILTER (hazard='geo') AS total_geo, COUNT(*) FILTER (hazard='hidro') AS total_hidro, COUNT(*) FILTER (rd=4) AS all_rd4, COUNT(*) FILTER (rd=0 AND hazard='geo') AS geo_rd0,
    (SELECT ua_id FROM w) AS max_rd_point, (SELECT rd FROM w) AS max_rd, (SELECT hazard FROM w) AS max_rd_hazard,
    (SELECT COUNT(DISTINCT hr)::INT FROM grid_hourly WHERE {HOURS} BETWEEN 0 AND 95) AS files_ok FROM ev"""))
def risk_summary(spark, sf):
    out = cycle.risk_summary(live(spark, sf), fx.grid_hourly(spark, sf, 96), fx.target())
    return out.select("total", "total_geo", "total_hidro", "all_rd4", "geo_rd0", "max_rd_point", "max_rd", "max_rd_hazard", "files_ok")


@query("CMP-02 STR-16 FLT-23", fx.sql_with("grid_hourly units regions", BASE_CTES, "SELECT ua_id, hazard, rd, icc_geo, icc_hid, 'SATELLITE' AS source, TRUE AS historical FROM ev"))
def risk_at_instant(spark, sf):
    instant = fx.target() + F.expr("INTERVAL 20 MINUTES")
    out = cycle.snapshot_at(inputs(spark, sf), instant, F.lit("2024-02-10 00:00:00").cast("timestamp"))
    return out.select("ua_id", "hazard", "rd", "icc_geo", "icc_hid", "source", "historical")


@query("FLT-23 FLT-22 STR-10", fx.sql_with("units", {}, "SELECT ua_id, h.hazard, 0 AS rd, 'Sem dado' AS nivel, 'NO_DATA' AS source FROM units, (VALUES ('geo'),('hidro')) h(hazard)"))
def risk_before_data(spark, sf):
    data = cycle.Inputs(fx.units(spark, sf), fx.grid_hourly(spark, sf), risk.default_regions(spark))
    out = cycle.snapshot_at(data, F.lit("2023-12-01 00:00:00").cast("timestamp"), fx.target())
    return out.select("ua_id", "hazard", "rd", "nivel", "source")


TL_EV = {"tl": TIMELINE, "placed": PLACED, "fr": f"""SELECT u.ua_id, u.RAGEO, u.RAHID, s.hr, COALESCE(t.intensity_mmh, 0e0) AS intensity_mmh, COALESCE(t.ac24h_mm, 0e0) AS ac24h_mm, COALESCE(t.ac96h_mm, 0e0) AS ac96h_mm
    FROM units u CROSS JOIN (SELECT {T} - to_hours(i::INT) AS hr FROM range(24) r(i)) s LEFT JOIN tl t ON t.lat_idx=u.lat_idx AND t.lon_idx=u.lon_idx AND t.hr=s.hr""",
    "ev": evaluated("fr", "ac96h_mm", "ac24h_mm")}


@query("WIN-01 CMP-03", fx.sql_with("grid_hourly units regions", TL_EV, "SELECT ua_id, hazard, strftime(hr, '%Y-%m-%d %H:%M:%S') AS hr, rd FROM ev"))
def risk_timeline(spark, sf):
    return cycle.timeline(inputs(spark, sf), fx.target(), 24).withColumn("hr", F.date_format("hr", TXT))


@query("AGG-08", fx.sql_with("points", {}, "SELECT COALESCE(hazard, 'total') AS hazard, COUNT(*) AS units, " + ", ".join(f"COUNT(*) FILTER (rd={i}) AS rd{i}" for i in range(5)) + " FROM points GROUP BY ROLLUP (hazard)"))
def level_rollup(spark, sf):
    return risk.level_rollup(fx.points(spark, sf))


@query("AGG-09", fx.sql_with("points", {}, "SELECT hazard, ua_id, rd, ac96h_mm FROM points QUALIFY row_number() OVER (PARTITION BY hazard ORDER BY rd DESC, ac96h_mm DESC, ua_id) = 1"))
def worst_unit_per_channel(spark, sf):
    return risk.worst_units(fx.points(spark, sf)).select("hazard", "ua_id", "rd", "ac96h_mm")


@query("AGG-10 AGG-11 AGG-23", fx.sql_with("stretches", {"x": "SELECT ord, icc, unnest([0,1,2,3,4]) AS ra_c, unnest([d0,d1,d2,d3,d4]) AS n FROM stretches",
       "y": f"SELECT ord, {matrix('ra_c', 'icc')}::INT AS rd, SUM(n)::INT AS n FROM x WHERE n > 0 GROUP BY ALL"}, """SELECT s.ord, m.ra AS ra, COALESCE(MAX(y.rd), 0) AS rd, arg_max(y.n, y.rd) AS rd_unidades,
       string_agg(y.rd||':'||y.n, ',' ORDER BY y.rd) AS rd_dist FROM stretches s LEFT JOIN y USING (ord) LEFT JOIN (SELECT ord, MAX(ra_c) AS ra FROM x WHERE n > 0 GROUP BY ord) m USING (ord) GROUP BY s.ord, m.ra"""))
def stretch_risk(spark, sf):
    out = risk.stretch_distribution(fx.stretches(spark, sf))
    text_of = F.array_join(F.transform(F.array_sort(F.map_entries("rd_dist")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("ord", "ra", "rd", "rd_unidades", F.when(F.size("rd_dist") > 0, text_of).alias("rd_dist"))


@query("FLT-01 SNK-08", fx.sql_with("units", {}, "SELECT ua_id, sigla_rodovia, escala, municipio, RAGEO, trecho_critico_geo, lat, lon, 'geo' AS hazard FROM units"))
def native_attributes(spark, sf):
    return risk.native_attributes(outputs.channel_extract(fx.units(spark, sf), "geo").drop("hazard"), "geo")


@query("FLT-02 JOIN-25", fx.sql_with("points regions", {}, """SELECT ua_id, hazard, regiao_id, regiao_nome AS nome, k_geo, list_sum(cpc_breaks) AS cpc_sum FROM points JOIN regions USING (regiao_id)"""))
def region_attributes(spark, sf):
    view = risk.region_view(risk.default_regions(spark))
    p = fx.points(spark, sf).select("ua_id", "hazard", "regiao_id")
    return p.join(view, "regiao_id").select("ua_id", "hazard", "regiao_id", "nome", "k_geo", F.aggregate("cpc_breaks", F.lit(0.0), lambda a, x: a + x).alias("cpc_sum"))


@query("FLT-04 FLT-05 FLT-03 CMP-06", fx.sql_with("points", {}, """SELECT ua_id, hazard, 'Inundação' AS hazard_label, rd, CASE WHEN source='NO_DATA' THEN 'indisponivel' ELSE 'ativo' END AS monitoramento
    FROM points WHERE hazard='hidro' AND COALESCE(rd,0) >= 3"""))
def public_units(spark, sf):
    kept = outputs.at_least(outputs.select_channel(fx.points(spark, sf), "inundacao"), 3)
    return outputs.public_properties(kept).select("ua_id", "hazard", "hazard_label", "rd", "monitoramento")


@query("SNK-01 SCL-42", fx.sql_with("points", {}, """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || ua_id%90 || '.5,' || ua_id%45 || '.5]},"properties":{"hazard":"geo","hazard_label":"Encosta","ua_id":' || ua_id || ',"rd":' || rd || ',"monitoramento":"' ||
    CASE WHEN source='NO_DATA' THEN 'indisponivel' ELSE 'ativo' END || '"}}' AS value FROM points WHERE hazard='geo' AND rd >= 1"""))
def feed_features(spark, sf):
    p = fx.points(spark, sf).select("ua_id", "hazard", "rd", "source", (F.col("ua_id") % 90 + 0.5).cast("double").alias("lon"), (F.col("ua_id") % 45 + 0.5).cast("double").alias("lat"))
    lines = outputs.feature_lines(p, "encosta", 1)
    # position and source are not part of the compared text
    return lines.select(F.regexp_replace(F.regexp_replace("value", r',"source":"[A-Z_]+"', ""), r',"lon":[\d.]+,"lat":[\d.]+', "").alias("value"))


@query("SNK-01", fx.sql_with("points", {}, "SELECT COUNT(*) AS total, " + ", ".join(f"COUNT(*) FILTER (rd={i}) AS rd{i}" for i in range(5)) + " FROM points WHERE rd >= 2"))
def feed_header(spark, sf):
    return outputs.feed_header(fx.points(spark, sf), "all", 2)


BY_LEVEL = "||','||".join(f"COUNT(*) FILTER (rd={i})" for i in range(5))


@query("AGG-28", fx.sql_with("points", {}, f"""SELECT {BY_LEVEL} AS by_level, COUNT(*) FILTER (rd>=3)::INT AS alert_count, MAX(rd) AS max_rd, (ARRAY['Monitoramento', 'Observação', 'Atenção', 'Alerta', 'Alerta Máximo'])[MAX(rd) + 1] AS max_rd_name,
    ROUND(COALESCE(MAX(ac24h_mm) FILTER (hazard='geo'), 0), 1) AS ac24h_max, ROUND(COALESCE(MAX(ac96h_mm) FILTER (hazard='geo' AND ac24h_mm IS NOT NULL), 0), 1) AS ac96h_max,
    ROUND(SUM(ROUND(ac24h_mm*10000)::BIGINT) FILTER (hazard='geo')::DOUBLE/COUNT(ac24h_mm) FILTER (hazard='geo')/10000e0, 1) AS ac24h_mean,
    ROUND(COALESCE(MAX(intensity_mmh) FILTER (hazard='geo' AND ac24h_mm IS NOT NULL), 0), 2) AS intensity_max FROM points"""))
def cycle_record(spark, sf):
    out = risk.cycle_record(fx.points(spark, sf))
    return out.select(F.array_join("by_level", ",").alias("by_level"), "alert_count", "max_rd", "max_rd_name", "ac24h_max", "ac24h_mean", "ac96h_max", "intensity_max")


ACTIONS = fx.values_sql(PROTOCOL, "rd, cor, descricao, responsavel_principal, prontidao, vistoria, acoes")


@query("AGG-32 CMP-05 SRC-21", fx.sql_with("points", {"t": "SELECT COALESCE(MAX(rd), 0) AS rd, COUNT(*) AS total_pontos, COUNT(*) FILTER (rd>=3) AS total_critico, COUNT(*) FILTER (rd=2) AS total_atencao FROM points", "p": ACTIONS}, f"""SELECT t.*, {LABEL} AS nivel,
    cor, descricao, responsavel_principal, prontidao, vistoria, array_to_string(acoes, chr(10)) AS acoes, rd >= 1 AS acoes_necessarias FROM t JOIN p USING (rd)"""))
def summary_actions(spark, sf):
    return risk.summary_actions(fx.points(spark, sf), risk.protocol(spark)).withColumn("acoes", F.array_join("acoes", "\n"))


@query("CMP-05 SCL-28", fx.sql_with("points", {"p": ACTIONS}, f"""SELECT rd, {LABEL} AS nivel, COUNT(*) AS units, [3,5,7,7,8][(rd+1)]::BIGINT AS actions,
    (SELECT string_agg(DISTINCT trim(split_part(x, ':', 1)), ',' ORDER BY trim(split_part(x, ':', 1))) FROM (SELECT unnest(acoes) AS x FROM p WHERE p.rd = points.rd)) AS agencies FROM points GROUP BY rd"""))
def protocol_by_level(spark, sf):
    n = fx.points(spark, sf).groupBy("rd").agg(F.count(F.lit(1)).alias("units"))
    acts = risk.protocol_actions(risk.protocol(spark)).where(F.col("orgao") != "").groupBy("rd", "nivel").agg(
        F.count(F.lit(1)).alias("actions"), F.array_join(F.array_sort(F.collect_set("orgao")), ",").alias("agencies"))
    return n.join(acts, "rd").select("rd", "nivel", "units", "actions", "agencies")


@query("AGG-32 TOP-07", fx.sql_with("points", {}, "SELECT ua_id, hazard, rd FROM points WHERE rd >= 3"))
def critical_units(spark, sf):
    return risk.critical_units(fx.points(spark, sf)).select("ua_id", "hazard", "rd")


@query("TOP-07", fx.sql_with("points", {}, "SELECT ua_id, hazard, ac24h_mm FROM points WHERE rd = 2"))
def attention_units(spark, sf):
    return risk.attention_units(fx.points(spark, sf)).select("ua_id", "hazard", "ac24h_mm")


@query("JOIN-26", fx.sql_with("points units", {}, "SELECT ua_id, u.escala, u.municipio, p.rd, p.hazard FROM units u JOIN points p USING (ua_id)"))
def refreshed_attributes(spark, sf):
    static = fx.units(spark, sf).select("ua_id", "escala", "municipio")
    return risk.refresh_attributes(fx.points(spark, sf), static).select("ua_id", "escala", "municipio", "rd", "hazard")


@query("FLT-22", fx.sql_with("units", {}, "SELECT ua_id, 0e0 AS ac96h_mm, 0 AS rd, 'Aguardando' AS nivel, 'NO_DATA' AS source FROM units"))
def seed_units(spark, sf):
    return risk.without_data(fx.units(spark, sf), "Aguardando").select("ua_id", "ac96h_mm", "rd", "nivel", "source")


@query("SET-01", fx.sql_with("units", {}, "SELECT ua_id, 'geo' AS hazard FROM units UNION ALL SELECT ua_id, 'hidro' FROM units"))
def channel_union(spark, sf):
    return risk.both_channels(fx.units(spark, sf)).select("ua_id", "hazard")


def clip(a: str, b: str, low: str, high: str) -> tuple[str, str]:
    """Part of a segment (from 0 to 1) whose coordinate, going from a to b, lies between low and high; (2, 2) if none can."""
    flat = lambda x: f"CASE WHEN {a} = {b} THEN CASE WHEN {a} BETWEEN {low} AND {high} THEN {x} ELSE 2 END ELSE "
    ends = f"(({low} - {a})/({b} - {a}), ({high} - {a})/({b} - {a}))"
    return f"{flat(0)} LEAST{ends} END", f"{flat(1)} GREATEST{ends} END"


CLIP_Y, CLIP_X = clip("l.lat1", "l.lat2", "r.lat0", "r.lat1"), clip("l.lon1", "l.lon2", "r.lon0", "r.lon1")


@query("JOIN-20", fx.sql_with("lines regions", {"m": f"SELECT road_id, regiao_id FROM lines l, regions r WHERE GREATEST(0, {CLIP_Y[0]}, {CLIP_X[0]}) <= LEAST(1, {CLIP_Y[1]}, {CLIP_X[1]})"},
       "SELECT road_id, MIN(regiao_id) AS regiao_id FROM (SELECT DISTINCT road_id FROM lines) LEFT JOIN m USING (road_id) GROUP BY road_id"))
def lines_touching_regions(spark, sf):
    return spatial.first_touched_region(fx.lines(spark, sf), risk.default_regions(spark), "road_id")


X1, Y1, X2, Y2 = "((lon1-lon)*111.32e0*cos(radians(lat)))", "((lat1-lat)*111.32e0)", "((lon2-lon)*111.32e0*cos(radians(lat)))", "((lat2-lat)*111.32e0)"
ALONG = f"GREATEST(0e0, LEAST(1e0, COALESCE(-({X1}*({X2}-{X1})+{Y1}*({Y2}-{Y1}))/NULLIF(pow({X2}-{X1},2)+pow({Y2}-{Y1},2), 0), 0e0)))"
LINE_KM = f"sqrt(pow({X1}+{ALONG}*({X2}-{X1}),2)+pow({Y1}+{ALONG}*({Y2}-{Y1}),2))"


@query("JOIN-28", fx.sql_with("units regions lines", {"v": "SELECT -23.6e0 AS lat, -45.5e0 AS lon", "sq": "SELECT n_nationkey AS area_id, -24e0 + ((n_nationkey*17)%80)::DOUBLE/100e0 AS y, -46.4e0 + ((n_nationkey*29)%160)::DOUBLE/100e0 AS x FROM nation"},
       f"""SELECT 'unit' AS layer, ua_id::VARCHAR AS id, ROUND({hav('u', 'v')}, 6) AS distance_km FROM units u, v WHERE {hav('u', 'v')} <= 20
    UNION ALL SELECT 'region', MIN(regiao_id)::VARCHAR, 0e0 FROM regions, v u WHERE {IN_BOX} HAVING COUNT(*) > 0
    UNION ALL SELECT 'road', road_id::VARCHAR, ROUND(MIN(d), 6) FROM (SELECT road_id, {LINE_KM} AS d FROM lines, v) WHERE d <= 20 GROUP BY road_id
    UNION ALL SELECT 'area', MIN(area_id)::VARCHAR, 0e0 FROM sq, v WHERE lat < y + 0.35e0 AND lat >= y AND lon < x + 0.35e0 AND lon >= x HAVING COUNT(*) > 0"""))
def layers_at_location(spark, sf):
    out = cycle.layers_at(-23.6, -45.5, fx.units(spark, sf), risk.default_regions(spark), tolerance_km=20.0, roads=fx.lines(spark, sf), areas=fx.areas(spark, sf))
    return out.withColumn("distance_km", F.round("distance_km", 6))


@query("SCL-34 SCL-07 SCL-27 SCL-35", fx.sql_with("points units", {}, f"""SELECT ua_id, hazard, GREATEST(0.15e0, rd/4e0, 0.6e0*LEAST(ac96h_mm/200e0, 1e0)) AS heat, {LABEL} AS nivel,
    p.sigla_rodovia || printf(' km %.1f-%.1f (R%s)', km0, km1 + 0.01e0, COALESCE(regiao_id::VARCHAR, 'None')) AS label, (km0+km1)/2e0 AS mid_km, replace(printf('%.1f', km0), '.', ',') AS km_text FROM points p JOIN units USING (ua_id)"""))
def unit_labels(spark, sf):
    p = fx.points(spark, sf).join(fx.units(spark, sf).select("ua_id", "km0", "km1"), "ua_id")
    return p.select("ua_id", "hazard", rk.heat_intensity(F.col("rd"), F.col("ac96h_mm")).alias("heat"), rk.level_label(F.col("rd")).alias("nivel"),
                    text.unit_label(F.col("sigla_rodovia"), F.col("km0"), F.col("km1") + 0.01, F.col("regiao_id")).alias("label"),
                    text.mid_km(F.col("km0"), F.col("km1")).alias("mid_km"), text.km_text(F.col("km0")).alias("km_text"))


@query("JOIN-19", fx.sql_with("units regions", {"placed": PLACED}, """SELECT u.ua_id, COALESCE(a.regiao_id, (SELECT MIN(regiao_id) FROM regions r WHERE (u.lat < lat1 AND u.lat >= lat0 AND u.lon + 0.05e0 < lon1 AND u.lon + 0.05e0 >= lon0)
    OR (u.lat < lat1 AND u.lat >= lat0 AND u.lon - 0.05e0 < lon1 AND u.lon - 0.05e0 >= lon0))) AS regiao_id FROM units u JOIN placed a USING (ua_id)"""))
def midpoint_region(spark, sf):
    """Region of the middle of a line, else the first region one of its ends touches."""
    u, r = fx.units(spark, sf), risk.default_regions(spark)
    ends = u.select("ua_id", "lat", F.explode(F.array(F.col("lon") - 0.05, F.col("lon") + 0.05)).alias("lon"))
    touched = spatial.containing_region(ends, r, name="t").groupBy("ua_id").agg(F.min("t").alias("t"))
    return spatial.containing_region(u, r).join(touched, "ua_id").select("ua_id", F.coalesce("regiao_id", "t").alias("regiao_id"))
