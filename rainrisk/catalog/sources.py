from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geo, text

from ..sources import feeds, tables
from ..streaming import history as hist
from . import query
from .rain import TXT

DEC = "lpad(((user_id*37)%100)::VARCHAR, 2, '0')"
ROWS = f"""SELECT event_id, user_id::VARCHAR AS station_prefix_id, CASE WHEN user_id%17=0 THEN 'n/a' ELSE '-23.' || {DEC} END AS latitude, CASE WHEN user_id%19=0 THEN '-80.5' ELSE '-45.' || {DEC} END AS longitude,
    CASE WHEN event_id%10=0 THEN NULL WHEN event_id%10=1 THEN '-1' ELSE value::VARCHAR END AS value, (event_id%5)::VARCHAR AS qtd, '10' AS gap, ts FROM events"""


def _rows(spark, sf):
    """Gauge feed rows as text, with the usual defects."""
    e, u = F.col("event_id"), F.col("user_id")
    digits = F.lpad(((u * 37) % 100).cast("string"), 2, "0")
    return fx.table(spark, sf, "events").select(
        e, u.cast("string").alias("station_prefix_id"), F.when(u % 17 == 0, "n/a").otherwise(F.concat(F.lit("-23."), digits)).alias("latitude"),
        F.when(u % 19 == 0, "-80.5").otherwise(F.concat(F.lit("-45."), digits)).alias("longitude"),
        F.when(e % 10 == 0, None).when(e % 10 == 1, "-1").otherwise(F.col("value").cast("string")).alias("value"),
        (e % 5).cast("string").alias("qtd"), F.lit("10").alias("measurement_gap"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("max_date"),
        F.date_format("ts", "yyyy/MM/dd HH").alias("date"), F.lit(None).cast("string").alias("station_name"), F.lit("x").alias("station_owner"), F.lit("y").alias("city"))


@query("SRC-03 SCL-20 SCL-29", fx.sql_with("", {"r": ROWS}, """SELECT station_prefix_id AS station_id, latitude::DOUBLE AS lat, longitude::DOUBLE AS lon, value::DOUBLE AS value_mm, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS observed_at,
    qtd::DOUBLE*10e0/60e0 AS coverage_hours FROM r WHERE latitude <> 'n/a' AND longitude <> '-80.5' AND value IS NOT NULL AND value <> '-1'"""))
def gauge_feed(spark, sf):
    out = feeds.gauges_now(_rows(spark, sf))
    return out.select("station_id", "lat", "lon", "value_mm", F.date_format("observed_at", TXT).alias("observed_at"), "coverage_hours")


@query("FLT-15", fx.sql_with("", {"r": ROWS}, f"""SELECT event_id FROM (SELECT user_id, event_id, ts FROM events) WHERE user_id%17<>0 AND user_id%19<>0 AND event_id%10 > 1 AND (event_id%6=0 OR date_trunc('second', ts) >= TIMESTAMP '{fx.TARGET}' - INTERVAL 3 HOURS)"""))
def fresh_stations(spark, sf):
    rows = _rows(spark, sf).withColumn("max_date", F.when(F.col("event_id") % 6 != 0, F.col("max_date"))).withColumn("station_name", F.col("event_id").cast("string"))
    out = feeds.fresh(feeds.gauges_now(rows), fx.target())
    return out.select(F.col("name").cast("long").alias("event_id"))


@query("SRC-04", fx.sql_with("", {"r": ROWS}, "SELECT station_prefix_id AS station_id, arg_max(latitude, event_id)::DOUBLE AS lat, arg_max(longitude, event_id)::DOUBLE AS lon FROM r WHERE latitude <> 'n/a' AND longitude <> '-80.5' GROUP BY 1"))
def station_list(spark, sf):
    return feeds.station_list(_rows(spark, sf), "event_id")


@query("SRC-05", fx.sql_with("", {"r": ROWS}, """SELECT station_prefix_id AS station_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hr, arg_max(value, event_id)::DOUBLE AS mm, arg_max(qtd, event_id)::INT AS qtd FROM r
    WHERE value IS NOT NULL AND value <> '-1' AND qtd <> '0' GROUP BY ALL"""))
def gauge_hour_feed(spark, sf):
    return feeds.gauge_hours(_rows(spark, sf), "event_id").withColumn("hr", F.date_format("hr", TXT))




@query("SRC-19", f"""SELECT event_id::VARCHAR AS station_id, value AS value_mm, (user_id%90)::DOUBLE AS lat, (user_id%60)::DOUBLE AS lon, CASE event_id%4 WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS observed_at
    FROM events WHERE NOT (user_id%90=0 AND user_id%60=0)""")
def alternative_feed(spark, sf):
    i, u, null = F.col("event_id"), F.col("user_id"), F.lit(None).cast("string")
    stamp = F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(
        i % 4 == 2, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    lat, lon, v = (u % 90).cast("string"), (u % 60).cast("string"), F.col("value").cast("string")
    pick = lambda c, a: (F.when(i % 2 == 0, c).alias(a[0]), F.when(i % 2 == 1, c).alias(a[1]))
    rows = fx.table(spark, sf, "events").select(
        i.cast("string").alias("codigo"), null.alias("id"), F.lit("n").alias("nome"), *pick(lat, ("latitude", "lat")), *pick(lon, ("longitude", "lon")), null.alias("municipio"),
        *pick(v, ("chuva_mm", "chuva")), null.alias("horas"), *pick(stamp, ("datahora", "data_hora")))
    return feeds.alternative_gauges(rows).select("station_id", "value_mm", "lat", "lon", F.date_format("observed_at", TXT).alias("observed_at"))


@query("SRC-18", """SELECT s_suppkey AS id, CASE WHEN s_suppkey%5=0 THEN '' ELSE 'SP-' || s_nationkey END AS rodovia, CASE WHEN s_suppkey%3=0 THEN '' ELSE s_suppkey::VARCHAR END AS km,
    CASE WHEN s_suppkey%15=0 THEN s_name WHEN s_suppkey%5=0 THEN s_suppkey::VARCHAR WHEN s_suppkey%3=0 THEN 'SP-' || s_nationkey ELSE 'SP-' || s_nationkey || ' · ' || s_suppkey END AS label,
    'cam_' || s_suppkey || '/stream.m3u8' AS stream_path, s_suppkey%4=2 AS maintenance, s_suppkey%4=1 AS online FROM supplier""")
def camera_list(spark, sf):
    s = F.col("s_suppkey")
    rows = fx.table(spark, sf, "supplier").select(
        s.alias("id"), F.when(s % 5 == 0, None).otherwise(F.concat(F.lit(" SP-"), F.col("s_nationkey").cast("string"))).alias("rodovia"),
        F.when(s % 3 != 0, s.cast("string")).alias("km"), F.col("s_name").alias("nome"), F.lit(None).cast("string").alias("local"), F.lit("-23.5").alias("lat"), F.lit("x").alias("lng"),
        F.when(s % 4 == 3, "bad").otherwise((s % 4).cast("string")).alias("status"), F.lit("N").alias("sentido"))
    return feeds.cameras(rows).select("id", "rodovia", "km", "label", "stream_path", "maintenance", "online")


@query("SRC-13", """SELECT o_orderkey AS k, o_orderstatus AS outcome FROM orders WHERE o_orderkey%9<>0 AND o_orderkey%11<>0""")
def telemetry_records(spark, sf):
    """JSON lines with corrupt and incomplete records mixed in."""
    k = F.col("o_orderkey")
    line = F.when(k % 9 == 0, F.lit('{"started_at": "2024-')).otherwise(F.to_json(F.struct(
        F.when(k % 11 != 0, F.date_format("o_orderdate", TXT)).alias("started_at"), F.col("o_orderstatus").alias("outcome"), k.cast("int").alias("files_ok"))))
    parsed = fx.table(spark, sf, "orders").select(k.alias("k"), F.from_json(line, tables.CYCLE_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("k", "r.*")
    return tables.telemetry_rows(parsed.where(F.col("outcome").isNotNull())).select("k", "outcome")


@query("SRC-16 STR-13", """SELECT n AS name, strftime(strptime(substr(n, 10, 8), '%Y%m%d'), '%Y-%m-%d') AS reference_date FROM (
    SELECT MAX('observed_20' || lpad(((event_id*7)%9 + 10)::VARCHAR, 2, '0') || '0' || (event_id%9+1) || '15.nc') AS n FROM events)""")
def newest_product(spark, sf):
    i = F.col("event_id")
    name = F.concat(F.lit("observed_20"), F.lpad(((i * 7) % 9 + 10).cast("string"), 2, "0"), F.lit("0"), (i % 9 + 1).cast("string"), F.lit("15.nc"))
    names = fx.table(spark, sf, "events").select(name.alias("name"))
    return tables.newest_file(names, r"^observed_\d{8}\.nc$").withColumn("reference_date", F.date_format("reference_date", "yyyy-MM-dd"))


@query("STR-13", """SELECT 'run_' || lpad(MAX(o_orderkey)::VARCHAR, 12, '0') || '.nc' AS name, TRUE AS due FROM orders""")
def product_run_due(spark, sf):
    o = fx.table(spark, sf, "orders")
    files = o.select(F.concat(F.lit("run_"), F.format_string("%012d", "o_orderkey"), F.lit(".nc")).alias("name"))
    marker = o.select(F.lit("run_000000000001.nc").alias("file"), F.lit(True).alias("completed"), F.to_date(F.lit("2024-01-01")).alias("product_date"), F.col("o_orderkey").alias("run_at"))
    return hist.needs_run(files, marker, r"^run_\d{12,}\.nc$").select("name", "due")


@query("SCL-19 SCL-20 SCL-21", """SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 6e0 WHEN 1 THEN 13e0 WHEN 2 THEN 99e0 ELSE 99e0 END AS limit_sum, CASE WHEN c_custkey%3=0 THEN NULL ELSE round_even(c_custkey/2e0, 0)::INT END AS half,
    c_custkey%5 IN (0, 1, 2) AS flag FROM customer""")
def coerced_values(spark, sf):
    k = F.col("c_custkey")
    limits = F.element_at(F.array(F.lit("1; 2;3"), F.lit("[6,7]"), F.lit("1;x"), F.lit("")), (k % 4 + 1).cast("int"))
    flag = F.element_at(F.array(F.lit("True "), F.lit("1.0"), F.lit("YES"), F.lit("no"), F.lit(None)), (k % 5 + 1).cast("int"))
    number = F.when(k % 3 == 0, "NaN").otherwise((k / 2.0).cast("string"))
    default = F.array(F.lit(99.0))
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.aggregate(text.parse_thresholds(limits, default), F.lit(0.0), lambda a, x: a + x).alias("limit_sum"),
        text.to_int(number).alias("half"), text.to_bool(flag).alias("flag"))


@query("SCL-24 SCL-25 SCL-36 SCL-22", """SELECT n_nationkey, CASE n_nationkey%3 WHEN 0 THEN 'data/fire/x.csv' WHEN 1 THEN 'y' || n_nationkey || '.csv' ELSE '—' END AS path, 'SP-0' || n_nationkey AS road, 'CGR.' || n_nationkey AS office, 'São Sebastião' AS town FROM nation""")
def cleaned_text(spark, sf):
    n = F.col("n_nationkey")
    path = F.when(n % 3 == 0, F.lit("C:\\dev\\data\\fire\\x.csv")).when(n % 3 == 1, F.concat(F.lit("/tmp/y"), n.cast("string"), F.lit(".csv")))
    return fx.table(spark, sf, "nation").select(
        n, text.clean_path(path).alias("path"), text.normalize_road(F.concat(F.lit(" sp 0"), n.cast("string"))).alias("road"),
        text.office_code(F.concat(F.lit(" DR."), n.cast("string"))).alias("office"),
        text.repair_mojibake(F.when(n % 2 == 0, "SÃ£o SebastiÃ£o").otherwise("São Sebastião")).alias("town"))


@query("SCL-42 SRC-23", """SELECT s_suppkey, CASE WHEN s_suppkey%7=0 THEN 1 ELSE 2 END::INT AS classes, (s_suppkey%7 + 3)::INT AS units FROM supplier""")
def parsed_distributions(spark, sf):
    s = F.col("s_suppkey")
    js = F.concat(F.lit('{"0": 3, "1": 0, "4": '), (s % 7).cast("string"), F.lit("}"))
    d = text.parse_distribution(js)
    return fx.table(spark, sf, "supplier").select("s_suppkey", F.size(d).alias("classes"), F.aggregate(F.map_values(d), F.lit(0), lambda a, x: a + x).alias("units"))


@query("SCL-37", """SELECT event_id, CASE WHEN event_id%3=0 THEN '{"type":"Polygon","coordinates":[[[1.0,2.0],[3.0,4.0],[' || (event_id%50) || '.5,6.0],[1.0,2.0]]]}' WHEN event_id%3=1
    THEN '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0],[' || (event_id%50) || '.5,6.0]]}' END AS g FROM events""")
def ring_geometry(spark, sf):
    i = F.col("event_id")
    p = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    whole = F.array(p(F.lit(2.0), F.lit(1.0)), p(F.lit(4.0), F.lit(3.0)), p(F.lit(6.0), (i % 50 + 0.5).cast("double")))
    ring = F.when(i % 3 == 2, F.slice(whole, 1, 1)).otherwise(whole)
    return fx.table(spark, sf, "events").select("event_id", geo.ring_to_geojson(ring, F.when(i % 3 == 0, "polygon").otherwise("polyline")).alias("g"))


@query("SCL-27", """SELECT c_custkey, 'UA-R' || c_nationkey || '-M-25K-' || CASE WHEN c_custkey > 999 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 3, '0') END AS ua_id FROM customer""")
def unit_ids(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", text.unit_id(F.col("c_nationkey"), F.lit("M"), F.lit("25K"), F.col("c_custkey")).alias("ua_id"))


@query("SCL-38", fx.sql_with("axis_vertices", {"s": """SELECT a.region, a.seq, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, sqrt(pow(b.lat-a.lat, 2)+pow(b.lon-a.lon, 2)) AS len FROM axis_vertices a JOIN axis_vertices b ON a.region=b.region AND b.seq=a.seq+1""",
       "c": "SELECT *, SUM(len) OVER (PARTITION BY region ORDER BY seq) - len AS before, SUM(len) OVER (PARTITION BY region) AS total FROM s"}, """SELECT region, i::INT AS sample, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon FROM (
    SELECT region, i, lat1 + (lat2-lat1)*(i*total/6e0-before)/len AS lat, lon1 + (lon2-lon1)*(i*total/6e0-before)/len AS lon, row_number() OVER (PARTITION BY region, i ORDER BY seq) AS rn FROM c, range(7) r(i) WHERE i*total/6e0 >= before - 1e-9 AND i*total/6e0 <= before + len + 1e-9) WHERE rn=1"""))
def line_samples(spark, sf):
    from ..operators.spatial import axis_segments, sample_line

    return sample_line(axis_segments(fx.axes(spark, sf)), "region", 7).select("region", "sample", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SCL-40", fx.sql_with("axis_vertices", {}, """SELECT a.region, a.seq::INT AS seq, i::INT AS step, ROUND(a.lat + (b.lat-a.lat)*i/4e0, 6) AS lat, ROUND(a.lon + (b.lon-a.lon)*i/4e0, 6) AS lon FROM axis_vertices a JOIN axis_vertices b ON a.region=b.region AND b.seq=a.seq+1, range(4) r(i)"""))
def densified_axes(spark, sf):
    from ..operators.spatial import axis_segments, densify

    return densify(axis_segments(fx.axes(spark, sf)), 4).select("region", "seq", "step", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SCL-01 SCL-02 SCL-03 SCL-04 SCL-08", fx.sql_with("points", {}, """SELECT ua_id, hazard, (CASE WHEN ra=0 OR rd=0 THEN 0 ELSE LEAST(4, ra+rd-1) END)::INT AS level, len([x FOR x IN [1e0,3e0,6e0,15e0] IF cpc >= x])::INT AS icc,
    CASE WHEN ac96h_mm <= 0.5e0 THEN 0e0 ELSE ROUND(intensity_mmh/(400e0*pow(ac96h_mm, -0.9e0)), 6) END AS cpc_calc, CASE WHEN cpc/25e0 < 0.15e0 THEN 'minimo' WHEN cpc/25e0 <= 0.4e0 THEN 'baixo' WHEN cpc/25e0 <= 0.7e0 THEN 'medio' WHEN cpc/25e0 <= 0.95e0 THEN 'alto' ELSE 'critico' END AS rf FROM points"""))
def sql_functions(spark, sf):
    """The registered SQL functions on whole tables."""
    from ..functions.register import register

    register(spark)
    return fx.points(spark, sf).selectExpr(
        "ua_id", "hazard", "risk_level(ra, rd) AS level", "class_from_breaks(cpc, array(1D, 3D, 6D, 15D)) AS icc",
        "round(cpc_index(intensity_mmh, ac96h_mm, 400D), 6) AS cpc_calc", "rf_class(cpc / 25D) AS rf")


@query("SRC-10 JOIN-25", fx.sql_with("points regions", {}, "SELECT p.sigla_rodovia, r.regiao_id, COUNT(*) AS n, MAX(r.k_geo) AS k_geo FROM points p JOIN regions r USING (regiao_id) GROUP BY ALL"))
def region_constants(spark, sf):
    from ..sources.geojson import regions_or_default

    r = regions_or_default(spark, "/nonexistent/regions.geojson").select("regiao_id", "k_geo")
    return fx.points(spark, sf).join(r, "regiao_id").groupBy("sigla_rodovia", "regiao_id").agg(F.count(F.lit(1)).alias("n"), F.max("k_geo").alias("k_geo"))


