"""Domain tables derived from the driver's tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .constants import REGIONS

TARGET = "2024-01-30 18:00:00"


def target() -> Column:
    return F.lit(TARGET).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.abs(F.col(column)) * 100).cast("long")


def _d(c: Column, by: float = 1.0) -> Column:
    return c.cast("double") / F.lit(by)


def stations(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(
        u.alias("station_id"), (F.lit(-24.0) + _d((u * 37) % 100, 100.0)).alias("lat"), (F.lit(-46.4) + _d((u * 53) % 160, 100.0)).alias("lon"))


def recent_events(spark, sf, hours: int | None):
    """Events, or only those of the last hours up to the target: a range on ``ts`` that the scan prunes with."""
    events = table(spark, sf, "events")
    if hours is None:
        return events
    kind = events.schema["ts"].dataType.simpleString()
    end = datetime.fromisoformat(TARGET) + timedelta(hours=1)
    bound = lambda t: F.lit(str(t)).cast(kind)
    return events.where((F.col("ts") >= bound(end - timedelta(hours=hours))) & (F.col("ts") < bound(end)))


def gauge_hourly(spark, sf, hours: int | None = None):
    return recent_events(spark, sf, hours).groupBy(F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("hr")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(1000.0)).alias("mm"), F.count(F.lit(1)).alias("qtd"))


def grid_hourly(spark, sf, hours: int | None = None):
    return recent_events(spark, sf, hours).groupBy(
        (F.col("user_id") % 9).cast("int").alias("lat_idx"), (F.col("event_id") % 16).cast("int").alias("lon_idx"),
        F.date_trunc("hour", "ts").alias("hr")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(200.0)).alias("mm"))


def units(spark, sf):
    k = F.col("c_custkey")
    lat, lon = (k * 29) % 82, (k * 47) % 160
    km0 = _d((k * 7) % 1000, 10.0)
    return table(spark, sf, "customer").select(
        k.alias("ua_id"), F.col("c_mktsegment").alias("sigla_rodovia"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("road"),
        km0.alias("km0"), (km0 + F.lit(0.35)).alias("km1"),
        (F.lit(-24.0) + _d(lat, 100.0)).alias("lat"), (F.lit(-46.4) + _d(lon, 100.0)).alias("lon"),
        F.floor(lat / 10).cast("int").alias("lat_idx"), F.floor(lon / 10).cast("int").alias("lon_idx"),
        (k % 5).cast("int").alias("RAGEO"), ((k * 3) % 4).cast("int").alias("RAHID"),
        F.element_at(F.array(F.lit("25K"), F.lit("10K"), F.lit("1K")), (k % 3 + 1).cast("int")).alias("escala"),
        F.concat(F.lit("M"), F.col("c_nationkey").cast("string")).alias("municipio"),
        (k % 11 == 0).alias("trecho_critico_geo"), (k % 13 == 0).alias("trecho_critico_hid"),
        F.when(k % 5 == 0, k % 6 - 1).otherwise(F.floor(km0 / 4) % 6 - 1).cast("int").alias("cls"))


def segments(spark, sf):
    k = F.col("p_partkey")
    km0 = _d(k % 100)
    return table(spark, sf, "part").select(
        k.alias("trecho_id"), F.col("p_brand").alias("road"), km0.alias("r0"), (km0 + _d(F.col("p_size"), 10.0)).alias("r1"),
        F.col("p_type").alias("regional"),
        F.when(k % 3 == 0, "DUP").when(k % 3 == 1, "IMP").otherwise("PAV").alias("tipo_pista"),
        _d(F.col("p_size"), 10.0).alias("extensao"), (k % 4 == 0).alias("monitored"))


def fire_samples(spark, sf):
    f = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("trecho_id"), F.when(f == "A", "observado").when(f == "N", "D+1").otherwise("D+2").alias("horizonte"),
        (F.round(F.col("l_discount") * 100).cast("int").cast("double") / F.lit(10.0)).alias("rf"))


def fire_classes(spark, sf):
    """Stand-in product, one row per order line: cheap class rows for the report queries."""
    q = F.col("l_quantity").cast("long")
    names = F.array(*[F.lit(c) for c in ("minimo", "baixo", "medio", "alto", "critico", "SEM_DADO", "outro")])
    f = F.col("l_returnflag")
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("trecho_id"), F.when(f == "A", "observado").when(f == "N", "D+1").otherwise("D+2").alias("horizonte")).agg(
        F.max(q).alias("_q"), F.max(F.col("l_suppkey")).alias("_s")).select(
        "trecho_id", "horizonte", F.element_at(names, (F.col("_q") % 7 + 1).cast("int")).alias("rf_classe"),
        (F.col("_q") / F.lit(50.0)).alias("rf_valor"), F.concat(F.lit("CGR."), (F.col("_s") % 9).cast("string")).alias("regional"))


CYCLE_MAXIMA = {"ac24h_max": 997, "ac96h_max": 1999, "intensity_max": 401}


def cycles(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.col("o_orderstatus")
    started = F.timestamp_seconds(F.lit(1704067200) + (o * 10 + c % 7) * 60)
    return table(spark, sf, "orders").select(
        o.alias("cycle_id"), started.alias("started_at"),
        F.when(s == "F", "ok").when(s == "O", "error").otherwise("skipped").alias("outcome"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("duration_s"), (96 - c % 10).cast("int").alias("files_ok"),
        (c % 7).cast("int").alias("alert_count"), (c % 8).cast("int").alias("missing_24h"),
        F.when(c % 8 == 0, "ok").otherwise("degraded").alias("data_status"), *[(c % m / F.lit(10.0)).alias(n) for n, m in CYCLE_MAXIMA.items()],
        F.when(c % 3 > 0, F.struct((o % 2 == 0).alias("applied"), (c % 13 / F.lit(10.0)).alias("mean_factor"), (c % 17).cast("int").alias("stations_recent"),
                                   (c % 19).cast("int").alias("points_corrected"))).alias("gauge"),
        F.array(*[((c + i) % 9).cast("int") for i in range(5)]).alias("by_level"), (o % 5).cast("int").alias("max_rd"))


def history(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("ua_id"), F.when(o % 4 == 0, "hidro").otherwise("geo").alias("hazard"), F.col("o_orderdate").alias("ts"),
        o.alias("cycle_id"), (F.floor("o_totalprice") % 5).cast("int").alias("rd"))


def points(spark, sf):
    k, c = F.col("c_custkey"), _cents("c_acctbal")
    region = F.nullif((F.col("c_nationkey") % 6).cast("int"), F.lit(0))
    names = F.element_at(F.array(*[F.lit(r[1]) for r in REGIONS], F.lit(None)), F.coalesce(region, F.lit(5)))
    base = table(spark, sf, "customer").select(
        k.alias("ua_id"), region.alias("regiao_id"), names.alias("region_name"), F.col("c_mktsegment").alias("sigla_rodovia"),
        _d(c % 20000, 100.0).alias("ac24h_mm"), _d((c * 3) % 40000, 100.0).alias("ac96h_mm"), _d(c % 3000, 100.0).alias("intensity_mmh"),
        _d(c % 2500, 100.0).alias("cpc"), (k % 5).cast("int").alias("RAGEO"), ((k * 3) % 4).cast("int").alias("RAHID"),
        (c % 5).cast("int").alias("rd_geo"), ((c + k) % 5).cast("int").alias("rd_hid"), F.when(k % 50 == 0, "NO_DATA").otherwise("SATELLITE").alias("source"))
    both = F.explode(F.array(
        F.struct(F.lit("geo").alias("hazard"), F.col("rd_geo").alias("rd"), F.col("RAGEO").alias("ra")),
        F.struct(F.lit("hidro").alias("hazard"), F.col("rd_hid").alias("rd"), F.col("RAHID").alias("ra"))))
    return base.withColumn("_c", both).select("*", "_c.*").drop("_c")


def stretches(spark, sf):
    """Official stretches: ordered, with a class and a distribution of units per class."""
    s = F.col("s_suppkey")
    km0 = _d((s * 13) % 95)
    return table(spark, sf, "supplier").select(
        s.alias("ord"), F.concat(F.lit("Brand#"), (s % 25 + 1).cast("string")).alias("road"), km0.alias("r0"),
        (km0 + _d(F.lit(3) + F.col("s_nationkey"))).alias("r1"), (s % 5).cast("int").alias("ra"),
        F.when(s % 2 == 0, "GEO").otherwise("HID").alias("kind"),
        F.create_map(*[x for i, n in enumerate((3, 7, 5, 2, 4)) for x in (F.lit(i), (s % n).cast("int"))]).alias("dist"), (s % 5).cast("int").alias("icc"))


def forecast_grid(spark, sf):
    """Six-hourly runs; the 24 h lead of every third day is missing."""
    run = (F.floor(F.unix_timestamp("hr") / 21600) * 21600).cast("timestamp")
    base = grid_hourly(spark, sf).groupBy(run.alias("run"), "lat_idx", "lon_idx").agg(F.sum(F.round(F.col("mm") * 100).cast("long")).alias("_m"))
    leads = base.withColumn("lead", F.explode(F.array(*[F.lit(6 * i) for i in range(9)])))
    leads = leads.where(~((F.col("lead") == 24) & (F.dayofmonth("run") % 3 == 0)))
    return leads.select("run", (F.col("run") + F.make_interval(hours=F.col("lead"))).alias("valid"), "lat_idx", "lon_idx",
                        (F.col("_m") * F.col("lead") / F.lit(2400.0)).alias("acc_mm"))


def stations_24h(spark, sf):
    day = gauge_hourly(spark, sf, 24).where((F.col("hr") > target() - F.expr("INTERVAL 24 HOURS")) & (F.col("hr") <= target()))
    sums = day.groupBy("station_id").agg((F.sum(F.round(F.col("mm") * 1000).cast("long")) / F.lit(1000.0)).alias("value_mm"),
                                         (F.count(F.lit(1)) * 8.0).alias("coverage_hours"))
    # the south of the area stays dry
    dry = F.when(F.col("lat") < -23.5, F.col("value_mm") / 10.0).otherwise(F.col("value_mm"))
    return stations(spark, sf).join(sums, "station_id").withColumn("value_mm", dry)


def lines(spark, sf):
    """A line of two segments through every unit position."""
    k = F.col("c_custkey")
    at = {"lat": (82, 29, 60, 13), "lon": (160, 47, 80, 19)}
    start = {a: (F.lit(-24.0 if a == "lat" else -46.4) + _d((k * f) % m, 100.0)) for a, (m, f, _, _) in at.items()}
    move = {a: _d((k * f) % m - m // 2, 100.0) for a, (_, _, m, f) in at.items()}
    far = {a: start[a] + move[a] for a in at}
    back = {"lat": far["lat"] + _d(k % 7, 50.0), "lon": far["lon"]}
    piece = lambda seq, p, q: F.struct(F.lit(seq).alias("seq"), *[(x[a]).alias(f"{a}{i}") for i, x in ((1, p), (2, q)) for a in at])
    return table(spark, sf, "customer").select(k.alias("road_id"), F.inline(F.array(piece(0, start, far), piece(1, far, back))))


def areas(spark, sf):
    """One square per TPC-H nation."""
    n = F.col("n_nationkey")
    lat, lon = F.lit(-24.0) + _d((n * 17) % 80, 100.0), F.lit(-46.4) + _d((n * 29) % 160, 100.0)
    corner = lambda y, x: F.struct((lat + F.lit(y)).alias("lat"), (lon + F.lit(x)).alias("lon"))
    return table(spark, sf, "nation").select(n.alias("area_id"), F.array(corner(0.0, 0.0), corner(0.0, 0.35), corner(0.35, 0.35), corner(0.35, 0.0)).alias("polygon"))


def axes(spark, sf):
    """One polyline per TPC-H region over its nations."""
    n = F.col("n_nationkey")
    v = F.struct((F.lit(-24.0) + _d((n * 17) % 80, 100.0)).alias("lat"), (F.lit(-46.4) + _d((n * 29) % 160, 100.0)).alias("lon"))
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("int").alias("regiao_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(n.alias("n"), v.alias("v")))), lambda s: s["v"]).alias("eixo"))


_SQL = {
    "stations": """SELECT DISTINCT user_id AS station_id, -24e0 + ((user_id*37)%100)::DOUBLE/100e0 AS lat,
        -46.4e0 + ((user_id*53)%160)::DOUBLE/100e0 AS lon FROM events""",
    "gauge_hourly": """SELECT user_id AS station_id, date_trunc('hour', ts) AS hr,
        SUM(ROUND(value*100)::BIGINT)::DOUBLE/1000e0 AS mm, COUNT(*) AS qtd FROM events GROUP BY ALL""",
    "grid_hourly": """SELECT (user_id%9)::INT AS lat_idx, (event_id%16)::INT AS lon_idx, date_trunc('hour', ts) AS hr,
        SUM(ROUND(value*100)::BIGINT)::DOUBLE/200e0 AS mm FROM events GROUP BY ALL""",
    "units": """SELECT *, CASE WHEN ua_id%5=0 THEN ua_id%6-1 ELSE (floor(km0/4e0)::BIGINT)%6-1 END::INT AS cls FROM (
        SELECT c_custkey AS ua_id, c_mktsegment AS sigla_rodovia, 'Brand#'||(c_custkey%25+1) AS road,
        ((c_custkey*7)%1000)::DOUBLE/10e0 AS km0, ((c_custkey*7)%1000)::DOUBLE/10e0 + 0.35e0 AS km1,
        -24e0 + ((c_custkey*29)%82)::DOUBLE/100e0 AS lat, -46.4e0 + ((c_custkey*47)%160)::DOUBLE/100e0 AS lon,
        (((c_custkey*29)%82)//10)::INT AS lat_idx, (((c_custkey*47)%160)//10)::INT AS lon_idx,
        (c_custkey%5)::INT AS RAGEO, ((c_custkey*3)%4)::INT AS RAHID,
        ['25K','10K','1K'][(c_custkey%3+1)] AS escala, 'M'||c_nationkey AS municipio,
        c_custkey%11=0 AS trecho_critico_geo, c_custkey%13=0 AS trecho_critico_hid FROM customer)""",
    "segments": """SELECT p_partkey AS trecho_id, p_brand AS road, (p_partkey%100)::DOUBLE AS r0,
        (p_partkey%100)::DOUBLE + p_size::DOUBLE/10e0 AS r1, p_type AS regional,
        CASE p_partkey%3 WHEN 0 THEN 'DUP' WHEN 1 THEN 'IMP' ELSE 'PAV' END AS tipo_pista,
        p_size::DOUBLE/10e0 AS extensao, p_partkey%4=0 AS monitored FROM part""",
    "fire_samples": """SELECT l_partkey AS trecho_id, CASE l_returnflag WHEN 'A' THEN 'observado' WHEN 'N' THEN 'D+1' ELSE 'D+2' END AS horizonte,
        ROUND(l_discount*100)::INT::DOUBLE/10e0 AS rf FROM lineitem""",
    "fire_classes": """SELECT trecho_id, horizonte, ['minimo','baixo','medio','alto','critico','SEM_DADO','outro'][(q%7+1)] AS rf_classe,
        q::DOUBLE/50e0 AS rf_valor, 'CGR.'||(s%9) AS regional FROM (
        SELECT l_partkey AS trecho_id, CASE l_returnflag WHEN 'A' THEN 'observado' WHEN 'N' THEN 'D+1' ELSE 'D+2' END AS horizonte,
        MAX(l_quantity::BIGINT) AS q, MAX(l_suppkey) AS s FROM lineitem GROUP BY ALL)""",
    "cycles": """SELECT o_orderkey AS cycle_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey*10 + o_custkey%7) AS started_at,
        CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'skipped' END AS outcome, o_totalprice/1000e0 AS duration_s,
        (96-o_custkey%10)::INT AS files_ok, (o_custkey%7)::INT AS alert_count, (o_custkey%8)::INT AS missing_24h,
        [((o_custkey+i)%9)::INT FOR i IN [0,1,2,3,4]] AS by_level, (o_orderkey%5)::INT AS max_rd, CASE WHEN o_custkey%8=0 THEN 'ok' ELSE 'degraded' END AS data_status, (o_custkey%997)/10e0 AS ac24h_max, (o_custkey%1999)/10e0 AS ac96h_max, (o_custkey%401)/10e0 AS intensity_max,
        CASE WHEN o_custkey%3>0 THEN {'applied': o_orderkey%2=0, 'mean_factor': (o_custkey%13)/10e0, 'stations_recent': (o_custkey%17)::INT, 'points_corrected': (o_custkey%19)::INT} END AS gauge FROM orders""",
    "history": """SELECT o_custkey AS ua_id, CASE WHEN o_orderkey%4=0 THEN 'hidro' ELSE 'geo' END AS hazard, o_orderdate AS ts,
        o_orderkey AS cycle_id, (floor(o_totalprice)::BIGINT%5)::INT AS rd FROM orders""",
    "points": """SELECT b.*, h.hazard, CASE h.hazard WHEN 'geo' THEN rd_geo ELSE rd_hid END AS rd,
        CASE h.hazard WHEN 'geo' THEN RAGEO ELSE RAHID END AS ra FROM (
        SELECT c_custkey AS ua_id, NULLIF(c_nationkey%6, 0)::INT AS regiao_id,
        CASE c_nationkey%6 WHEN 1 THEN 'Mogi-Bertioga' WHEN 2 THEN 'Caraguatatuba-Ubatuba' WHEN 3 THEN 'São Sebastião' WHEN 4 THEN 'Santos-Bertioga' END AS region_name,
        c_mktsegment AS sigla_rodovia, (c%20000)::DOUBLE/100e0 AS ac24h_mm, ((c*3)%40000)::DOUBLE/100e0 AS ac96h_mm, (c%3000)::DOUBLE/100e0 AS intensity_mmh,
        (c%2500)::DOUBLE/100e0 AS cpc, (c_custkey%5)::INT AS RAGEO, ((c_custkey*3)%4)::INT AS RAHID, (c%5)::INT AS rd_geo, ((c+c_custkey)%5)::INT AS rd_hid,
        CASE WHEN c_custkey%50=0 THEN 'NO_DATA' ELSE 'SATELLITE' END AS source
        FROM (SELECT *, ROUND(ABS(c_acctbal)*100)::BIGINT AS c FROM customer)) b, (VALUES ('geo'),('hidro')) h(hazard)""",
    "stretches": """SELECT s_suppkey AS ord, 'Brand#'||(s_suppkey%25+1) AS road, ((s_suppkey*13)%95)::DOUBLE AS r0,
        ((s_suppkey*13)%95)::DOUBLE + (3+s_nationkey)::DOUBLE AS r1, (s_suppkey%5)::INT AS ra,
        CASE WHEN s_suppkey%2=0 THEN 'GEO' ELSE 'HID' END AS kind,
        s_suppkey%3 AS d0, s_suppkey%7 AS d1, s_suppkey%5 AS d2, s_suppkey%2 AS d3, s_suppkey%4 AS d4, (s_suppkey%5)::INT AS icc FROM supplier""",
    "forecast_grid": """SELECT run, run + to_hours(lead) AS valid, lat_idx, lon_idx, (m*lead)::DOUBLE/2400e0 AS acc_mm FROM (
        SELECT time_bucket(INTERVAL 6 HOURS, hr, TIMESTAMP '2024-01-01 00:00:00') AS run, lat_idx, lon_idx, SUM(ROUND(mm*100)::BIGINT)::BIGINT AS m
        FROM grid_hourly GROUP BY ALL), (SELECT unnest([0,6,12,18,24,30,36,42,48]) AS lead) WHERE NOT (lead=24 AND day(run)%3=0)""",
    "stations_24h": f"""SELECT s.*, CASE WHEN s.lat < -23.5e0 THEN d.value_mm/10e0 ELSE d.value_mm END AS value_mm, d.coverage_hours FROM stations s JOIN (
        SELECT station_id, SUM(ROUND(mm*1000)::BIGINT)::DOUBLE/1000e0 AS value_mm, COUNT(*)*8e0 AS coverage_hours FROM gauge_hourly
        WHERE hr > TIMESTAMP '{TARGET}' - INTERVAL 24 HOURS AND hr <= TIMESTAMP '{TARGET}' GROUP BY station_id) d USING (station_id)""",
    "lines": """SELECT road_id, seq, CASE seq WHEN 0 THEN a ELSE c END AS lat1, CASE seq WHEN 0 THEN b ELSE d END AS lon1, CASE seq WHEN 0 THEN c ELSE c + (road_id%7)::DOUBLE/50e0 END AS lat2, d AS lon2
        FROM (SELECT c_custkey AS road_id, -24e0 + ((c_custkey*29)%82)::DOUBLE/100e0 AS a, -46.4e0 + ((c_custkey*47)%160)::DOUBLE/100e0 AS b,
        -24e0 + ((c_custkey*29)%82)::DOUBLE/100e0 + ((c_custkey*13)%60 - 30)::DOUBLE/100e0 AS c, -46.4e0 + ((c_custkey*47)%160)::DOUBLE/100e0 + ((c_custkey*19)%80 - 40)::DOUBLE/100e0 AS d
        FROM customer), (VALUES (0), (1)) s(seq)""",
    "axis_vertices": """SELECT n_regionkey::INT AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1 AS seq,
        -24e0 + ((n_nationkey*17)%80)::DOUBLE/100e0 AS lat, -46.4e0 + ((n_nationkey*29)%160)::DOUBLE/100e0 AS lon FROM nation""",
    "regions": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{n}', '{r}', {k}e0, {[float(x) for x in c]}::DOUBLE[], {[float(x) for x in h]}::DOUBLE[], "
        f"{min(p[0] for p in ring)}e0, {max(p[0] for p in ring)}e0, {min(p[1] for p in ring)}e0, {max(p[1] for p in ring)}e0)"
        for i, n, r, k, c, h, ring in REGIONS) + ") t(regiao_id, regiao_nome, sigla_rodovia, k_geo, cpc_breaks, hid24h_breaks, lat0, lat1, lon0, lon1)",
}
_NEEDS = {"forecast_grid": ["grid_hourly"], "stations_24h": ["stations", "gauge_hourly"]}


def values_sql(rows, names: str) -> str:
    """A fixed table of the constants as a query of the oracle."""
    def cell(v):
        if isinstance(v, tuple):
            return f"[{', '.join(map(cell, v))}]"
        return repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def sql_with(names: str, extra: dict[str, str], body: str) -> str:
    """``WITH`` over adapter tables (space-separated names) and extra named queries."""
    order: list[str] = []
    for n in names.split():
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({_SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
