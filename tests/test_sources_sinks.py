import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rainrisk.functions import predicates, text
from rainrisk.operators import fire, risk
from rainrisk.sinks import outputs
from rainrisk.sources import feeds, geojson, tables


def dump(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def feature(props, kind, coordinates):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


def test_gauge_documents_in_three_shapes(spark, tmp_path):
    rows = [{"station_prefix_id": 1, "latitude": "-23.5", "longitude": -45.5, "value": 3, "qtd": 6, "measurement_gap": 10, "max_date": "2026-01-01T10:00:00Z"},
            {"station_prefix_id": 2, "latitude": "x", "longitude": -45.5, "value": 3}, {"station_prefix_id": 3, "latitude": -23.5, "longitude": -45.5, "value": -1},
            {"station_prefix_id": 4, "latitude": -23.4, "longitude": -45.4, "value": "0"}, {"station_prefix_id": 5, "latitude": 48.0, "longitude": 2.0, "value": 1}]
    for name, doc in (("a", {"measurements": rows}), ("b", {"data": rows}), ("c", rows)):
        path = dump(tmp_path / f"{name}.json", doc)
        got = feeds.gauges_now(feeds.json_rows(spark, path, feeds.GAUGE_ROW, ("measurements", "data"))).orderBy("station_id").collect()
        assert [(r.station_id, r.value_mm, r.coverage_hours) for r in got] == [("1", 3.0, 1.0), ("4", 0.0, None)]
        assert got[0].observed_at == datetime(2026, 1, 1, 10)
    now = F.lit("2026-01-01 13:30:00").cast("timestamp")
    assert [r.station_id for r in feeds.fresh(feeds.gauges_now(feeds.json_rows(spark, str(tmp_path / "a.json"), feeds.GAUGE_ROW, ("measurements", "data"))), now).collect()] == ["4"]


def test_alternative_feed_key_and_zero_place(spark, tmp_path):
    rows = [{"codigo": "A", "latitude": -23.0, "longitude": -45.0, "chuva": 2.5, "data_hora": "05/01/2026 10:00:00"}, {"id": 7, "lat": 0, "lon": 0, "chuva_mm": 1},
            {"id": 8, "lat": -22.0, "lon": -44.0, "chuva_mm": 1.0, "horas": 6}]
    path = dump(tmp_path / "alt.json", {"dados": rows})
    got = {r.station_id: r for r in feeds.alternative_gauges(feeds.json_rows(spark, path, feeds.ALTERNATIVE_ROW, ("dados",))).collect()}
    assert set(got) == {"A", "8"} and got["A"].observed_at == datetime(2026, 1, 5, 10) and (got["8"].hours, got["A"].hours) == (6, 1)


def test_units_from_geojson(spark, tmp_path):
    ring = [[-45.5, -23.5, 9.0], [-45.4, -23.5, 9.0], [-45.4, -23.4, 9.0], [-45.5, -23.5, 9.0]]
    props = {"ua_id": "UA-1", "regiao_id": 3, "km_inicial": "10.5", "RAGEO": 2.0, "icc_geo_thresholds": "1;3;6;15", "trecho_critico_geo": "1", "centroide_lat": -23.45, "centroide_lon": -45.45}
    doc = {"features": [feature(props, "Polygon", [ring, ring[:3]]), feature(props | {"ua_id": "UA-2"}, "MultiPolygon", [[ring[:3]], [ring]]),
                        feature({"ua_id": "UA-3"}, "LineString", [[-45.0, -23.0], [-44.0, -22.0]]), feature(props | {"ua_id": "UA-4"}, "MultiLineString", [[[-45.0, -23.0], [-44.0, -22.0]], [[-43.0, -21.0]]]),
                        feature({"ua_id": "UA-5"}, "Point", [-45.0, -23.0]), feature({"ua_id": "UA-6"}, "LineString", [[-45.0, -23.0]])]}
    got = {r.ua_id: r for r in geojson.units(spark, dump(tmp_path / "u.geojson", doc), "geo").collect()}
    assert set(got) == {"UA-1", "UA-2", "UA-3", "UA-4"}
    u = got["UA-1"]
    assert (u.regiao_id, u.km_inicial, u.RAGEO, u.icc_geo_thresholds, u.trecho_critico_geo, u.geometry_type, len(u.geometry)) == (3, 10.5, 2, [1, 3, 6, 15], True, "polygon", 4)
    assert (u.geometry[0].lat, u.geometry[0].lon, u.lat) == (-23.5, -45.5, -23.45)
    assert len(got["UA-2"].geometry) == 4 and got["UA-3"].lat == -22.5 and len(got["UA-4"].geometry) == 3 and got["UA-4"].geometry_type == "polyline"


def test_regions_old_and_new_names_and_fallback(spark, tmp_path):
    ring = [[-45.5, -23.5], [-45.4, -23.5], [-45.4, -23.4], [-45.5, -23.5]]
    doc = {"features": [feature({"regiao_id": 1, "regiao_nome": "A", "k_geo": 900, "cpc_breaks": "[1,2,3,4]"}, "MultiPolygon", [[ring], [ring[:3]]]),
                        feature({"id": 2, "nome": "B", "rodovia": "SP-055"}, "Polygon", [ring])]}
    path = dump(tmp_path / "r.geojson", doc)
    axes = {"features": [feature({"regiao_id": 1}, "LineString", [[-45.0, -23.0], [-44.0, -22.0]]), feature({"regiao_id": 1}, "MultiLineString", [[[-45.0, -23.0]], [[-44.0, -22.0], [-43.0, -21.0]]])]}
    got = {r.regiao_id: r for r in geojson.regions(spark, path, geojson.axes(spark, dump(tmp_path / "a.geojson", axes))).collect()}
    assert (got[1].regiao_nome, got[1].k_geo, got[1].cpc_breaks, len(got[1].polygon), len(got[1].eixo)) == ("A", 900.0, [1, 2, 3, 4], 4, 3)
    assert (got[2].regiao_nome, got[2].k_geo, got[2].hid24h_breaks, got[2].eixo) == ("B", 400.0, [70, 80, 120, 143], None)
    assert geojson.regions_or_default(spark, str(tmp_path / "none"), path).count() == 2
    assert geojson.regions_or_default(spark, str(tmp_path / "none")).count() == 4


def test_fire_product_file_or_stand_in(spark, tmp_path):
    doc = {"features": [feature({"trecho_id": "t1", "horizonte": "D+1", "rf_classe": "alto", "rf_valor": 0.8}, "LineString", [[0, 0], [1, 1]]), feature({"rf_classe": "alto"}, "LineString", [[0, 0], [1, 1]])]}
    got = fire.class_map(geojson.fire_product(spark, dump(tmp_path / "f.geojson", doc))).collect()
    assert [(r.trecho_id, r.rf_classe) for r in got] == [("t1", "alto")]
    seg = spark.createDataFrame([("t9",)], "trecho_id string")
    assert geojson.fire_product(spark, str(tmp_path / "no"), seg).first().rf_classe == "SEM_DADO"


def test_telemetry_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"started_at": "2026-01-01T00:00:00", "outcome": "ok", "gauge": {"mean_factor": 0.5}}\n{"broken\n{"outcome": "ok"}\n{"started_at": "2026-01-02T00:00:00"}\n')
    rows = tables.telemetry(spark, str(tmp_path / "t.jsonl"))
    assert rows.count() == 2
    assert [r.started_at for r in tables.telemetry(spark, str(tmp_path / "t.jsonl"), keep=1).collect()] == ["2026-01-02T00:00:00"]


def test_csv_numbers_and_distributions(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,len,dist\n1,2.5,"{""1"": 3, ""2"": 0}"\n2,abc,"{}"\n')
    rows = tables.csv_table(spark, str(tmp_path / "s.csv"), ("len",), quote='"', escape='"').withColumn("d", text.parse_distribution(F.col("dist"))).orderBy("id").collect()
    assert [(r.len, r.d) for r in rows] == [(2.5, {1: 3}), (None, {})]


def test_listed_files_and_newest(spark, tmp_path):
    for n in ("observed_20260105.nc", "observed_20260110.nc", "other_20270101.nc"):
        (tmp_path / n).write_bytes(b"x" * 3)
    files = tables.listed_files(spark, str(tmp_path), with_digest=True)
    r = tables.newest_file(files, r"^observed_\d{8}\.nc$").first()
    assert (r.name, r.reference_date) == ("observed_20260110.nc", date(2026, 1, 10))
    assert {len(x.sha256) for x in files.collect()} == {64}


def test_grid_scan_prunes_partitions(spark, tmp_path):
    rows = [(0, 0, 1.0, datetime(2026, 1, d, 5)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, tables.GRID_SCHEMA).withColumn("day", F.to_date("hr"))
    df.write.partitionBy("day").parquet(str(tmp_path / "grid"))
    out = tables.rain_grid(spark, str(tmp_path / "grid"), F.lit("2026-01-08 12:00:00").cast("timestamp"))
    assert sorted(r.hr.day for r in out.collect()) == [5, 6, 7, 8]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(hr), GreaterThanOrEqual(hr" in plan


def test_sample_store_round_trip(spark, tmp_path):
    rows = [("m", datetime(2026, 1, 1, h), p, 1.00004 + p) for h in (1, 2) for p in range(3)]
    df = spark.createDataFrame(rows, "mesh string, hour timestamp, position int, mm double")
    store = str(tmp_path / "s")
    outputs.write_samples(df, store)
    outputs.write_samples(df.where("hour(hour) = 2").withColumn("mm", F.lit(9.0)), store)
    got = {(r.hour.hour, r.position): r.mm for r in tables.decoded_samples(spark, store, "m").collect()}
    assert got == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): 3.0, (2, 0): 9.0, (2, 1): 9.0, (2, 2): 9.0}
    with pytest.raises(ValueError):
        outputs.write_samples(df.limit(0), store)


def points(spark):
    return spark.createDataFrame([(1, "geo", 3, 10.0, 20.0, "OK", -23.5, -45.5), (1, "hidro", None, 1.0, 2.0, "NO_DATA", -23.5, -45.5), (2, "geo", 1, 5.0, 50.0, "OK", -23.6, -45.6)],
                                 "ua_id int, hazard string, rd int, ac24h_mm double, ac96h_mm double, source string, lat double, lon double")


def test_feed_files(spark, tmp_path):
    outputs.write_feed(points(spark), str(tmp_path / "feed"), "encosta", 2)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "feed/features")).collect()]
    assert len(lines) == 1 and lines[0]["properties"]["monitoramento"] == "ativo" and lines[0]["geometry"]["coordinates"] == [-45.5, -23.5]
    assert spark.read.json(str(tmp_path / "feed/header")).first().total == 1
    with pytest.raises(ValueError):
        outputs.at_least(points(spark), 5)
    with pytest.raises(ValueError):
        outputs.select_channel(points(spark), "wind")
    assert outputs.select_channel(points(spark), None).count() == 3


def test_fire_outputs(spark, tmp_path):
    rows = [("t1", "observado", "alto", 0.8, date(2026, 1, 1)), ("t1", "D+1", "baixo", 0.2, date(2026, 1, 1))]
    df = spark.createDataFrame(rows, "trecho_id string, horizonte string, rf_classe string, rf_valor double, data_referencia date")
    outputs.write_fire_product(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/all")).count() == 2 and spark.read.parquet(str(tmp_path / "p/observed")).first().horizonte == "observado"
    outputs.write_fire_exports(df, str(tmp_path / "x"))
    assert {r.slug for r in spark.read.json(str(tmp_path / "x/horizons")).select("slug").collect()} == {"observado", "d1"}
    first = outputs.observed_or_first(df.where("horizonte <> 'observado'")).collect()
    assert [r.horizonte for r in first] == ["D+1"]


def test_report_and_small_writers(spark, tmp_path):
    outputs.write_report(points(spark).where("rd is not null"), str(tmp_path / "r"), 1)
    assert [(r.hazard, r.ua_id) for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == [("geo", "1")]
    outputs.write_statistics(points(spark).agg(F.count("*").alias("n")), str(tmp_path / "st"))
    assert spark.read.text(str(tmp_path / "st")).first().value == '{"n":3}'
    outputs.append_cycle(risk.cycle_record(points(spark).withColumn("intensity_mmh", F.lit(1.0))), str(tmp_path / "c"))
    outputs.append_cycle(risk.cycle_record(points(spark).withColumn("intensity_mmh", F.lit(1.0))), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    assert outputs.compact_tail(points(spark), 1, "ac96h_mm", "ua_id").first().ua_id == 2
    r = outputs.run_record(points(spark), "risk", F.to_date(F.lit("2026-01-01")), "ok").first()
    assert (r.step, r.rows) == ("risk", 3)
    outputs.write_table(points(spark), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_alert_text(spark):
    a = points(spark).where("rd >= 1").withColumns({"nivel": F.lit("x"), "ra": F.lit(1), "region_name": F.lit("R")})
    m = outputs.alert_message(a, first=1).first()
    assert m.subject == "2 unit(s) at risk (RD>=3) - max RD3" and m.body.endswith("... (+1 units)") and m.body.startswith("- [1] RD3")


def test_predicate_edges(spark):
    df = spark.createDataFrame([(1, "Ab", float("nan"), True), (2, None, None, False), (3, "", 5.0, None)], "i int, t string, n double, b boolean").coalesce(1)
    c = predicates.condition
    run = lambda col: [r.v for r in df.orderBy("i").select(col.alias("v")).collect()]
    assert run(c(F.col("t"), "contains", "A")) == [True, False, False]
    assert run(c(F.col("t"), "eq", "")) == [False, True, True]
    assert run(c(F.col("n"), "ne", "4", "number")) == [False, True, True]
    assert run(c(F.col("n"), "gt", "x", "number")) == [False, False, False]
    assert run(c(F.col("n"), "empty", None)) == [True, True, False]
    assert run(c(F.col("b"), "ne", "true", "bool")) == [False, True, True]
    assert run(c(None, "eq", "1", "number")) == [False] * 3 and run(c(None, "empty", "")) == [True] * 3
    assert run(predicates.rule_column({"layerId": "roads", "join": "and", "conditions": []}, df.columns)) == [True] * 3
    assert predicates.search(df, "roads", []).count() == 3
    with pytest.raises(ValueError):
        c(F.col("t"), "like", "x")


def test_text_functions(spark):
    df = spark.createDataFrame([("SÃ£o", "DR.05 x", "sp 055 ", "COI: do it: now"), ("São €", " DR1", "SP-1", "no agency"), ("Ã with €", "ADR", None, None)], "m string, d string, r string, a string").coalesce(1)
    agency, what = text.split_action(F.col("a"))
    got = df.select(text.repair_mojibake(F.col("m")).alias("m"), text.office_code(F.col("d")).alias("d"), text.normalize_road(F.col("r")).alias("r"), agency.alias("g"), what.alias("w")).collect()
    assert [r.m for r in got] == ["São", "São €", "Ã with €"]
    assert [r.d for r in got] == ["CGR.05 x", " DR1", "ADR"]
    assert [r.r for r in got] == ["SP-055", "SP-1", None]
    assert [(r.g, r.w) for r in got[:2]] == [("COI", "do it: now"), ("", "no agency")]
