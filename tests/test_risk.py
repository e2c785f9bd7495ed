"""Published numbers of the risk model."""

from pyspark.sql import functions as F

from rainrisk.functions import rain, risk as rk
from rainrisk.functions.register import register
from rainrisk.operators import risk


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_cpc_value_and_edges(spark):
    r = one(spark, v=rk.cpc(F.lit(15.0), F.lit(100.0), F.lit(1000.0)), dry=rk.cpc(F.lit(15.0), F.lit(0.5), F.lit(1000.0)),
            negative=rk.cpc(F.lit(-1.0), F.lit(100.0), F.lit(1000.0)), flat=rk.cpc(F.lit(1.0), F.lit(100.0), F.lit(0.0)))
    assert round(r.v, 4) == 0.9464
    assert (r.dry, r.negative, r.flat) == (0.0, 0.0, None)


def test_matrix_and_clamping(spark):
    from rainrisk.constants import RD_MATRIX

    rows = [(a, i) for a in range(-1, 6) for i in range(-1, 6)]
    got = spark.createDataFrame(rows, "ra int, icc int").withColumn("rd", rk.combine(F.col("ra"), F.col("icc"))).collect()
    for r in got:
        assert r.rd == RD_MATRIX[min(4, max(0, r.ra))][min(4, max(0, r.icc))]


def test_threshold_lower_bound_is_inclusive(spark):
    b = F.array(*[F.lit(x) for x in (1.0, 3.0, 6.0, 15.0)])
    got = [one(spark, c=rk.class_from_breaks(F.lit(v).cast("double"), b)).c for v in (None, 0.99, 1.0, 3.0, 6.0, 14.9, 15.0)]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def test_regional_scenarios(spark):
    rows = [(str(r), r, 150.0, 100.0, 50.0, 1, 1) for r in range(1, 5)]
    pts = spark.createDataFrame(rows, "ua_id string, regiao_id int, ac96h_mm double, ac24h_mm double, intensity_mmh double, ra_geo int, ra_hid int")
    got = {r.regiao_id: r for r in risk.evaluate(pts, risk.default_regions(spark)).collect()}
    assert [got[r].icc_geo for r in range(1, 5)] == [2, 2, 3, 2]
    assert [got[r].icc_hid for r in range(1, 5)] == [0, 2, 2, 0]
    assert [got[r].rd for r in range(1, 5)] == [2, 2, 3, 2]


def test_out_of_coverage_and_missing_class(spark):
    rows = [("a", None, 150.04, 100.0, 50.0, 1, None), ("b", 1, 150.0, 100.0, 50.0, None, None)]
    pts = spark.createDataFrame(rows, "ua_id string, regiao_id int, ac96h_mm double, ac24h_mm double, intensity_mmh double, ra_geo int, ra_hid int")
    got = {r.ua_id: r for r in risk.evaluate(pts, risk.default_regions(spark)).collect()}
    assert (got["a"].nivel, got["a"].rd, got["a"].cpc, got["a"].ac96h_mm) == ("Fora de cobertura", 0, None, 150.04)
    assert (got["b"].nivel, got["b"].rd, got["b"].icc_geo) == ("SEM DADO - RA nao mapeado", 0, 2)


def test_distribution_grades_to_worst_case(spark):
    cases = [({0: 7, 1: 95, 2: 12, 3: 28, 4: 33}, 2, {0: 7, 2: 95, 3: 12, 4: 61}), ({0: 4, 1: 32, 2: 29, 3: 29, 4: 41}, 3, {0: 4, 3: 32, 4: 99}),
             ({1: 0, 2: -3}, 2, {})]
    df = spark.createDataFrame([(d, i) for d, i, _ in cases], "dist map<int,int>, icc int").coalesce(1)
    got = risk.stretch_distribution(df).collect()
    assert [r.rd_dist for r in got] == [e for _, _, e in cases]
    assert [(r.rd, r.rd_unidades, r.ra) for r in got] == [(4, 61, 4), (4, 99, 4), (0, None, None)]


def test_evaluate_with_distributions(spark):
    pts = spark.createDataFrame([("a", 1, 150.0, 100.0, 50.0, 1, None, {0: 7, 1: 95, 2: 12, 3: 28, 4: 33})],
                                "ua_id string, regiao_id int, ac96h_mm double, ac24h_mm double, intensity_mmh double, ra_geo int, ra_hid int, d map<int,int>")
    r = risk.evaluate(pts, risk.default_regions(spark), geo_dist="d").first()
    assert (r.rd_geo, r.rd, r.rd_unidades, r.ra) == (4, 4, 61, 4) and r.rd_geo_dist == {0: 7, 2: 95, 3: 12, 4: 61}


def test_composition(spark):
    parts = rain.compose_windows(*[F.lit(v) for v in (100.0, 40.0, 120.0, 45.0)], F.lit(30.0), F.lit(12.0))
    assert tuple(one(spark, **parts)) == (130.0, 52.0, "WRF")
    parts = rain.compose_windows(*[F.lit(v) for v in (100.0, 40.0, 120.0, 45.0)], F.lit(30.0), F.lit(None).cast("double"))
    assert tuple(one(spark, **parts)) == (120.0, 45.0, "OBS_ONLY")


def test_sql_functions(spark):
    assert set(register(spark)) == {"haversine_km", "cpc_index", "class_from_breaks", "risk_level", "rf_class"}
    r = spark.sql("SELECT haversine_km(-23D, -46D, -23D, -46D) z, haversine_km(0D, 0D, 0D, 1D) d, risk_level(2, 3) l, rf_class(0.15D) c, rf_class(NULL) n").first()
    assert (r.z, r.l, r.c, r.n) == (0.0, 4, "baixo", "SEM_DADO") and abs(r.d - 111.1949) < 1e-3


def test_protocol_table(spark):
    p = risk.protocol(spark).orderBy("rd").collect()
    assert [r.nivel for r in p] == ["Monitoramento", "Observação", "Atenção", "Alerta", "Alerta Máximo"]
    assert [r.prontidao for r in p] == [False, True, True, True, True] and [r.vistoria for r in p] == [False, False, True, True, True]
    assert all(r.orgao and r.texto for r in risk.protocol_actions(risk.protocol(spark)).collect())
    assert [len(r.acoes) for r in p] == [3, 5, 7, 7, 8] and all(r.descricao and r.responsavel_principal for r in p)
