from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import RF_ORDER
from ..functions import fire as ff
from ..operators import fire, network
from ..plans import products
from ..sinks import outputs
from ..sources import tables
from . import query

CLASS = lambda v: (f"CASE WHEN {v} IS NULL THEN 'SEM_DADO' WHEN {v} < 0.15e0 THEN 'minimo' WHEN {v} <= 0.4e0 THEN 'baixo' "  # noqa: E731
                   f"WHEN {v} <= 0.7e0 THEN 'medio' WHEN {v} <= 0.95e0 THEN 'alto' ELSE 'critico' END")
RANK = "(CASE {c} WHEN 'minimo' THEN 1 WHEN 'baixo' THEN 2 WHEN 'medio' THEN 3 WHEN 'alto' THEN 4 WHEN 'critico' THEN 5 END)"
STATS = f"""SELECT trecho_id, horizonte, COUNT(*)::BIGINT AS amostras, MAX(rf) AS rf_valor, list_sort(list(rf))[(round_even((COUNT(*)-1)*0.9e0, 0)::BIGINT+1)] AS rf_p90,
    SUM(ROUND(rf*1e6)::BIGINT)::DOUBLE/COUNT(*)/1e6 AS rf_media, {CLASS('MAX(rf)')} AS rf_classe FROM fire_samples GROUP BY ALL"""
KNOWN = "(CASE WHEN rf_classe IN ('minimo','baixo','medio','alto','critico') THEN rf_classe ELSE 'SEM_DADO' END)"
COUNTS = "COUNT(*) AS total, " + ", ".join(f"COUNT(*) FILTER ({KNOWN}='{c}') AS {c.lower()}" for c in RF_ORDER) + f", COUNT(*) FILTER ({KNOWN} IN ('alto','critico')) AS alto_critico"


@query("AGG-19 SCL-08 SCL-09", fx.sql_with("fire_samples", {"st": STATS}, "SELECT * REPLACE (ROUND(rf_media, 6) AS rf_media) FROM st"))
def fire_segment_statistics(spark, sf):
    out = fire.segment_statistics(fx.fire_samples(spark, sf), ["trecho_id", "horizonte"])
    return out.withColumn("rf_media", F.round("rf_media", 6))


@query("CMP-07 SRC-11 SET-02", fx.sql_with("fire_samples segments", {"st": STATS}, """SELECT s.trecho_id, h.horizonte, s.regional, st.rf_valor, COALESCE(st.rf_classe, 'SEM_DADO') AS rf_classe FROM segments s
    CROSS JOIN (VALUES ('observado'),('D+1'),('D+2'),('D+3')) h(horizonte) LEFT JOIN st USING (trecho_id, horizonte)"""))
def fire_product(spark, sf):
    out = products.fire_product(fx.segments(spark, sf), fx.fire_samples(spark, sf), ["observado", "D+1", "D+2", "D+3"])
    return out.select("trecho_id", "horizonte", "regional", "rf_valor", "rf_classe")


@query("SRC-11", fx.sql_with("segments", {}, "SELECT trecho_id, 'observado' AS horizonte, 'SEM_DADO' AS rf_classe, 'no_data' AS data_status FROM segments"))
def fire_without_product(spark, sf):
    return fire.without_product(fx.segments(spark, sf)).select("trecho_id", "horizonte", "rf_classe", "data_status")


@query("SRC-12 SCL-30", fx.sql_with("fire_classes", {}, "SELECT trecho_id::VARCHAR AS trecho_id, lower(replace(horizonte, '+', '')) AS slug, CASE WHEN rf_classe='outro' THEN 'SEM_DADO' ELSE rf_classe END AS rf_classe FROM fire_classes"))
def fire_class_map(spark, sf):
    src = fx.fire_classes(spark, sf).withColumn("rf_classe", F.nullif("rf_classe", F.lit("outro")))
    return fire.class_map(src).select("trecho_id", ff.horizon_slug(F.col("horizonte")).alias("slug"), "rf_classe")


@query("AGG-17", fx.sql_with("fire_classes", {}, f"SELECT horizonte, {COUNTS} FROM fire_classes GROUP BY horizonte"))
def fire_class_counts(spark, sf):
    return fire.class_counts(fx.fire_classes(spark, sf), ["horizonte"])


@query("AGG-18 JOIN-21 SCL-43", fx.sql_with("fire_classes", {"r": f"SELECT trecho_id, horizonte, {RANK.format(c='rf_classe')} AS k FROM fire_classes"}, """SELECT b.horizonte, COUNT(*) FILTER (b.k > a.k) AS worsen,
    COUNT(*) FILTER (b.k < a.k) AS improve, COUNT(*) FILTER (b.k = a.k) AS same FROM r a JOIN r b USING (trecho_id) WHERE a.horizonte='observado' AND b.horizonte<>'observado' AND a.k IS NOT NULL AND b.k IS NOT NULL GROUP BY b.horizonte"""))
def fire_transitions(spark, sf):
    return fire.transitions(fire.class_map(fx.fire_classes(spark, sf)))


@query("AGG-27 AGG-42", fx.sql_with("fire_classes", {}, f"SELECT regional, {COUNTS} FROM fire_classes GROUP BY regional"))
def fire_office_matrix(spark, sf):
    return fire.office_matrix(fx.fire_classes(spark, sf))


@query("AGG-41", fx.sql_with("fire_classes", {"c": f"SELECT horizonte, {KNOWN} AS rf_classe, COUNT(*) AS n FROM fire_classes GROUP BY ALL"}, """SELECT horizonte, rf_classe, n, n*100e0/(SUM(n) OVER w) AS percent,
    (SUM(CASE WHEN rf_classe='SEM_DADO' THEN 0 ELSE n END) OVER w)::BIGINT AS evaluated, row_number() OVER (PARTITION BY horizonte ORDER BY n DESC, rf_classe) = 1 AS widest FROM c WINDOW w AS (PARTITION BY horizonte)"""))
def fire_class_share(spark, sf):
    return fire.class_share(fx.fire_classes(spark, sf), ["horizonte"])


@query("AGG-38", fx.sql_with("fire_classes", {}, f"SELECT {COUNTS}, 'D+1,D+2,observado' AS horizontes, 'ok' AS data_status FROM fire_classes"))
def fire_metadata(spark, sf):
    return fire.product_metadata(fx.fire_classes(spark, sf)).withColumn("horizontes", F.array_join("horizontes", ","))


@query("TOP-02", fx.sql_with("fire_classes", {}, f"""SELECT trecho_id, horizonte, COALESCE({RANK.format(c='rf_classe')}, 0) AS rank, rf_valor FROM fire_classes ORDER BY rank DESC, rf_valor DESC, trecho_id, horizonte LIMIT 15"""))
def fire_top_segments(spark, sf):
    return fire.top_segments(fx.fire_classes(spark, sf)).select("trecho_id", "horizonte", "rank", "rf_valor")


@query("FLT-06", fx.sql_with("fire_classes", {}, "SELECT trecho_id, horizonte FROM fire_classes WHERE rf_classe='alto'"))
def fire_class_equals(spark, sf):
    return fire.filter_class(fx.fire_classes(spark, sf), class_eq="alto").select("trecho_id", "horizonte")


@query("FLT-06 A-3", fx.sql_with("fire_classes", {}, "SELECT trecho_id, horizonte FROM fire_classes WHERE rf_classe IN ('medio','alto','critico')"))
def fire_class_at_least(spark, sf):
    return fire.filter_class(fx.fire_classes(spark, sf), min_class="medio").select("trecho_id", "horizonte")


@query("FLT-07", fx.sql_with("fire_classes", {}, "SELECT trecho_id, horizonte, rf_classe FROM fire_classes WHERE trecho_id=77 AND horizonte='D+1'"))
def fire_segment_lookup(spark, sf):
    return fire.lookup_segment(fx.fire_classes(spark, sf), "77", "D+1").select("trecho_id", "horizonte", "rf_classe")


@query("SNK-03", fx.sql_with("fire_classes", {}, "SELECT trecho_id, rf_classe FROM fire_classes WHERE horizonte='observado'"))
def fire_observed_layer(spark, sf):
    return outputs.observed_or_first(fx.fire_classes(spark, sf)).select("trecho_id", "rf_classe")


@query("SNK-02", fx.sql_with("fire_classes", {}, f"SELECT lower(replace(horizonte, '+', '')) AS slug, {COUNTS} FROM fire_classes GROUP BY ALL"))
def fire_export_statistics(spark, sf):
    return fire.class_counts(fx.fire_classes(spark, sf).withColumn("slug", ff.horizon_slug(F.col("horizonte"), True)), ["slug"])


@query("SRC-17", fx.sql_with("fire_samples", {}, "SELECT horizonte, COUNT(*) AS n FROM fire_samples WHERE horizonte IN ('observado','D+1') GROUP BY horizonte"))
def published_products(spark, sf):
    kept = tables.product_index(fx.fire_samples(spark, sf), ("observado", "D+1"))
    return kept.groupBy("horizonte").agg(F.count(F.lit(1)).alias("n"))


@query("SET-02 SET-05", fx.sql_with("fire_classes", {}, "SELECT DISTINCT horizonte FROM fire_classes"))
def stacked_horizons(spark, sf):
    src = fx.fire_classes(spark, sf)
    parts = [src.where(F.col("horizonte") == h) for h in ("observado", "D+1", "D+2")]
    return network.stack(parts).select("horizonte").distinct().orderBy("horizonte")
