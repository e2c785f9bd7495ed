"""Fire-risk aggregation per road segment and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import RF_NO_DATA, RF_ORDER
from ..functions import fire
from .scale import OrderedBlocks, with_row

SCALE = 1e6


def segment_statistics(samples: DataFrame, keys: list[str], value: str = "rf") -> DataFrame:
    """Max, index p90 and mean of the valid samples per key, with the class of the max.

    Samples collapse to counts per (key, value) before anything is ordered, and ranks
    run block-wise, so one segment may own any share of the samples.
    """
    valid = samples.select(*keys, fire.valid_rf(F.col(value)).alias("_v"))
    counts = valid.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = OrderedBlocks.of(counts, keys, ["_v"]).cumulative({
        "_upto": ("sum", F.col("_n"), True), "_all": ("total", F.col("_n"), True)})
    p90_rank = F.bround((F.col("_all") - 1) * F.lit(0.9)) + 1
    units = F.round(F.col("_v") * F.lit(SCALE)).cast("long")
    stats = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("amostras"), F.max("_v").alias("rf_valor"),
        F.min(F.when(F.col("_upto") >= p90_rank, F.col("_v"))).alias("rf_p90"),
        (F.sum(units * F.col("_n")) / F.sum("_n") / F.lit(SCALE)).alias("rf_media"))
    return stats.withColumn("rf_classe", fire.rf_class(F.col("rf_valor")))


def segment_product(segments: DataFrame, statistics: DataFrame, horizons: Column, key: str = "trecho_id") -> DataFrame:
    """One row per segment and horizon; no samples gives nulls and the class without data."""
    spine = segments.withColumn("horizonte", F.explode(horizons))
    out = spine.join(statistics, [key, "horizonte"], "left")
    return out.withColumn("rf_classe", F.coalesce("rf_classe", F.lit(RF_NO_DATA)))


def without_product(segments: DataFrame, horizon: str = "observado") -> DataFrame:
    """Stand-in product when none exists yet."""
    none = F.lit(None).cast("double")
    return segments.withColumns({
        "horizonte": F.lit(horizon), "rf_valor": none, "rf_p90": none, "rf_media": none,
        "rf_classe": F.lit(RF_NO_DATA), "data_status": F.lit("no_data")})


def class_map(product: DataFrame) -> DataFrame:
    """(segment, horizon) to class; null class becomes the class without data, null id drops out."""
    return product.where(F.col("trecho_id").isNotNull()).select(
        F.col("trecho_id").cast("string").alias("trecho_id"), "horizonte",
        F.coalesce("rf_classe", F.lit(RF_NO_DATA)).alias("rf_classe"))


def known_class(name: Column) -> Column:
    return F.when(name.isin(*RF_ORDER), name).otherwise(F.lit(RF_NO_DATA))


def class_counts(product: DataFrame, by: list[str]) -> DataFrame:
    """Segments per class, unknown classes counted without data; total and alto+critico."""
    counted = product.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(known_class(F.coalesce("rf_classe", F.lit(RF_NO_DATA))) == c).alias(c.lower()) for c in RF_ORDER])
    return counted.withColumn("alto_critico", F.col("alto") + F.col("critico"))


def class_share(product: DataFrame, by: list[str]) -> DataFrame:
    """Percent of all and number evaluated, per class; ``widest`` marks the largest class."""
    c = product.groupBy(*by, known_class(F.coalesce("rf_classe", F.lit(RF_NO_DATA))).alias("rf_classe")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return c.select(*by, "rf_classe", "n", (F.col("n") * F.lit(100.0) / F.sum("n").over(w)).alias("percent"),
                    (F.sum(F.when(F.col("rf_classe") != RF_NO_DATA, F.col("n")).otherwise(F.lit(0))).over(w)).alias("evaluated"),
                    (F.row_number().over(w.orderBy(F.col("n").desc(), "rf_classe")) == 1).alias("widest"))


def transitions(classes: DataFrame, base: str = "observado") -> DataFrame:
    """Segments that worsen, improve or stay per horizon against the observed class; unranked ones are skipped."""
    seen = classes.where(F.col("horizonte") == base).select("trecho_id", fire.rf_rank(F.col("rf_classe")).alias("_r0"))
    later = classes.where(F.col("horizonte") != base).withColumn("_r1", fire.rf_rank(F.col("rf_classe")))
    both = later.join(seen, "trecho_id").where(F.col("_r0").isNotNull() & F.col("_r1").isNotNull())
    return both.groupBy("horizonte").agg(
        F.count_if(F.col("_r1") > F.col("_r0")).alias("worsen"), F.count_if(F.col("_r1") < F.col("_r0")).alias("improve"),
        F.count_if(F.col("_r1") == F.col("_r0")).alias("same"))


def office_matrix(product: DataFrame, office: str = "regional") -> DataFrame:
    """Office by class with totals, most alto+critico first."""
    out = class_counts(product.withColumn(office, F.coalesce(office, F.lit("—"))), [office])
    return out.orderBy(F.col("alto_critico").desc(), office)


def top_segments(product: DataFrame, n: int = 15) -> DataFrame:
    """Worst segments by class rank, then value; only finite values."""
    v = F.col("rf_valor")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (product.where(finite).withColumn("rank", F.coalesce(fire.rf_rank(F.col("rf_classe")), F.lit(0)))
            .orderBy(F.col("rank").desc(), v.desc(), "trecho_id", "horizonte").limit(n))


def product_metadata(product: DataFrame) -> DataFrame:
    """One row: total, class counts, status and the horizons present."""
    counts = class_counts(product, [])
    names = product.agg(F.array_sort(F.collect_set("horizonte")).alias("horizontes"))
    status = F.when(F.col(RF_NO_DATA.lower()) == F.col("total"), F.lit("no_data")).otherwise(F.lit("ok"))
    return with_row(counts, names).withColumn(
        "data_status", status)


def filter_class(product: DataFrame, class_eq: str | None = None, min_class: str | None = None) -> DataFrame:
    """Exact class, or classes of at least a rank."""
    if class_eq is not None:
        product = product.where(F.col("rf_classe") == class_eq)
    if min_class is not None:
        product = product.where(fire.rf_rank(F.col("rf_classe")) >= fire.rf_rank(F.lit(min_class)))
    return product


def lookup_segment(product: DataFrame, segment: str, horizon: str) -> DataFrame:
    """The row of one segment and horizon."""
    return product.where((F.col("trecho_id").cast("string") == segment) & (F.col("horizonte") == horizon)).limit(1)
