"""Road-network attributes: roll-ups, pairs of channels, statistics, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rain
from .scale import numbered, top_per_group


def exact_total(column: str | Column, scale: float = 1e6) -> Column:
    """Sum that does not depend on the order of the rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(F.round(c * F.lit(scale)).cast("long")) / F.lit(scale)


def ordered_list(value: Column, order: list[str]) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda s: s["_v"])


def segment_rollup(units: DataFrame, key: str = "trecho_id") -> DataFrame:
    """Counts and maxima of the units of a segment; these merge map-side for any size."""
    return units.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_uas"), F.max("ra_geo").alias("ra_geo_max"), F.max("ra_hid").alias("ra_hid_max"),
        F.bool_or("trecho_critico_geo").alias("trecho_critico_geo"), F.bool_or("trecho_critico_hid").alias("trecho_critico_hid"))


def segment_unit_list(units: DataFrame, key: str = "trecho_id") -> DataFrame:
    """Units of every segment in order: one row per unit with its 1-based position, whatever their number, and its details as JSON."""
    detail = F.struct("ua_id", "ra_geo", "ra_hid", F.round("km0", 3).alias("km_inicial"), F.round("km1", 3).alias("km_final"))
    rows = numbered(units.where(F.col(key).isNotNull()), [key], ["km0", "ua_id"], "posicao")
    return rows.select(key, "posicao", "ua_id", F.to_json(detail).alias("uas_risco"))


def attach_rollup(segments: DataFrame, rollup: DataFrame, key: str = "trecho_id") -> DataFrame:
    """All segments, zero units and false flags where none was assigned."""
    return segments.join(rollup, key, "left").fillna(0, ["n_uas"]).fillna(False, ["trecho_critico_geo", "trecho_critico_hid"])


def distinct_joined(column: str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def mode_per_group(df: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Most frequent class per key, the highest on a tie."""
    n = df.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", cls)).alias("_b")).select(*keys, F.col(f"_b.{cls}").alias("mode"), F.col("_b.n").alias("n"))


def histogram_score(df: DataFrame, keys: list[str], cls: str, full: int = 20) -> DataFrame:
    """Mean class, confidence min(1, n/20) and mode (highest on a tie) per key."""
    n = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(
        (F.sum(F.col(cls) * F.col("_n")) / F.sum("_n")).alias("score"),
        F.least(F.lit(1.0), F.sum("_n") / F.lit(float(full))).alias("confidence"), F.max(F.struct("_n", cls))[cls].alias("mode"))


def road_statistics(roads: DataFrame, monitored: Column, length: str = "extensao") -> DataFrame:
    """One row: segments, total and monitored length, roads, offices, bounding km."""
    return roads.agg(
        F.count(F.lit(1)).alias("segments"), exact_total(length).alias("total_length"), F.count_distinct("rodovia").alias("roads"),
        F.count_if(monitored).alias("monitored"), exact_total(F.when(monitored, F.col(length))).alias("monitored_length"),
        distinct_joined("tipo_pista").alias("surface_types"), F.min("km_ini").alias("min_km"), F.max("km_fim").alias("max_km"))


def pivot_counts(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Counts per row key and fixed column value, zero filled."""
    return df.groupBy(*rows).pivot(column, values).count().fillna(0)


def dissolve(df: DataFrame, key: str, order: str, firsts: list[str]) -> DataFrame:
    """First known attribute per key (by ``order``) and the number of rows."""
    pick = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return df.groupBy(key).agg(*pick, F.count(F.lit(1)).alias("n"))


def length_audit(rows: DataFrame, official: DataFrame, key: str, length: str, official_length: str) -> DataFrame:
    """Summed length against the official one."""
    got = rows.groupBy(key).agg(exact_total(length).alias("measured"))
    return official.select(key, official_length).join(got, key, "left").withColumn(
        "difference", F.round(F.coalesce("measured", F.lit(0.0)) - F.col(official_length), 6))


def quota_audit(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and observed km per class, full outer, with errors."""
    out = expected.join(observed, keys, "full_outer").fillna(0.0, ["km_expected", "km_observed"])
    err = F.col("km_observed") - F.col("km_expected")
    return out.withColumns({
        "error_km": F.round(err, 6), "abs_error_km": F.round(F.abs(err), 6),
        "error_pct": F.when(F.col("km_expected") > 0, F.round(err * F.lit(100.0) / F.col("km_expected"), 4)),
        "matched_km": F.round(F.least("km_observed", "km_expected"), 6)})


def quota_agreement(audit: DataFrame) -> DataFrame:
    """One row: matched share of the expected km."""
    return audit.agg((exact_total("matched_km") * F.lit(100.0) / exact_total("km_expected")).alias("agreement_pct"))


def class_share(rows: DataFrame, group: str, cls: str, length: str, counts: str) -> DataFrame:
    """Class share by length and by official count per group."""
    per = rows.groupBy(group, cls).agg(F.sum(F.round(F.col(length) * 1e6).cast("long")).alias("_l"), F.sum(counts).alias("_c"))
    tot = per.groupBy(group).agg(F.sum("_l").alias("_tl"), F.sum("_c").alias("_tc"))
    return per.join(tot, group).select(
        group, cls, F.try_divide(F.col("_l") * F.lit(100.0), F.col("_tl")).alias("length_pct"),
        F.try_divide(F.col("_c") * F.lit(100.0), F.col("_tc")).alias("count_pct"))


def worse_channel(points: DataFrame) -> DataFrame:
    """One row per unit: the worse channel by level, then 96 h rain, then the slope channel."""
    rest = [c for c in points.columns if c != "ua_id"]
    best = F.min(F.struct((-F.col("rd")).alias("_r"), (-F.coalesce("ac96h_mm", F.lit(0.0))).alias("_a"), F.col("hazard").alias("_h"),
                          F.struct(*rest).alias("_row")))
    return points.groupBy("ua_id").agg(best.alias("_b")).select("ua_id", "_b._row.*")


def focal_units(points: DataFrame, n: int = 4) -> DataFrame:
    """Up to four units above level zero, worst first."""
    return worse_channel(points).where("rd > 0").orderBy(
        F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), "ua_id").limit(n)


def panel_unit(points: DataFrame, region: int) -> DataFrame:
    """Unit to show for a region: the best focal unit in it, else its worst unit."""
    focal = focal_units(points).where(F.col("regiao_id") == region).withColumn("_o", F.lit(0))
    any_unit = worse_channel(points.where(F.col("regiao_id") == region)).orderBy(
        F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), "ua_id").limit(1).withColumn("_o", F.lit(1))
    return focal.unionByName(any_unit).orderBy(
        "_o", F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), "ua_id").limit(1).drop("_o")


def channel_pairs(points: DataFrame, columns: list[str]) -> DataFrame:
    """Both channels of a unit side by side."""
    side = lambda h, p: points.where(F.col("hazard") == h).select("ua_id", *[F.col(c).alias(f"{c}_{p}") for c in columns])
    return side("geo", "geo").join(side("hidro", "hid"), "ua_id", "full_outer")


def alert_context(points: DataFrame, worst: DataFrame) -> DataFrame:
    """The worst unit with the class of both channels and the level of the alerting one."""
    pairs = channel_pairs(points, ["ra", "rd"])
    w = worst.select("ua_id", F.col("hazard").alias("max_hazard"))
    rd = F.when(F.col("max_hazard") == "geo", F.col("rd_geo")).otherwise(F.col("rd_hid"))
    return w.join(pairs, "ua_id").select("ua_id", "max_hazard", "ra_geo", "ra_hid", rd.alias("rd"))


def roads_without_units(roads: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    return roads.select(*keys).distinct().join(units.select(*keys).distinct(), keys, "left_anti")


def units_along_road(units: DataFrame, road: str, at: Column) -> DataFrame:
    """Units per road ordered by position: one row per unit with its 1-based place."""
    return numbered(units.withColumn("_at", at), [road], ["_at", "ua_id"], "posicao").select(road, "posicao", "ua_id")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_report(points: DataFrame, n: int = 10) -> DataFrame:
    """Worst n units of either channel under one header."""
    return top_per_group(points, ["hazard"], [F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), F.col("ua_id")], n, rank="posicao")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids found on one side only, with the side."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def expect_count(df: DataFrame, n: int) -> DataFrame:
    """One row with the count; a wrong count fails the job when it runs."""
    c = df.agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("ok", F.when(F.col("n") == n, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} rows, found "), F.col("n").cast("string"))).cast("boolean")))


def mesh_hash(points: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """First 12 hex digits of SHA-1 over the count and all coordinates in order.

    The digest is a single text by definition, so this is for meshes of units of one
    run (hundreds); use one key per mesh.
    """
    keys = keys or []
    at = F.format_string("|%.6f,%.6f", F.col("lat"), F.when(F.col("lon") < 0, F.col("lon") + 360.0).otherwise(F.col("lon")))
    text = F.concat(F.count(F.lit(1)).cast("string"), F.array_join(ordered_list(at, [order]), ""))
    return points.groupBy(*keys).agg(F.substring(F.sha1(text), 1, 12).alias("mesh"), F.count(F.lit(1)).alias("n_points"))


def rain_mean(column: str) -> Column:
    return F.sum(rain.ticks(F.col(column))) / F.count(column) / F.lit(float(rain.TICKS_PER_MM))
