"""Analytics over risk rows and cycle telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AC24H_EDGES, AC96H_EDGES, INTENSITY_EDGES, OUT_OF_COVERAGE
from ..functions import rain, risk
from .rain import window_hours
from .scale import exact_quantiles, top_per_group, with_row
from .sequences import cycle_gaps

MEASURES = {"ac24h": ("ac24h_mm", AC24H_EDGES), "ac96h": ("ac96h_mm", AC96H_EDGES),
            "intensity": ("intensity_mmh", INTENSITY_EDGES)}


def _mean(column: str, keep: Column, digits: int) -> Column:
    total = F.sum(F.when(keep, rain.ticks(F.col(column))))
    return F.round(total / F.count_if(keep & F.col(column).isNotNull()) / F.lit(float(rain.TICKS_PER_MM)), digits)


def _next_break(breaks: Column, level: Column) -> Column:
    return F.get(breaks, level)


def regional_summary(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Units, levels and rain per region with the position against the thresholds.

    Rain is taken from the slope channel only; every region appears, also without units.
    """
    geo, hid = F.col("hazard") == "geo", F.col("hazard") == "hidro"
    has_rain = geo & F.col("ac24h_mm").isNotNull()
    known = points.where(F.col("regiao_id").isNotNull())
    stats = known.groupBy("regiao_id").agg(
        F.count_if(geo).alias("uas_geo"), F.count_if(hid).alias("uas_hidro"),
        *[F.count_if(geo & (F.col("rd") == i)).alias(f"geo_rd{i}") for i in range(5)],
        *[F.count_if(hid & (F.col("rd") == i)).alias(f"hidro_rd{i}") for i in range(5)],
        F.round(F.max(F.when(has_rain, F.col("ac24h_mm"))), 1).alias("ac24h_max"), _mean("ac24h_mm", has_rain, 1).alias("ac24h_mean"),
        F.round(F.max(F.when(has_rain, F.col("ac96h_mm"))), 1).alias("ac96h_max"), _mean("ac96h_mm", has_rain, 1).alias("ac96h_mean"),
        F.round(F.max(F.when(has_rain, F.col("intensity_mmh"))), 2).alias("intensity_max"),
        F.round(F.max(F.when(geo & (F.abs("cpc") < F.lit(float("inf"))), F.col("cpc"))), 2).alias("cpc_max"))
    p90 = exact_quantiles(known.where(has_rain), ["regiao_id"], "ac24h_mm", {"ac24h_p90": 0.9}).select(
        "regiao_id", F.round("ac24h_p90", 2).alias("ac24h_p90"))
    out = regions.select("regiao_id", "regiao_nome", "hid24h_breaks", "cpc_breaks").join(stats, "regiao_id", "left").join(
        p90, "regiao_id", "left")
    counts = ["uas_geo", "uas_hidro", *[f"{c}_rd{i}" for c in ("geo", "hidro") for i in range(5)]]
    out = out.fillna(0, counts)
    out = out.withColumns({
        "hid_level": F.when(F.col("ac24h_max").isNotNull(), risk.class_from_breaks(F.col("ac24h_max"), F.col("hid24h_breaks"))),
        "cpc_level": F.when(F.col("cpc_max").isNotNull(), risk.class_from_breaks(F.col("cpc_max"), F.col("cpc_breaks")))})
    nxt = _next_break(F.col("hid24h_breaks"), F.col("hid_level"))
    return out.withColumns({
        "hid_next_break": nxt, "cpc_next_break": _next_break(F.col("cpc_breaks"), F.col("cpc_level")),
        "hid_margin_mm": F.when(F.col("hid_level").isNotNull(), F.round(F.coalesce(nxt - F.col("ac24h_max"), F.lit(0.0)), 1))})


def unassigned_points(points: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: points without a known region."""
    return points.join(regions.select("regiao_id"), "regiao_id", "left_anti").agg(F.count(F.lit(1)).alias("points_unassigned"))


def hourly_by_region(hourly: DataFrame, unit_regions: DataFrame, cell: list[str], target: Column, frames: int = 96) -> DataFrame:
    """Mean and maximum rain per region and hour over all its units; absent hours are zero.

    Units collapse to counts per (region, cell) first, so the join is cells by hours.
    """
    weights = unit_regions.where(F.col("regiao_id").isNotNull()).groupBy("regiao_id", *cell).agg(F.count(F.lit(1)).alias("_n"))
    sizes = weights.groupBy("regiao_id").agg(F.sum("_n").alias("uas"))
    reported = window_hours(hourly, target, frames).groupBy(*cell, "hr").agg(F.sum(rain.ticks(F.col("mm"))).alias("_t"))
    sums = weights.join(reported, cell).groupBy("regiao_id", "hr").agg(
        F.sum(F.col("_t") * F.col("_n")).alias("_sum"), F.max("_t").alias("_max"))
    first = target - F.make_interval(hours=F.lit(frames - 1))
    spine = sizes.withColumn("hr", F.explode(F.sequence(first, target, F.expr("INTERVAL 1 HOUR"))))
    mean = F.coalesce("_sum", F.lit(0)) / F.col("uas") / F.lit(float(rain.TICKS_PER_MM))
    return spine.join(sums, ["regiao_id", "hr"], "left").select(
        "regiao_id", "hr", "uas", F.round(mean, 2).alias("mean_mm"),
        rain.mm_from_ticks(F.greatest(F.coalesce("_max", F.lit(0)), F.lit(0))).alias("max_mm"))


def region_hour_totals(by_hour: DataFrame) -> DataFrame:
    """Per region: sum of the rounded hourly means and the peak hour."""
    return by_hour.groupBy("regiao_id").agg(
        F.max("uas").alias("uas"), F.round(F.sum(F.round(F.col("mean_mm") * 100).cast("long")) / F.lit(100.0), 1).alias("sum96_mean"),
        F.max("max_mm").alias("peak_mmh"))


def bin_index(value: Column, edges: tuple[float, ...]) -> Column:
    """Index of the last edge reached; values below the first edge count in bin 0."""
    array = F.array(*[F.lit(float(e)) for e in edges])
    return F.greatest(F.lit(0), F.size(F.filter(array, lambda e: value >= e)) - 1)


def histogram(df: DataFrame, column: str, edges: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Counts for every bin (also empty ones); the last bin is open."""
    keys = keys or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(bin_index(F.col(column), edges) == i).alias(f"_{i}") for i in range(len(edges))])
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(e)).alias("lower"),
                              F.lit(float(edges[i + 1]) if i + 1 < len(edges) else None).cast("double").alias("upper"),
                              F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)])
    return counts.select(*keys, F.inline(bins))


def _long_measures(points: DataFrame) -> DataFrame:
    geo = points.where((F.col("hazard") == "geo") & F.col("ac24h_mm").isNotNull())
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.coalesce(F.col(c), F.lit(0.0)).alias("value"))
                      for k, (c, _) in MEASURES.items()])
    return geo.select(F.inline(pairs))


def distributions(points: DataFrame) -> DataFrame:
    """Median, p90, maximum and number of units per rain measure of the slope channel."""
    long = _long_measures(points)
    q = exact_quantiles(long, ["measure"], "value", {"p50": 0.5, "p90": 0.9, "top": 1.0})
    digits = F.when(F.col("measure") == "intensity", F.round("top", 2)).otherwise(F.round("top", 1))
    return q.select("measure", "n_values", F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"), digits.alias("max"))


def distribution_bins(points: DataFrame) -> DataFrame:
    """Histogram of all three rain measures."""
    geo = points.where((F.col("hazard") == "geo") & F.col("ac24h_mm").isNotNull())
    counts = geo.agg(*[F.count_if(bin_index(F.coalesce(F.col(c), F.lit(0.0)), e) == i).alias(f"{k}_{i}")
                       for k, (c, e) in MEASURES.items() for i in range(len(e))])
    rows = [F.struct(F.lit(k).alias("measure"), F.lit(i).alias("bin"), F.lit(v).alias("lower"), F.col(f"{k}_{i}").alias("n"))
            for k, (_, e) in MEASURES.items() for i, v in enumerate(e)]
    return counts.select(F.inline(F.array(*rows)))


def cycle_series(cycles: DataFrame) -> DataFrame:
    """Flat cycle rows: level vector, alert count (default levels 3+4), gauge fields."""
    level = lambda i: F.coalesce(F.get("by_level", F.lit(i)), F.lit(0))
    have = set(cycles.columns)
    optional = [c for c in ("data_status", "ac24h_max", "ac96h_max", "intensity_max", "files_ok", "missing_24h", "duration_s")
                if c in have]
    gauge = [F.col("gauge.mean_factor").alias("gauge_factor"), F.col("gauge.stations_recent").alias("gauge_stations")] if "gauge" in have else []
    given = F.col("alert_count") if "alert_count" in have else F.lit(None)
    return cycles.select(
        F.col("started_at").alias("at"), "outcome", F.array(*[level(i) for i in range(5)]).alias("by_level"),
        F.coalesce(given, level(3) + level(4)).cast("int").alias("alert_count"),
        F.coalesce("max_rd", F.lit(0)).alias("max_rd"), *optional, *gauge)


def series_span(cycles: DataFrame, ts: str = "started_at") -> DataFrame:
    return cycles.agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("from"), F.max(ts).alias("to"))


def recent_window(cycles: DataFrame, now: Column, hours: int, ts: str = "started_at") -> DataFrame:
    """Cycles of the last hours; rows without a readable time stay."""
    cutoff = now - F.make_interval(hours=F.lit(hours))
    return cycles.where(F.coalesce(F.col(ts), cutoff) >= cutoff)


def alert_deltas(cycles: DataFrame, hours: tuple[int, ...] = (1, 24), ts: str = "started_at", tie: str = "cycle_id",
                 last_values: tuple[str, ...] = ()) -> DataFrame:
    """One row: alerts of the last cycle and the change against the last cycle h hours earlier.

    Cycles are in time order, so the last row at or before the cutoff is the as-of row.
    ``last_values`` adds further columns of the last cycle.
    """
    at = F.struct(ts, tie)
    last = cycles.agg(F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"), F.max_by("alert_count", at).alias("alert_count"),
                      *[F.max_by(c, at).alias(c) for c in last_values])
    tagged = with_row(cycles.select(ts, tie, "alert_count"), last.select("_last"))
    cond = lambda h: F.col(ts) <= F.col("_last") - F.make_interval(hours=F.lit(h))
    refs = tagged.agg(*[F.max_by(F.when(cond(h), F.col("alert_count")), F.when(cond(h), at)).alias(f"_r{h}") for h in hours])
    both = with_row(last, refs)
    return both.select("alert_count", *[
        F.when(F.col("_n") >= 2, F.col("alert_count") - F.col(f"_r{h}")).alias(f"alert_delta_{h}h") for h in hours], *last_values)


def operations(cycles: DataFrame, ts: str = "started_at", tie: str = "cycle_id") -> DataFrame:
    """One row: outcome counts, success rate, duration quantiles, completeness, gap between cycles."""
    o = F.col("outcome")
    degraded = [F.count_if(F.col("data_status") == "degraded").alias("degraded")] if "data_status" in cycles.columns else []
    totals = cycles.agg(
        F.count(F.lit(1)).alias("cycles"), F.count_if(o == "ok").alias("ok"), F.count_if(o == "error").alias("error"),
        F.count_if(o == "skipped").alias("skipped"), *degraded, F.round(F.max("duration_s"), 2).alias("duration_max_s"),
        F.round(F.lit(100.0) * F.sum("files_ok") / F.count("files_ok") / F.lit(96.0), 1).alias("completeness_pct"))
    totals = totals.withColumn("success_rate_pct", F.round(F.try_divide(F.lit(100.0) * F.col("ok"), F.col("cycles")), 1))
    gaps = cycle_gaps(cycles.select(ts, tie), ts, tie).where("gap_min IS NOT NULL")
    long = cycles.select(F.lit("duration").alias("what"), F.col("duration_s").alias("v")).unionByName(
        gaps.select(F.lit("gap").alias("what"), F.col("gap_min").alias("v")))
    q = exact_quantiles(long, ["what"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0})
    pick = lambda w, c: F.max(F.when(F.col("what") == w, F.col(c)))
    wide = q.agg(F.round(pick("duration", "p50"), 2).alias("duration_p50_s"), F.round(pick("duration", "p95"), 2).alias("duration_p95_s"),
                 F.round(pick("gap", "p50"), 2).alias("interval_p50_min"), F.round(pick("gap", "top"), 1).alias("interval_max_min"))
    return with_row(totals, wide)


def last_trail(history: DataFrame, keys: list[str] | None = None, ts: str = "ts", tie: str = "cycle_id", n: int = 24) -> DataFrame:
    """Last n cycles per (unit, channel), cut map-side before the shuffle."""
    keys = keys or ["ua_id", "hazard"]
    return top_per_group(history, keys, [F.col(ts).desc(), F.col(tie).desc()], n, rank="back")


def trails(history: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    """Ordered trail of levels per (unit, channel), oldest first, at most 24 long."""
    keys = keys or ["ua_id", "hazard"]
    packed = last_trail(history, keys, **kw).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), F.col("rd").alias("rd")))), lambda s: s["rd"]).alias("trail"))
    return packed.withColumn("depth", F.size("trail"))


def escalation(history: DataFrame, keys: list[str] | None = None, lag: int = 6, **kw) -> DataFrame:
    """Per (unit, channel): level now, six cycles back, at the start of the trail, and the change."""
    t = trails(history, keys, **kw)
    at = lambda i: F.get("trail", i)
    n = F.col("depth")
    now = at(n - 1)
    ref = F.when(n >= 2, at(F.lit(0))).otherwise(now)
    return t.withColumns({
        "rd_now": now, "rd_1h": F.when(n >= lag + 1, at(n - 1 - lag)), "rd_4h": F.when(n >= 2, at(F.lit(0))),
        "rd_prev": ref, "delta": now - ref})


def escalation_counts(esc: DataFrame) -> DataFrame:
    c = F.count_if
    return esc.agg(F.max("depth").alias("cycles_tracked"),
                   c(F.col("rd_now") > F.col("rd_1h")).alias("up_1h"), c(F.col("rd_now") < F.col("rd_1h")).alias("down_1h"),
                   c(F.col("rd_now") > F.col("rd_4h")).alias("up_4h"), c(F.col("rd_now") < F.col("rd_4h")).alias("down_4h"),
                   c((F.col("delta") == 0) & (F.col("rd_now") >= 3)).alias("steady_alert_total"))


def rising(esc: DataFrame, n: int = 12) -> DataFrame:
    return esc.where("delta > 0").orderBy(F.col("delta").desc(), F.col("rd_now").desc(), "ua_id", "hazard").limit(n)


def falling(esc: DataFrame, n: int = 12) -> DataFrame:
    return esc.where("delta < 0").orderBy("delta", F.col("rd_prev").desc(), "ua_id", "hazard").limit(n)


def steady(esc: DataFrame, rain_column: str = "ac24h_mm", n: int = 12) -> DataFrame:
    """Units in alert without a change of level, worst first, then by 24 h rain (none counts as 0); ``esc`` is ``described``."""
    return esc.where("delta = 0 AND rd_now >= 3").orderBy(F.col("rd_now").desc(), F.coalesce(F.col(rain_column), F.lit(0.0)).desc(), "ua_id", "hazard").limit(n)


def top_units(points: DataFrame, n: int = 10) -> DataFrame:
    """Worst units by level, then 96 h rain."""
    return points.where(F.col("rd").isNotNull()).orderBy(
        F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), "ua_id", "hazard").limit(n)


def region_matrix(points: DataFrame, name: str = "region_name") -> DataFrame:
    """Region by level counts; rows without a region are out of coverage."""
    region = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(OUT_OF_COVERAGE)).otherwise(F.col(name)).alias("regiao")
    return points.groupBy(region).agg(*[F.count_if(F.coalesce("rd", F.lit(0)) == i).alias(f"rd{i}") for i in range(5)])


def latest_cycles(cycles: DataFrame, n: int = 12, ts: str = "started_at", tie: str = "cycle_id") -> DataFrame:
    return cycles.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


#: Columns of the last cycle that the headline shows.
LAST_CYCLE = ("ac24h_max", "ac96h_max", "intensity_max", "files_ok", "missing_24h", "data_status", "gauge_factor", "gauge_stations", "duration_s")


def headline(points: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: alerts now, changes, worst level, and rain maxima, data state and gauges of the last cycle. Without gauges their columns are null."""
    now = points.agg(F.count_if(F.col("rd") >= 3).alias("alerts_now"), F.coalesce(F.max("rd"), F.lit(0)).alias("max_rd"),
                     risk.level_label(F.coalesce(F.max("rd"), F.lit(0))).alias("max_rd_name"))
    flat = cycles.withColumns({"gauge_factor": F.col("gauge.mean_factor"), "gauge_stations": F.col("gauge.stations_recent")})
    return with_row(now, alert_deltas(flat, last_values=LAST_CYCLE).drop("alert_count"))


def described(esc: DataFrame, points: DataFrame) -> DataFrame:
    """Escalation rows with what the points know about the unit: road, place and rain."""
    known = [c for c in ("sigla_rodovia", "km_inicial", "km_final", "regiao_nome", "region_name", "municipio", "ac24h_mm", "ac96h_mm") if c in points.columns]
    return esc.join(points.select("ua_id", "hazard", *known), ["ua_id", "hazard"], "left")
