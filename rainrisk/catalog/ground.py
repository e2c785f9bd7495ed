from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import gauges, risk
from ..plans import cycle
from . import query
from .gauges import ANCHOR, CORRECTED, DAY, GROWN, MOVED, PAIRS30, PRIMARY_CTES, SERIES, SUSPECT_SQL, hav
from .rain import WINDOW_COLS, inputs
from .risk import LIVE_CTES, NIVEL, half_up

# the cycle with gauges: suspect stations out, measured units, corrected units, forecast, regions, risk
GROUND_CTES = ({"dy": DAY, "su": SUSPECT_SQL, "kept": "SELECT * FROM stations s WHERE station_id NOT IN (SELECT station_id FROM su)"}
               | PRIMARY_CTES | {"sr": SERIES.replace("JOIN stations s", "JOIN kept s"), "pairs": PAIRS30, "est": ANCHOR}
               | {"co": CORRECTED.replace("SELECT uw.*", "SELECT pw.*").replace("FROM uw LEFT", "FROM pw LEFT").replace("WHEN g24_mm IS NULL", "WHEN from_gauges OR g24_mm IS NULL"), "mv": MOVED, "gn": GROWN}
               | {"uw": f"SELECT pw.* REPLACE ({', '.join(f'gn.{c} AS {c}' for c in WINDOW_COLS)}), correction, factor FROM pw JOIN gn USING (ua_id)"}
               | {k: v for k, v in LIVE_CTES.items() if k not in ("cw", "uw")})
GROUND_TABLES = "grid_hourly units forecast_grid regions stations gauge_hourly stations_24h"


def grounded(spark, sf):
    data = inputs(spark, sf, forecast_grid=fx.forecast_grid(spark, sf), stations=fx.stations(spark, sf), gauge_hourly=fx.gauge_hourly(spark, sf, 96),
                  stations_24h=fx.stations_24h(spark, sf), gauge_radius_km=30.0, gauge_coverage=0.8, suspect_radius_km=30.0, suspect_min_hours=1)
    return cycle.risk_points(data, fx.target())


@query("CMP-01 SCL-11 SCL-13", fx.sql_with(GROUND_TABLES, GROUND_CTES, f"""SELECT ua_id, hazard, regiao_id, CASE WHEN from_gauges THEN 'GAUGES' ELSE 'SATELLITE' END AS source, correction,
    CASE WHEN regiao_id IS NULL THEN intensity_mmh ELSE {half_up('intensity_mmh', 1)} END AS intensity_mmh, ac18h_mm AS ac18h_obs_mm, ac72h_mm AS ac72h_obs_mm, fonte_chuva, icc_geo, icc_hid, rd, {NIVEL} AS nivel, ROUND(cpc, 2) AS cpc FROM ev"""))
def risk_points_with_gauges(spark, sf):
    return grounded(spark, sf).select("ua_id", "hazard", "regiao_id", "source", "correction", "intensity_mmh", "ac18h_obs_mm", "ac72h_obs_mm", "fonte_chuva",
                                      "icc_geo", "icc_hid", "rd", "nivel", "cpc")


@query("AGG-28 CMP-01", fx.sql_with(GROUND_TABLES, GROUND_CTES | {"u1": "SELECT * FROM ev WHERE hazard = 'geo'"}, f"""SELECT COUNT(*) FILTER (correction <> 'none') > 0 AS corrected, ROUND(SUM(ROUND(factor*1e9)::BIGINT)/COUNT(factor)/1e9, 3) AS mean_factor,
    (SELECT COUNT(*) FROM stations_24h) AS stations_recent, COUNT(*) FILTER (correction <> 'none') AS points_corrected, COUNT(*) FILTER (from_gauges) > 0 AS primary_applied,
    COUNT(*) FILTER (from_gauges) AS points_gauge, (SELECT COUNT(*) FROM stations s SEMI JOIN units u ON {hav('u', 's')} <= 2) AS stations_near, NULL AS error FROM u1"""))
def cycle_gauge_blocks(spark, sf):
    near = gauges.stations_near(fx.stations(spark, sf), fx.units(spark, sf), 2.0)
    out = risk.gauge_blocks(grounded(spark, sf), near, fx.stations_24h(spark, sf))
    g, p = "gauge", "gauge_primary"
    return out.select(F.col(f"{g}.applied").alias("corrected"), f"{g}.mean_factor", f"{g}.stations_recent", f"{g}.points_corrected",
                      F.col(f"{p}.applied").alias("primary_applied"), f"{p}.points_gauge", f"{p}.stations_near", f"{p}.error")
