from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import intervals, sequences
from ..operators.scale import numbered
from ..plans import preparation
from . import query

ORD = "(PARTITION BY road ORDER BY km0, ua_id)"
NUM = f"SELECT *, row_number() OVER {ORD} AS rn FROM units"


@query("WIN-08", fx.sql_with("units", {"n": NUM, "v": """SELECT a.ua_id, b.cls, COUNT(*) AS votes, MIN(b.rn) AS first FROM n a JOIN n b ON a.road=b.road AND b.rn BETWEEN a.rn-2 AND a.rn+2 GROUP BY ALL"""},
       "SELECT ua_id, arg_max(cls, (votes, -first)) AS smooth FROM v GROUP BY ua_id"))
def moving_mode(spark, sf):
    return sequences.moving_mode(fx.units(spark, sf).select("road", "km0", "ua_id", "cls"), ["road"], ["km0", "ua_id"], "cls", 5).select("ua_id", "smooth")


@query("WIN-08", fx.sql_with("units", {"n": f"SELECT * REPLACE (CASE WHEN ua_id%3=0 OR km0 < 9e0 THEN NULLIF(cls, cls) ELSE cls END AS cls), row_number() OVER {ORD} AS rn FROM units",
       "v": "SELECT a.ua_id, b.cls, COUNT(*) AS votes, MIN(b.rn) AS first FROM n a JOIN n b ON a.road=b.road AND b.rn BETWEEN a.rn-4 AND a.rn+4 WHERE b.cls IS NOT NULL GROUP BY ALL",
       "m": "SELECT n.road, n.rn, n.ua_id, x.smooth FROM n LEFT JOIN (SELECT ua_id, arg_max(cls, (votes, -first)) AS smooth FROM v GROUP BY ua_id) x USING (ua_id)"},
       "SELECT ua_id, COALESCE(last_value(smooth IGNORE NULLS) OVER (PARTITION BY road ORDER BY rn ROWS UNBOUNDED PRECEDING), first_value(smooth IGNORE NULLS) OVER (PARTITION BY road ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS smooth FROM m"))
def moving_mode_filled(spark, sf):
    u = fx.units(spark, sf).select("road", "km0", "ua_id", F.when(~((F.col("ua_id") % 3 == 0) | (F.col("km0") < 9)), F.col("cls")).alias("cls"))
    return sequences.moving_mode(u, ["road"], ["km0", "ua_id"], "cls", 9, fill=True).select("ua_id", "smooth")


RUNS = f"""SELECT road, run, cls, MIN(km0) AS run_start, MAX(km1) AS run_stop, COUNT(*) AS n FROM (SELECT *, SUM(ch) OVER (PARTITION BY road ORDER BY km0, ua_id) AS run FROM (
    SELECT *, CASE WHEN lag(cls) OVER {ORD} IS DISTINCT FROM cls THEN 1 ELSE 0 END AS ch FROM units)) GROUP BY ALL"""


@query("WIN-09", fx.sql_with("units", {"r": RUNS}, "SELECT road, run::BIGINT AS run, cls, run_start, run_stop, n FROM r WHERE cls <> -1"))
def class_runs(spark, sf):
    return sequences.run_lengths(fx.units(spark, sf), ["road"], ["km0", "ua_id"], "cls", "km0", "km1")


def _absorbed_sql(unwanted: str, more: str = "") -> str:
    """The rule row by row: state is the last kept run and the start handed on to the right."""
    step = f"""SELECT *, {unwanted} AND NOT (kid IS NULL AND na IS NULL) AS gone, na IS NULL OR (kid IS NOT NULL AND kb - ka >= nb - na) AS toleft"""
    state = """CASE WHEN gone THEN kid ELSE run END AS kid, CASE WHEN gone THEN kcls ELSE cls END AS kcls, CASE WHEN gone THEN ka ELSE s END AS ka,
        CASE WHEN gone AND NOT toleft THEN kb ELSE b END AS kb, CASE WHEN gone AND NOT toleft THEN s END AS carry"""
    return f"""SELECT road, arg_min(kid, kid) AS run, cls, MIN(ka) AS run_start, arg_max(kb, kid) AS run_stop{more} FROM (
        SELECT *, SUM(ch) OVER (PARTITION BY road ORDER BY kid) AS g FROM (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY road ORDER BY kid) IS DISTINCT FROM cls THEN 1 ELSE 0 END AS ch FROM (
        SELECT road, kid, kcls AS cls, MIN(ka) AS ka, MAX(kb) AS kb FROM (WITH RECURSIVE
            o AS (SELECT road, run::BIGINT AS run, cls, run_start AS a, run_stop AS b, row_number() OVER w AS i, lead(run_start) OVER w AS na, lead(run_stop) OVER w AS nb FROM r WINDOW w AS (PARTITION BY road ORDER BY run)),
            f AS (SELECT road, i, {state} FROM ({step} FROM (SELECT *, a AS s, NULL::BIGINT AS kid, NULL::INT AS kcls, NULL::DOUBLE AS ka, NULL::DOUBLE AS kb FROM o WHERE i = 1))
                UNION ALL SELECT road, i, {state} FROM ({step} FROM (SELECT o.*, COALESCE(f.carry, o.a) AS s, f.kid, f.kcls, f.ka, f.kb FROM f JOIN o ON o.road = f.road AND o.i = f.i + 1)))
            SELECT * FROM f WHERE kid IS NOT NULL) GROUP BY ALL))) GROUP BY road, g, cls"""


@query("WIN-10", fx.sql_with("units", {"r": RUNS}, _absorbed_sql("b - s < 1.5e0")))
def absorbed_runs(spark, sf):
    runs = sequences.run_lengths(fx.units(spark, sf), ["road"], ["km0", "ua_id"], "cls", "km0", "km1", drop=None)
    return sequences.absorb_runs(runs, ["road"], "cls", 1.5)


@query("WIN-10", fx.sql_with("units", {"r": RUNS}, _absorbed_sql("cls < 1", ", cls >= 1 AS ok")))
def absorbed_foreign_runs(spark, sf):
    runs = sequences.run_lengths(fx.units(spark, sf), ["road"], ["km0", "ua_id"], "cls", "km0", "km1", drop=None)
    return sequences.absorb_runs(runs.withColumn("ok", F.col("cls") >= 1), ["road"], "cls", allowed="ok")


SCORE = "(ua_id*7%9)::DOUBLE/2e0 AS score, CASE WHEN ua_id%4=0 THEN 0.1e0 ELSE 0.7e0 END AS conf"
FILL = {"n": f"SELECT ua_id, road, {SCORE}, row_number() OVER {ORD} AS rn FROM units",
        "f": """SELECT *, last_value(CASE WHEN conf >= 0.35e0 THEN score END IGNORE NULLS) OVER (PARTITION BY road ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
            lead(CASE WHEN conf >= 0.35e0 THEN score END) OVER (PARTITION BY road ORDER BY rn) AS r FROM n"""}


def _scored(spark, sf):
    k = F.col("ua_id")
    return fx.units(spark, sf).select("road", "km0", "ua_id", ((k * 7 % 9).cast("double") / 2.0).alias("score"),
                                      F.when(k % 4 == 0, F.lit(0.1)).otherwise(F.lit(0.7)).alias("conf"), (k % 5).cast("int").alias("mode"))


@query("WIN-07", fx.sql_with("units", FILL, "SELECT ua_id, CASE WHEN conf < 0.35e0 THEN COALESCE((l+r)/2e0, l, r, score) ELSE score END AS score, CASE WHEN conf < 0.35e0 AND COALESCE(l, r) IS NOT NULL THEN 0.5e0 ELSE conf END AS conf FROM f"))
def filled_scores(spark, sf):
    return sequences.fill_from_neighbours(_scored(spark, sf), ["road"], ["km0", "ua_id"]).select("ua_id", "score", "conf")


SMOOTH = FILL | {
    "g": """SELECT ua_id, road, rn, CASE WHEN conf < 0.35e0 THEN COALESCE((l+r)/2e0, l, r, score) ELSE score END AS s,
        CASE WHEN conf < 0.35e0 AND COALESCE(l, r) IS NOT NULL THEN 0.5e0 ELSE conf END AS c, conf < 0.35e0 AND COALESCE(l, r) IS NOT NULL AS filled FROM f""",
    "w": "SELECT *, lead(s) OVER (PARTITION BY road ORDER BY rn) AS ns, lead(c) OVER (PARTITION BY road ORDER BY rn) AS nc FROM g",
    "walk": """SELECT ua_id, road, rn, s, c, filled, FALSE AS fixed FROM w WHERE rn = 1 UNION ALL SELECT ua_id, road, rn, CASE WHEN fix THEN CASE WHEN pc >= nc THEN ps ELSE ns END ELSE s END,
        CASE WHEN fix THEN LEAST(c, 0.6e0) ELSE c END, filled, fix FROM (SELECT w.*, k.s AS ps, k.c AS pc, COALESCE(w.c >= 0.35e0 AND ABS(k.s - w.ns) <= 1 AND ABS(w.s - k.s) > 1.5e0, FALSE) AS fix
        FROM walk k JOIN w ON w.road = k.road AND w.rn = k.rn + 1)"""}


@query("WIN-07", fx.sql_with("units", SMOOTH, "SELECT ua_id, s AS score, c AS conf, CASE WHEN filled OR fixed THEN round_even(s, 0)::INT ELSE (ua_id%5)::INT END AS mode FROM walk").replace("WITH ", "WITH RECURSIVE ", 1))
def smoothed_scores(spark, sf):
    return sequences.smooth_neighbours(_scored(spark, sf), ["road"], ["km0", "ua_id"]).select("ua_id", "score", "conf", "mode")


ISLANDS = """SELECT road, MIN(r0) AS a, MAX(r1) AS b, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds FROM (SELECT *, SUM(st) OVER (PARTITION BY road ORDER BY r0, r1, kind, ord) AS isl FROM (
    SELECT *, CASE WHEN r0 > COALESCE(MAX(r1) OVER (PARTITION BY road ORDER BY r0, r1, kind, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e0) THEN 1 ELSE 0 END AS st FROM stretches)) GROUP BY road, isl"""


def _critical(spark, sf):
    return fx.stretches(spark, sf).select("road", F.col("r0").alias("a"), F.col("r1").alias("b"), "kind")


@query("WIN-11", fx.sql_with("stretches", {"i": ISLANDS}, "SELECT * FROM i"))
def merged_critical_ranges(spark, sf):
    return intervals.union_intervals(_critical(spark, sf), ["road"])


LENGTHS = "SELECT road, MAX(r1) + 5e0 AS length FROM segments GROUP BY road"
FREE = """SELECT road, COALESCE(lag(b) OVER (PARTITION BY road ORDER BY a), 0e0) AS free0, a AS free1 FROM i UNION ALL
    SELECT l.road, COALESCE((SELECT MAX(b) FROM i WHERE i.road=l.road), 0e0), l.length FROM ln l"""


def _lengths(spark, sf):
    return fx.segments(spark, sf).groupBy("road").agg((F.max("r1") + 5.0).alias("length"))


@query("WIN-12", fx.sql_with("stretches segments", {"i": ISLANDS, "ln": LENGTHS, "fr": FREE}, "SELECT * FROM fr WHERE free1 > free0"))
def free_ranges(spark, sf):
    return intervals.complement_intervals(_critical(spark, sf), _lengths(spark, sf), ["road"])


PIECES = """SELECT road, u AS unit, arg_min(s, (-ROUND(e-s, 9), s)) AS start, arg_min(e, (-ROUND(e-s, 9), s)) AS stop FROM (
    SELECT road, u, a + GREATEST((u-1)*tot/{n}e0, bef) - bef AS s, a + LEAST(u*tot/{n}e0, bef+(b-a)) - bef AS e, GREATEST((u-1)*tot/{n}e0, bef) AS p0, LEAST(u*tot/{n}e0, bef+(b-a)) AS p1 FROM (
      SELECT *, COALESCE(SUM(b-a) OVER (PARTITION BY road ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS bef, SUM(b-a) OVER (PARTITION BY road) AS tot FROM {t}), range(1, {n}+1) r(u)) WHERE p1 - p0 > 1e-9 GROUP BY ALL"""


@query("WIN-13", fx.sql_with("stretches", {"i": ISLANDS, "sp": PIECES.format(n=7, t="i")}, "SELECT road, unit::INT AS unit, ROUND(start, 6) AS start, ROUND(stop, 6) AS stop FROM sp"))
def even_units(spark, sf):
    merged = intervals.union_intervals(_critical(spark, sf), ["road"])
    counts = _lengths(spark, sf).select("road", F.lit(7).alias("n"))
    return intervals.split_evenly(merged, counts, ["road"]).select("road", "unit", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query("CMP-10", fx.sql_with("stretches segments", {"i": ISLANDS, "ln": LENGTHS, "fr": FREE, "ff": "SELECT road, free0 AS a, free1 AS b FROM fr WHERE free1 > free0",
       "sr": PIECES.format(n=4, t="i"), "ut": PIECES.format(n=20, t="ff")}, """SELECT road, 'SR' AS tipo, unit::INT AS ordem_no_grupo, ROUND(start, 6) AS start, ROUND(stop, 6) AS stop FROM sr
       UNION ALL SELECT road, 'UTB', unit::INT, ROUND(start, 6), ROUND(stop, 6) FROM ut"""))
def generated_units(spark, sf):
    wanted = _lengths(spark, sf).select("road", F.lit(4).alias("n_sr"), F.lit(20).alias("n_utb"))
    out = preparation.generate_units(_lengths(spark, sf), _critical(spark, sf), wanted, ["road"])
    return out.withColumns({c: F.round(c, 6) for c in ("start", "stop")})


@query("SCL-39", fx.sql_with("units segments", {"ln": "SELECT road, MIN(r0) AS lo, MAX(r1) AS hi FROM segments GROUP BY road"}, """SELECT ua_id, CASE WHEN km0 < lo - 0.001e0 OR km0 > hi + 0.001e0 THEN NULL
    ELSE ROUND(GREATEST(0e0, LEAST(1e0, (km0-lo)/(hi-lo)))*12345e0, 6) END AS offset_m FROM units JOIN ln USING (road)"""))
def km_offsets(spark, sf):
    ln = fx.segments(spark, sf).groupBy("road").agg(F.min("r0").alias("lo"), F.max("r1").alias("hi"))
    u = fx.units(spark, sf).join(ln, "road")
    return u.select("ua_id", F.round(intervals.km_to_offset(F.col("km0"), F.col("lo"), F.col("hi"), F.lit(12345.0)), 6).alias("offset_m"))


@query("WIN-15", fx.sql_with("units", {"p": f"SELECT road, cls, lag(cls) OVER {ORD} AS pc FROM units"}, "SELECT road, COUNT(pc) AS pairs, COUNT(*) FILTER (ABS(cls-pc) <= 1) AS smooth_pairs, ROUND(COUNT(*) FILTER (ABS(cls-pc) <= 1)/COUNT(pc)::DOUBLE, 6) AS continuity FROM p GROUP BY road"))
def class_continuity(spark, sf):
    out = sequences.continuity(fx.units(spark, sf).select("road", "km0", "ua_id", "cls"), ["road"], ["km0", "ua_id"], "cls")
    return out.withColumn("continuity", F.round("continuity", 6))


QUOTA = "SELECT road, escala, COUNT(*)//10 AS q4, COUNT(*)//8 AS q3, COUNT(*)//5 AS q2, COUNT(*)//4 AS q1, COUNT(*) AS n FROM units GROUP BY ALL"


def _quotas(spark, sf):
    n = F.col("n")
    q = fx.units(spark, sf).groupBy("road", "escala").agg(F.count(F.lit(1)).alias("n"))
    parts = [F.floor(n / d).cast("int") for d in (4, 5, 8, 10)]
    q0 = n.cast("int") - parts[0] - parts[1] - parts[2] - parts[3]
    return q.select("road", "escala", F.array(q0, *parts).alias("quota"))


ALLOC = """SELECT ua_id, CASE WHEN rn <= q4 THEN 4 WHEN rn <= q4+q3 THEN 3 WHEN rn <= q4+q3+q2 THEN 2 WHEN rn <= q4+q3+q2+q1 THEN 1 ELSE 0 END AS assigned FROM (
    SELECT *, row_number() OVER (PARTITION BY road, escala ORDER BY COALESCE({s}, -1) DESC, ua_id) AS rn FROM {t}) JOIN q USING (road, escala)"""


@query("WIN-06", fx.sql_with("units", {"q": QUOTA, "al": ALLOC.format(s="cls", t="units")}, "SELECT * FROM al"))
def quota_classes(spark, sf):
    return sequences.allocate_quota(fx.units(spark, sf), _quotas(spark, sf), ["road", "escala"], "cls", "ua_id").select("ua_id", "assigned")


@query("CMP-11", fx.sql_with("units stretches", {"q": QUOTA, "mj": """SELECT ua_id, arg_max(ra, (o, ra)) AS sug FROM (SELECT u.ua_id, s.ra, SUM(ROUND(GREATEST(0e0, LEAST(u.km1, s.r1) - GREATEST(u.km0, s.r0))*1e6)::BIGINT) AS o FROM units u
    JOIN stretches s ON u.road = s.road AND GREATEST(u.km0, s.r0) <= LEAST(u.km1, s.r1) GROUP BY ALL HAVING o > 0) GROUP BY ua_id""", "us": "SELECT units.*, sug FROM units LEFT JOIN mj USING (ua_id)", "al": ALLOC.format(s="sug", t="us")}, "SELECT * FROM al"))
def assigned_classes(spark, sf):
    out = preparation.assign_classes(fx.units(spark, sf).drop("cls"), fx.stretches(spark, sf).withColumnRenamed("ra", "cls"), _quotas(spark, sf), ["road", "escala"], "ua_id")
    return out.select("ua_id", "assigned")


@query("WIN-06", fx.sql_with("units", {"q": QUOTA}, "SELECT road, escala, n AS units, (n-1)::INT AS quota_units FROM q WHERE road='Brand#3'"))
def quota_mismatches(spark, sf):
    q = _quotas(spark, sf)
    short = F.when(F.col("road") == "Brand#3", F.transform("quota", lambda x, i: F.when(i == 0, x - 1).otherwise(x))).otherwise(F.col("quota"))
    return sequences.quota_mismatches(fx.units(spark, sf), q.withColumn("quota", short), ["road", "escala"])


OVER = lambda c: f"list_transform(range(5), lambda k: len(list_filter({c}, lambda x: x = k)) - CASE WHEN k = 0 THEN n - 4*(n//5) ELSE n//5 END)"
#: One move a step: the nearest member of the fullest class goes to the emptiest one.
CALIBRATED = {"n": NUM, "st": "SELECT road, (rn-1)//100 AS stretch, list(GREATEST(COALESCE(cls, 0), 0)::INT ORDER BY rn) AS c, list(ua_id ORDER BY rn) AS ids, COUNT(*)::INT AS n FROM n GROUP BY ALL",
              "walk": f"""SELECT ids, n, c, {OVER('c')} AS over FROM st UNION ALL SELECT ids, n, moved AS c, {OVER('moved')} AS over FROM (
    SELECT *, list_transform(c, lambda x, i: CASE WHEN i = pick THEN t ELSE x END) AS moved FROM (SELECT *, movable[COALESCE(list_position(gaps, list_min(gaps)), 1)] AS pick FROM (
    SELECT *, list_transform(movable, lambda i: list_min(list_transform(anchors, lambda j: abs(i - j)))) AS gaps FROM (
    SELECT *, list_filter(range(1, n + 1), lambda i: c[i] = s) AS movable, list_filter(range(1, n + 1), lambda i: c[i] = t) AS anchors FROM (
    SELECT *, list_position(over, list_max(over))::INT - 1 AS s, list_position(over, list_min(over))::INT - 1 AS t FROM walk WHERE list_max(over) > 0)))))"""}


@query("WIN-16", fx.sql_with("units", CALIBRATED, "SELECT unnest(ids) AS ua_id, unnest(c) AS cls FROM walk WHERE list_max(over) = 0").replace("WITH ", "WITH RECURSIVE ", 1))
def calibrated_classes(spark, sf):
    """Stretches of 100 consecutive units are calibrated to equal shares."""
    u = numbered(fx.units(spark, sf).select("road", "km0", "ua_id", "cls"), ["road"], ["km0", "ua_id"])
    u = u.withColumn("stretch", F.floor((F.col("rn") - 1) / 100).cast("long"))
    n = u.groupBy("road", "stretch").agg(F.count(F.lit(1)).cast("int").alias("n"))
    fifth = F.floor(F.col("n") / 5).cast("int")
    quotas = n.select("road", "stretch", F.array(F.col("n") - fifth * 4, fifth, fifth, fifth, fifth).alias("quota"))
    return sequences.calibrate_to_quota(u, quotas, ["road", "stretch"], "rn", "cls").select("ua_id", "cls")


SHARE = {"r0": RUNS, "z": "SELECT road, run::BIGINT AS seq, run_stop - run_start AS size FROM r0",
         "raw": "SELECT *, size/(SUM(size) OVER (PARTITION BY road))*200e0 AS raw FROM z", "base": "SELECT *, GREATEST(1, floor(raw)::INT) AS b FROM raw",
         "bal": "SELECT *, (SUM(b) OVER (PARTITION BY road))::BIGINT - 200 AS over FROM base",
         "give": "SELECT road, seq, 1 AS d FROM bal WHERE over < 0 QUALIFY row_number() OVER (PARTITION BY road ORDER BY -ROUND(raw-b, 9), seq) <= -over",
         "steps": "SELECT road, seq, over, unnest(range(1, b)) AS j, b, raw FROM bal WHERE over > 0 AND b > 1",
         "take": "SELECT road, seq, -COUNT(*) AS d FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY road ORDER BY -ROUND(b-raw-j+1, 9), seq, j) <= over) GROUP BY ALL"}


@query("WIN-14", fx.sql_with("units", SHARE, "SELECT road, seq, (b + COALESCE(g.d, 0) + COALESCE(t.d, 0))::INT AS allotted FROM bal LEFT JOIN give g USING (road, seq) LEFT JOIN take t USING (road, seq)"))
def proportional_units(spark, sf):
    runs = sequences.run_lengths(fx.units(spark, sf), ["road"], ["km0", "ua_id"], "cls", "km0", "km1", drop=None)
    sized = runs.select("road", F.col("run").alias("seq"), (F.col("run_stop") - F.col("run_start")).alias("size"), F.lit(200).alias("n"))
    return intervals.proportional_split(sized, ["road"]).select("road", "seq", "allotted")


@query("WIN-17", fx.sql_with("stretches", {"i": ISLANDS, "c": """SELECT road, ROUND((a + j*(b-a)/3e0)::DECIMAL(18,9), 3)::DOUBLE AS km_ini, ROUND((a + (j+1)*(b-a)/3e0)::DECIMAL(18,9), 3)::DOUBLE AS km_fim, j=0 AS planned_start FROM i, range(3) r(j)"""},
       """SELECT road, km_ini, km_fim, planned_start, ROUND(COALESCE((lag(km_fim) OVER w + km_ini)/2e0, km_ini), 6) AS km_lo, ROUND(COALESCE((km_fim + lead(km_ini) OVER w)/2e0, km_fim), 6) AS km_hi FROM c WINDOW w AS (PARTITION BY road ORDER BY km_ini)"""))
def sliced_plan(spark, sf):
    merged = intervals.union_intervals(_critical(spark, sf), ["road"]).select("road", F.col("a").alias("km0"), F.col("b").alias("km1"), F.lit(3).alias("n"))
    out = intervals.slice_plan(merged, ["road"])
    return out.withColumns({c: F.round(c, 6) for c in ("km_lo", "km_hi")})


@query("WIN-18 SCL-40", fx.sql_with("units", {"s": f"SELECT *, lag(lat) OVER {ORD} AS plat, lag(lon) OVER {ORD} AS plon FROM units",
       "d": """SELECT *, CASE WHEN plat IS NOT NULL THEN 2*6371e0*asin(sqrt(pow(sin(radians(lat-plat)/2),2)+cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lon-plon)/2),2)))*1000 END AS st FROM s""",
       "r": f"SELECT *, SUM(CASE WHEN st > 60000 THEN 1 ELSE 0 END) OVER {ORD} AS run FROM d"},
       "SELECT road, run::BIGINT AS run, COUNT(*) AS n_points, ROUND(SUM(CASE WHEN st <= 60000 THEN st ELSE 0 END)/1000, 1) AS length_km FROM r GROUP BY ALL"))
def chain_runs(spark, sf):
    out = sequences.chain_runs(fx.units(spark, sf).select("road", "km0", "ua_id", "lat", "lon"), ["road"], ["km0", "ua_id"], 60000.0)
    return out.select("road", "run", "n_points", F.round(F.col("length_m") / 1000, 1).alias("length_km"))


@query("WIN-05", fx.sql_with("cycles", {}, "SELECT cycle_id, ROUND(date_diff('second', lag(started_at) OVER (ORDER BY started_at, cycle_id), started_at)/60e0, 6) AS gap_min FROM cycles"))
def cycle_gaps(spark, sf):
    return sequences.cycle_gaps(fx.cycles(spark, sf).select("cycle_id", "started_at")).select("cycle_id", F.round("gap_min", 6).alias("gap_min"))
