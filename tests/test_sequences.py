"""Row-to-row rules against plain loops written from their description."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from rainrisk.operators import intervals, scale, sequences


def test_smoothing_rules(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(4):
        n = 150
        s = [rng.choice([0.0, 1.0, 2.0, 3.0, 4.0, 0.5, 2.5]) for _ in range(n)]
        c = [rng.choice([0.1, 0.2, 0.4, 0.9, 0.7]) for _ in range(n)]
        rows += [(f"g{g}", i, s[i], c[i], 0) for i in range(n)]
        # pass 1: weak scores copy trusted neighbours, left to right
        for i in range(n):
            if c[i] < 0.35:
                near = [s[j] for j in (i - 1, i + 1) if 0 <= j < n and c[j] >= 0.35]
                if near:
                    s[i], c[i] = sum(near) / len(near), 0.5
        # pass 2: a trusted score far from two agreeing neighbours follows the surer one
        for i in range(1, n - 1):
            if c[i] >= 0.35 and abs(s[i - 1] - s[i + 1]) <= 1 and abs(s[i] - s[i - 1]) > 1.5:
                s[i] = s[i - 1] if c[i - 1] >= c[i + 1] else s[i + 1]
                c[i] = min(c[i], 0.6)
        want |= {(f"g{g}", i): (s[i], c[i]) for i in range(n)}
    df = spark.createDataFrame(rows, "k string, pos int, score double, conf double, mode int").repartition(5)
    got = {(r.k, r.pos): (r.score, r.conf) for r in sequences.smooth_neighbours(df, ["k"], ["pos"]).collect()}
    assert got == want


def plain_runs(values):
    runs = []
    for km, c in values:
        if runs and runs[-1][0] == c:
            runs[-1][2] = km
        else:
            runs.append([c, km, km])
    return runs


def absorb_plainly(runs, unwanted):
    runs = [list(r) for r in runs]
    while len(runs) > 1:
        i = next((i for i, r in enumerate(runs) if unwanted(r)), None)
        if i is None:
            break
        size = {j: runs[j][2] - runs[j][1] for j in (i - 1, i + 1) if 0 <= j < len(runs)}
        j = max(sorted(size), key=size.get)
        runs[j] = [runs[j][0], min(runs[i][1], runs[j][1]), max(runs[i][2], runs[j][2])]
        del runs[i]
    out = []
    for r in runs:
        if out and out[-1][0] == r[0]:
            out[-1][2] = r[2]
        else:
            out.append(r)
    return out


def test_short_and_foreign_runs_are_absorbed(spark):
    rng = random.Random(2)
    rows, short, foreign = [], {}, {}
    for g in range(3):
        cls, seq = 1, []
        for i in range(300):
            cls = rng.choice([1, 2, 3]) if rng.random() < 0.3 else cls
            seq.append((i * 64.0, cls))
        rows += [(f"r{g}", a, b) for a, b in seq]
        short[f"r{g}"] = absorb_plainly(plain_runs(seq), lambda r: r[2] - r[1] < 256)
        foreign[f"r{g}"] = absorb_plainly(plain_runs(seq), lambda r: r[0] == 3)
    df = spark.createDataFrame(rows, "k string, km double, c int").repartition(4)
    runs = sequences.run_lengths(df, ["k"], ["km"], "c", "km", drop=None)

    def result(out):
        got = {}
        for r in sorted(out.collect(), key=lambda r: r.run):
            got.setdefault(r.k, []).append([r.c, r.run_start, r.run_stop])
        return got

    assert result(sequences.absorb_runs(runs, ["k"], "c", 256.0)) == short
    assert result(sequences.absorb_runs(runs.withColumn("ok", F.col("c") != 3), ["k"], "c", allowed="ok")) == foreign


def test_moving_mode_with_gaps(spark):
    rng = random.Random(5)
    seq = [None] * 12 + [rng.choice([None, None, 1, 2, 3]) for _ in range(120)] + [None] * 9
    mode = []
    for i in range(len(seq)):
        seen = [v for v in seq[max(0, i - 4):i + 5] if v is not None]
        mode.append(Counter(seen).most_common(1)[0][0] if seen else (mode[-1] if mode else None))
    first = next(v for v in mode if v is not None)
    want = [first if v is None else v for v in mode]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(seq)], "k string, i int, c int").repartition(3)
    got = [r.smooth for r in sequences.moving_mode(df, ["k"], ["i"], "c", 9, fill=True).orderBy("i").collect()]
    assert got == want


def test_a_road_of_short_runs_only(spark):
    """A long stretch goes through one pass: equal short runs meet in one kept run that swallows all others."""
    n = 100_000
    runs = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("run"), (F.col("id") % 2).cast("int").alias("c"),
                                 F.col("id").cast("double").alias("run_start"), (F.col("id") + 1).cast("double").alias("run_stop"), F.lit(1).cast("long").alias("n"))
    got = [(r.run, r.c, r.run_start, r.run_stop) for r in sequences.absorb_runs(runs, ["k"], "c", 1.5).collect()]
    assert got == [(1, 1, 0.0, float(n))]


def test_neighbour_chunks_cross_borders(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(100)], "k string, i int, v int")
    rows, w = scale.neighbour_chunks(scale.numbered(df, ["k"], ["i"]), ["k"], "rn", 2, chunk=7)
    got = scale.own_rows(rows.withColumn("s", F.sum("i").over(w.rowsBetween(-2, 2)))).collect()
    assert len(got) == 100 and all(r.s == sum(range(max(0, r.i - 2), min(99, r.i + 2) + 1)) for r in got)


def test_calibration_reaches_the_quota(spark):
    rng = random.Random(4)
    rows = [("g", i, rng.choice([-1, 0, 1, 2, 2, 2, 3])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos int, cls int")
    q = spark.createDataFrame([("g", [10, 20, 10, 10, 10])], "k string, quota array<int>")
    out = sequences.calibrate_to_quota(df, q, ["k"], "pos", "cls").collect()
    assert Counter(r.cls for r in out) == {0: 10, 1: 20, 2: 10, 3: 10, 4: 10}
    # a class with no unit yet is seeded from the first unit of the fullest class
    two = spark.createDataFrame([("g", 0, 1), ("g", 1, 1), ("g", 2, 1)], "k string, pos int, cls int")
    q2 = spark.createDataFrame([("g", [0, 2, 0, 1, 0])], "k string, quota array<int>")
    assert [r.cls for r in sequences.calibrate_to_quota(two, q2, ["k"], "pos", "cls").orderBy("pos").collect()] == [3, 1, 1]


def moved_one_by_one(classes, want):
    """Quota calibration with every distance looked at in every step."""
    classes = [max(c or 0, 0) for c in classes]
    while True:
        over = [classes.count(k) - want[k] for k in range(5)]
        s, t = over.index(max(over)), over.index(min(over))
        if not over[s]:
            return classes
        far = lambda i: min((abs(i - j) for j, c in enumerate(classes) if c == t), default=0)
        classes[min((i for i, c in enumerate(classes) if c == s), key=far)] = t


def test_calibration_equals_single_steps(spark):
    rng = random.Random(9)
    rows, quotas, want = [], [], {}
    for g in range(60):
        n = rng.choice([1, 2, 5, 63, 64, 65, 150])
        few = rng.sample([None, -1, 0, 1, 2, 3, 4], rng.randint(1, 5))
        classes = [c for c in (rng.choice(few) for _ in range(n)) for _ in range(rng.choice([1, 1, 4]))][:n]
        cuts = sorted(rng.randint(0, n) for _ in range(4))
        quota = [b - a for a, b in zip([0, *cuts], [*cuts, n])]
        rows += [(f"g{g}", i * 3, c, "x") for i, c in enumerate(classes)]
        quotas.append((f"g{g}", quota))
        want[f"g{g}"] = moved_one_by_one(classes, quota)
    df = spark.createDataFrame(rows, "k string, pos int, cls int, more string").repartition(5)
    out = sequences.calibrate_to_quota(df, spark.createDataFrame(quotas, "k string, quota array<int>"), ["k"], "pos", "cls")
    assert out.columns == df.columns
    got = {}
    for r in out.orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.cls)
    assert got == want


def test_calibration_of_a_large_group(spark):
    n = 50_000
    df = spark.range(n).select(F.lit("g").alias("k"), "id", (F.xxhash64("id") % 5).cast("int").alias("cls"))
    quotas = spark.createDataFrame([("g", [n // 5] * 5)], "k string, quota array<int>")
    out = sequences.calibrate_to_quota(df, quotas, ["k"], "id", "cls")
    assert {r.cls: r["count"] for r in out.groupBy("cls").count().collect()} == {k: n // 5 for k in range(5)}
    with pytest.raises(Exception, match="does not fit its quota"):
        sequences.calibrate_to_quota(df.limit(9), quotas, ["k"], "id", "cls").collect()


def test_outliers_in_long_stretches(spark):
    """Rows that alternate between far values make one stretch of the whole road; it is streamed."""
    rng = random.Random(2)
    n = 3000
    rows = [("a", i, float(rng.choice([0, 1, 4, 5])), rng.choice([0.4, 0.7, 0.9]), 0) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, score double, conf double, mode int")
    score, conf = [r[2] for r in rows], [r[3] for r in rows]
    for i in range(1, n - 1):
        if abs(score[i - 1] - score[i + 1]) <= 1 and abs(score[i] - score[i - 1]) > 1.5:
            score[i] = score[i - 1] if conf[i - 1] >= conf[i + 1] else score[i + 1]
            conf[i] = min(conf[i], 0.6)
    got = sequences.smooth_neighbours(df, ["k"], ["i"]).orderBy("i").collect()
    assert [(r.score, r.conf) for r in got] == list(zip(score, conf))


def test_quota_by_rank(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([None, 4, 1, 4, 2, 0])], "k string, pos int, sug int")
    q = spark.createDataFrame([("g", [2, 1, 1, 1, 1])], "k string, quota array<int>")
    got = [r.assigned for r in sequences.allocate_quota(df, q, ["k"], "sug", "pos").orderBy("pos").collect()]
    assert got == [0, 4, 1, 3, 2, 0]
    assert sequences.quota_mismatches(df, q, ["k"]).count() == 0


def largest_remainder(sizes, n):
    raw = [s / sum(sizes) * n for s in sizes]
    take = [max(1, int(r)) for r in raw]
    while sum(take) > n and max(take) > 1:
        over = [(round(t - r, 9), -i) for i, (t, r) in enumerate(zip(take, raw)) if t > 1]
        take[-max(over)[1]] -= 1
    left = sorted(range(len(sizes)), key=lambda i: (-round(raw[i] - take[i], 9), i))
    for i in left[:max(0, n - sum(take))]:
        take[i] += 1
    return take


def test_proportional_split(spark):
    cases = {"a": ([5.0, 3.0, 2.0], 7), "b": ([100.0, 0.1, 0.1, 0.1], 6), "c": ([1.0, 1.0, 1.0], 10), "d": ([50.0, 40.0, 0.1, 0.2, 0.1, 0.3], 9)}
    rows = [(k, i, s, n) for k, (sizes, n) in cases.items() for i, s in enumerate(sizes)]
    out = intervals.proportional_split(spark.createDataFrame(rows, "k string, seq int, size double, n int"), ["k"])
    got = {}
    for r in out.orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.allotted)
    assert got == {k: largest_remainder(s, n) for k, (s, n) in cases.items()}
    assert all(sum(got[k]) == n for k, (_, n) in cases.items())


def test_union_complement_and_split(spark):
    iv = spark.createDataFrame([("r", 2.0, 5.0, "GEO"), ("r", 4.0, 6.0, "HID"), ("r", 6.0, 7.0, "GEO"), ("r", 9.0, 10.0, "HID"), ("r", 2.5, 3.0, "GEO")], "k string, a double, b double, kind string")
    merged = [tuple(r) for r in intervals.union_intervals(iv, ["k"]).orderBy("a").collect()]
    assert merged == [("r", 2.0, 7.0, "GEO+HID"), ("r", 9.0, 10.0, "HID")]
    lengths = spark.createDataFrame([("r", 12.0), ("empty", 3.0)], "k string, length double")
    free = [tuple(r) for r in intervals.complement_intervals(iv, lengths, ["k"]).orderBy("k", "free0").collect()]
    assert free == [("empty", 0.0, 3.0), ("r", 0.0, 2.0), ("r", 7.0, 9.0), ("r", 10.0, 12.0)]
    cut = intervals.split_evenly(spark.createDataFrame([("r", 0.0, 3.0), ("r", 5.0, 8.0)], "k string, a double, b double"),
                                 spark.createDataFrame([("r", 4)], "k string, n int"), ["k"]).orderBy("unit").collect()
    assert [(r.start, r.stop) for r in cut] == [(0.0, 1.5), (1.5, 3.0), (5.0, 6.5), (6.5, 8.0)]
    cut = intervals.split_evenly(spark.createDataFrame([("r", 0.0, 2.0), ("r", 5.0, 9.0)], "k string, a double, b double"),
                                 spark.createDataFrame([("r", 2)], "k string, n int"), ["k"]).orderBy("unit").collect()
    assert [(r.start, r.stop) for r in cut] == [(0.0, 2.0), (6.0, 9.0)]


def test_generated_units_cover_every_quota(spark):
    from rainrisk.plans.preparation import generate_units

    axes = spark.createDataFrame([("r", 20.0)], "k string, length double")
    critical = spark.createDataFrame([("r", 2.0, 5.0, "GEO"), ("r", 12.0, 14.0, "HID")], "k string, a double, b double, kind string")
    wanted = spark.createDataFrame([("r", 5, 9)], "k string, n_sr int, n_utb int")
    out = generate_units(axes, critical, wanted, ["k"]).collect()
    assert Counter(r.tipo for r in out) == {"SR": 5, "UTB": 9}
    assert all(0 <= r.start < r.stop <= 20 for r in out)
    inside = [r for r in out if r.tipo == "SR"]
    assert all(any(a <= r.start and r.stop <= b for a, b in ((2, 5), (12, 14))) for r in inside)
