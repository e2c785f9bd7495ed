import contextlib
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from rainrisk.operators import rain
from rainrisk.streaming import alerts, cycles, gauges, history, ingest

T0 = datetime(2026, 1, 10, 12)
TARGET = F.lit(str(T0)).cast("timestamp")


def cells(spark, rows):
    return spark.createDataFrame(rows, ingest.CELL_SCHEMA)


def test_hours_are_replaced_by_late_publication(spark, tmp_path):
    src, store, chk = (str(tmp_path / n) for n in ("src", "store", "chk"))
    h1, h2 = T0, T0 - timedelta(hours=1)
    cells(spark, [(0, 0, h1, 1.0, T0), (0, 1, h1, 2.0, T0), (0, 0, h2, 3.0, T0)]).write.mode("append").parquet(src)
    seen = []
    ingest.ingest(spark, src, store, chk, lambda hours, i: seen.append(hours.count())).awaitTermination()
    late = T0 + timedelta(hours=1)
    cells(spark, [(0, 0, h1, 9.0, late), (0, 0, h1, 8.0, T0)]).write.mode("append").parquet(src)
    ingest.ingest(spark, src, store, chk, lambda hours, i: seen.append(hours.count())).awaitTermination()
    got = {(r.hr, r.lat_idx, r.lon_idx): r.mm for r in ingest.read_hours(spark, store).collect()}
    assert got == {(h1, 0, 0): 9.0, (h2, 0, 0): 3.0} and seen == [3, 2]
    # the windows of the store equal the batch windows of the final table
    w = rain.trailing_windows(ingest.read_hours(spark, store), ["lat_idx", "lon_idx"], TARGET).first()
    assert (w.intensity_mmh, w.ac24h_mm) == (9.0, 12.0)


def test_ready_gate(spark):
    hours = spark.createDataFrame([(T0 - timedelta(hours=h),) for h in range(23)], "hr timestamp")
    calls = []
    gate = ingest.when_ready(TARGET, lambda d, i: calls.append("emit"), lambda i: calls.append("none"))
    gate(hours, 0)
    gate(hours.unionByName(spark.createDataFrame([(T0 - timedelta(hours=40),)], "hr timestamp")), 1)
    assert calls == ["none", "emit"]


def test_hours_to_fetch(spark):
    known = [(T0 - timedelta(hours=h), True, T0) for h in range(96) if h != 50]
    got = ingest.hours_to_fetch(spark.createDataFrame(known, "hr timestamp, ok boolean, last_check timestamp"), TARGET, TARGET)
    assert {(T0 - r.hr).total_seconds() / 3600 for r in got.collect()} == {0, 1, 2, 3, 50}


def test_prune(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest.store_hours(cells(spark, [(0, 0, T0, 1.0, T0), (0, 0, T0 - timedelta(days=31), 1.0, T0)]), store)
    assert ingest.prune_hours(spark, store, str(T0), 0) == []
    assert len(ingest.prune_hours(spark, store, str(T0), 30)) == 1 and ingest.read_hours(spark, store).count() == 1


def test_watermarked_hour_totals_equal_batch(spark, tmp_path):
    src = str(tmp_path / "r")
    rows = [(f"s{i % 3}", T0 - timedelta(minutes=11 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp, value double")
    df.write.parquet(src)
    q = (ingest.hourly_totals_stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("totals")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.station_id, r.hr): (r.mm, r.qtd) for r in spark.table("totals").collect()}
    want = {(r.station_id, r.hr): (r.mm, r.qtd) for r in rain.hourly_totals(df, ["station_id"]).collect()}
    assert got == want


def test_gauge_refresh_plan():
    hour = timedelta(hours=1)
    span = lambda **k: gauges.refresh_span(**(dict(mesh_changed=False, last_target=T0 - hour, target=T0, last_full=T0 - hour, now=T0, stations_loaded=5) | k))
    assert span() == 6
    assert [span(mesh_changed=True), span(last_target=None), span(last_full=T0 - 6 * hour), span(target=T0 - 2 * hour), span(last_target=T0 - 7 * hour), span(stations_loaded=0)] == [96] * 6


def test_gauge_store_versions(spark, tmp_path):
    src, store, chk = (str(tmp_path / n) for n in ("src", "store", "chk"))
    df = lambda rows: spark.createDataFrame(rows, gauges.READING_SCHEMA)
    df([("a", T0 - timedelta(hours=h), 1.0, 1) for h in (0, 5, 6, 95, 96)]).coalesce(1).write.mode("append").parquet(src)
    gauges.run(spark, src, store, chk).awaitTermination()
    first = gauges.read(spark, store, 0)
    assert sorted((T0 - r.hr).total_seconds() / 3600 for r in first.collect()) == [0, 5, 6, 95]
    # one hour on, the hour before is reported again and the oldest hour falls out
    df([("a", T0 + timedelta(hours=1), 7.0, 2), ("a", T0, 2.0, 1), ("a", T0, 3.0, 2)]).coalesce(1).write.mode("append").parquet(src)
    gauges.run(spark, src, store, chk).awaitTermination()
    got = {(T0 - r.hr).total_seconds() / 3600: r.mm for r in gauges.read(spark, store, 1).collect()}
    assert got == {-1: 7.0, 0: 3.0, 5: 1.0, 6: 1.0}


def test_gauge_batches_add_up(spark, tmp_path):
    src, store, chk = (str(tmp_path / n) for n in ("src", "store", "chk"))
    for station, seq in (("a", 2), ("b", 1), ("a", 1)):
        rows = [(station, T0 - timedelta(hours=h), float(seq), seq) for h in range(10)]
        spark.createDataFrame(rows, gauges.READING_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        gauges.run(spark, src, store, chk).awaitTermination()
    got = gauges.read(spark, store, 2).collect()
    # two stations in two batches are both there, and an older reading that lands late does not win
    assert len(got) == 20 and {(r.station_id, r.mm) for r in got} == {("a", 2.0), ("b", 1.0)}


def test_publication_in_two_batches_and_late_older_one(spark, tmp_path):
    store = str(tmp_path / "s")
    ingest.store_hours(cells(spark, [(0, i, T0, 1.0, T0) for i in range(3)]), store)
    ingest.store_hours(cells(spark, [(1, i, T0, 2.0, T0) for i in range(3)]), store)
    assert ingest.read_hours(spark, store).count() == 6
    ingest.store_hours(cells(spark, [(0, 0, T0, 9.0, T0 - timedelta(hours=1)), (0, 0, T0 - timedelta(hours=1), 5.0, T0)]), store)
    got = {(r.hr, r.lat_idx, r.lon_idx): r.mm for r in ingest.read_hours(spark, store).collect()}
    assert len(got) == 7 and got[(T0, 0, 0)] == 1.0 and got[(T0 - timedelta(hours=1), 0, 0)] == 5.0


def test_store_is_a_pruned_rain_grid(spark, tmp_path):
    from rainrisk.sources.tables import rain_grid

    store = str(tmp_path / "s")
    ingest.store_hours(cells(spark, [(0, 0, T0 - timedelta(hours=h), 1.0, T0) for h in (0, 95, 96, 500)]), store)
    grid = rain_grid(spark, store, TARGET)
    assert grid.count() == 2 and ingest.read_hours(spark, store, TARGET).count() == 2
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def risk_rows(spark, rows):
    return spark.createDataFrame(rows, "cycle_at timestamp, hazard string, ua_id string, rd int, source string, ac96h_mm double")


def test_alert_state_machine(spark):
    state = spark.createDataFrame([], alerts.STATE_SCHEMA)
    log = []
    steps = [(0, 3, "OK"), (1, 3, "OK"), (2, 4, "OK"), (7, 4, "OK"), (8, 4, "OK"), (9, 2, "OK"), (10, 3, "OK"), (11, 3, "NO_DATA"), (12, 3, "OK")]
    for hour, rd, source in steps:
        at = T0 + timedelta(hours=hour)
        rows = risk_rows(spark, [(at, "geo", "u", rd, source, 1.0)])
        out, state = alerts.step(rows, state, F.lit(str(at)).cast("timestamp"))
        log.append([r.reason for r in out.collect()])
        state = spark.createDataFrame(state.collect(), alerts.STATE_SCHEMA)
    assert log == [["new"], [], ["escalated"], [], ["reminder"], [], ["new"], [], ["new"]]


def test_alert_channel_keeps_the_other_state(spark):
    state = spark.createDataFrame([("hidro", "u", 3, T0), ("geo", "gone", 3, T0)], alerts.STATE_SCHEMA)
    rows = risk_rows(spark, [(T0, "geo", "u", 4, "OK", 1.0), (T0, "hidro", "u", 4, "OK", 1.0)])
    out, nxt = alerts.step(rows, state, TARGET, channel="geo")
    assert [r.hazard for r in out.collect()] == ["geo"]
    assert {(r.hazard, r.ua_id) for r in nxt.collect()} == {("hidro", "u"), ("geo", "u")}


def test_alert_stream_equals_steps(spark, tmp_path):
    src, root, chk = (str(tmp_path / n) for n in ("src", "root", "chk"))
    hours = [(0, 3), (1, 3), (2, 4), (9, 4)]
    for h, rd in hours[:2]:
        risk_rows(spark, [(T0 + timedelta(hours=h), "geo", "u", rd, "OK", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    sent = []
    stream = lambda: spark.readStream.schema("cycle_at timestamp, hazard string, ua_id string, rd int, source string, ac96h_mm double").parquet(src)
    send = lambda a, i: sent.extend(r.reason for r in a.collect())
    alerts.run(spark, stream(), root, chk, send).awaitTermination()
    for h, rd in hours[2:]:
        risk_rows(spark, [(T0 + timedelta(hours=h), "geo", "u", rd, "OK", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    alerts.run(spark, stream(), root, chk, send).awaitTermination()
    assert sent == ["new", "escalated", "reminder"]


def test_backlog_in_one_pass_equals_steps(spark, tmp_path):
    """Many cycles in one batch, then more in further batches: the same alerts and state as one step after the other."""
    import random

    rnd = random.Random(3)
    rows = [(T0 + timedelta(hours=h), z, f"u{u}", rnd.choice([2, 3, 3, 4, 4, None]), rnd.choice(["OK", "OK", "OK", "NO_DATA"]), float(h))
            for h in range(60) for z in ("geo", "hidro") for u in range(6) if rnd.random() < 0.9]
    want, state = [], {}
    for h in range(60):
        at = T0 + timedelta(hours=h)
        live = {(z, u): rd for t, z, u, rd, s, _ in rows if t == at and rd and rd >= 3 and s != "NO_DATA"}
        for key, rd in live.items():
            old = state.get(key)
            why = "new" if old is None else "escalated" if rd > old[0] else "reminder" if at - old[1] >= timedelta(hours=6) else None
            if why:
                want.append((*key, h, rd, why))
                state[key] = (rd, at)
        state = {k: v for k, v in state.items() if k in live}
    src, root, chk, sent = *(str(tmp_path / n) for n in ("src", "root", "chk")), []
    stream = lambda: spark.readStream.schema("cycle_at timestamp, hazard string, ua_id string, rd int, source string, ac96h_mm double").parquet(src)
    send = lambda a, i: sent.extend((r.hazard, r.ua_id, int(r.ac96h_mm), r.rd, r.reason) for r in a.collect())
    for lo, hi in ((0, 40), (40, 41), (41, 55), (55, 60)):
        risk_rows(spark, [r for r in rows if T0 + timedelta(hours=lo) <= r[0] < T0 + timedelta(hours=hi)]).coalesce(1).write.mode("append").parquet(src)
        alerts.run(spark, stream(), root, chk, send, whole_every=3).awaitTermination()
    assert sorted(sent) == sorted(want) and {w[4] for w in want} == {"new", "escalated", "reminder"}
    assert {(r.hazard, r.ua_id): (r.level, r.sent_at) for r in alerts.read_state(spark, root, 99).collect()} == state
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == ["version=2", "version=3"]
    again = alerts.read_state(spark, root, 3)
    assert again.count() <= 12


def test_channel_in_one_pass_keeps_the_other_state(spark):
    state = spark.createDataFrame([("hidro", "u", 3, T0), ("geo", "gone", 3, T0)], alerts.STATE_SCHEMA)
    rows = risk_rows(spark, [(T0, "geo", "u", 4, "OK", 1.0), (T0, "hidro", "u", 4, "OK", 1.0)])
    out, changes = alerts.steps(rows, state, channel="geo")
    assert [(r.hazard, r.reason) for r in out.collect()] == [("geo", "new")]
    assert {(r.hazard, r.ua_id, r.cleared) for r in changes.collect()} == {("geo", "u", False), ("geo", "gone", True)}


def test_history_and_compaction(spark, tmp_path):
    src, store, chk, out = (str(tmp_path / n) for n in ("src", "store", "chk", "out"))
    rows = [("u", "geo", T0 + timedelta(minutes=10 * i), i, i % 5, 0, 0, 0.0, 0.0, 0.0) for i in range(40)]
    spark.createDataFrame(rows, history.HISTORY_SCHEMA).write.parquet(src)
    history.append_history(spark, spark.readStream.schema(history.HISTORY_SCHEMA).parquet(src), store, chk).awaitTermination()
    history.compact_history(spark, store, out)
    assert sorted(r.cycle_id for r in spark.read.parquet(out).collect()) == list(range(16, 40))


def test_cycle_records(spark, tmp_path):
    log, calls = str(tmp_path / "log"), []
    def work(batch, i):
        if i == 1:
            raise RuntimeError("feed down")
        return None if i == 2 else batch.count()
    body = history.recorded(spark, log, work, lambda i: calls.append(i))
    for i in range(3):
        with pytest.raises(RuntimeError) if i == 1 else contextlib.nullcontext():
            body(spark.range(4), i)
    got = {r.batch_id: (r.outcome, r.rows, r.error) for r in spark.read.schema(history.RECORD_SCHEMA).json(log).collect()}
    assert got == {0: ("ok", 4, None), 1: ("error", None, "feed down"), 2: ("skipped", None, None)} and calls == [1]


def test_telemetry_ring(spark):
    rec = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("started_at"), F.col("id").alias("batch_id"))
    assert history.compact_telemetry(rec, keep=90).count() == 100
    assert history.compact_telemetry(rec, keep=50).agg(F.min("batch_id")).first()[0] == 50


def test_product_runs_once(spark):
    files = spark.createDataFrame([("observed_20260105.nc",), ("observed_20260110.nc",)], "name string")
    mark = lambda rows: spark.createDataFrame(rows, "file string, completed boolean, product_date date, run_at timestamp")
    due = lambda rows: history.needs_run(files, mark(rows), r"^observed_").first().due
    day = T0.date()
    assert due([]) is True
    assert due([("observed_20260110.nc", True, day, T0)]) is False
    assert due([("observed_20260110.nc", False, day, T0)]) is True
    assert due([("observed_20260110.nc", True, day - timedelta(days=1), T0)]) is True
    assert due([("observed_20260105.nc", True, day, T0)]) is True


def test_last_good_is_kept(spark, tmp_path):
    out = str(tmp_path / "cams")
    assert history.keep_last_good(spark.range(3), out)
    assert not history.keep_last_good(spark.range(0), out)
    assert spark.read.parquet(out).count() == 3


def test_gauge_log_follows_the_batch(spark, tmp_path):
    """A version holds its batch only, a whole one all hours; old versions go and the readings stay the same."""
    import random

    src, store, chk = (str(tmp_path / n) for n in ("src", "store", "chk"))
    rnd, log = random.Random(5), []
    for batch in range(5):
        size = 1 if batch == 1 else 150
        log.append([(f"s{rnd.randrange(8)}", T0 + timedelta(hours=rnd.randrange(40) + 20 * batch), float(rnd.randrange(9)), batch * 1000 + i) for i in range(size)])
        spark.createDataFrame(log[-1], gauges.READING_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        gauges.run(spark, src, store, chk, whole_every=4).awaitTermination()
        if batch == 1:
            assert spark.read.parquet(f"{store}/version=1").count() == 1
        best = {}
        for station, hr, mm, seq in (r for rows in log for r in rows):
            best[station, hr] = max(best.get((station, hr), (0, 0)), (seq, mm))
        newest = max(hr for _, hr in best)
        want = {k: v[1] for k, v in best.items() if newest - k[1] < timedelta(hours=96)}
        assert {(r.station_id, r.hr): r.mm for r in gauges.read(spark, store, batch).collect()} == want
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["version=3", "version=4"]


def test_gauge_refresh_reads_what_it_needs(spark, tmp_path):
    store, marks, asked = str(tmp_path / "store"), str(tmp_path / "marks"), []

    def fetch(hours):
        asked.append(hours)
        return spark.createDataFrame([("a", T0, 1.0, len(asked))], gauges.READING_SCHEMA)

    hour = timedelta(hours=1)
    for version, (after, mesh) in enumerate([(0, "m"), (1, "m"), (2, "m"), (3, "n"), (4, "n"), (9, "n")]):
        gauges.refresh(spark, store, marks, fetch, T0 + after * hour, T0 + after * hour, mesh, version)
    assert asked == [96, 6, 6, 96, 6, 96]


def test_cycles_equal_the_batch_twin(spark, tmp_path):
    """Three cycles and one without enough hours: risk, history and alerts of the stream are those of one step after the other."""
    src, root, chk = (str(tmp_path / n) for n in ("src", "root", "chk"))
    hour = timedelta(hours=1)

    def evaluate(hours, target):
        w = rain.trailing_windows(hours, ["lat_idx", "lon_idx"], target)
        return w.select(F.lit("geo").alias("hazard"), F.format_string("u%d", "lon_idx").alias("ua_id"), F.least(F.lit(4), F.floor(F.col("intensity_mmh"))).cast("int").alias("rd"),
                        F.lit("SATELLITE").alias("source"), "ac96h_mm", "ac24h_mm")

    grid = lambda h, mm, published: [(0, i, T0 + h * hour, float(mm[i]), T0 + published * hour) for i in range(3)]
    landed = [grid(0, (4, 4, 4), 0), [r for h in range(-30, 1) for r in grid(h, (3, 1, 2) if h == 0 else (0, 0, 0), 1)],
              grid(1, (4, 3, 0), 2), grid(0, (0, 0, 0), 3) + grid(2, (4, 4, 4), 3)]
    sent, want, state, seen = [], [], spark.createDataFrame([], alerts.STATE_SCHEMA), []
    key = lambda r: (r.cycle_at, r.ua_id, r.rd, r.reason, r.ac96h_mm)
    for batch, rows in enumerate(landed):
        cells(spark, rows).coalesce(1).write.mode("append").parquet(src)
        cycles.run(spark, src, root, chk, evaluate, lambda a, i: sent.extend(map(key, a.collect())), whole_every=2).awaitTermination()
        seen += rows
        if batch:
            target = F.lit(max(r[2] for r in seen))
            points = evaluate(ingest.newest_publication(cells(spark, seen)), target).withColumn("cycle_at", target)
            out, after = alerts.step(points, state, target)
            want += map(key, out.collect())
            state = spark.createDataFrame(after.collect(), alerts.STATE_SCHEMA)
    assert sorted(sent) == sorted(want) and {w[3] for w in want} == {"new", "escalated"}
    told = {(r.cycle_id, r.ua_id): (r.ts, r.rd, r.rd_geo) for r in spark.read.schema(history.HISTORY_SCHEMA).parquet(f"{root}/history").collect()}
    assert len(told) == 9 and told[3, "u1"] == (T0 + 2 * hour, 4, None)
    outcome = {r.batch_id: r.outcome for r in spark.read.schema(history.RECORD_SCHEMA).json(f"{root}/log").collect()}
    assert outcome == {0: "skipped", 1: "ok", 2: "ok", 3: "ok"}
    # the last batch once more, as after a failure: the same alerts, the same state
    before = list(sent)
    points = spark.read.parquet(f"{root}/risk/batch_id=3")
    alerts.judge(spark, points, f"{root}/alerts", 3, lambda a, i: sent.extend(map(key, a.collect())), 2)
    assert sorted(sent[len(before):]) == sorted(k for k in before if k[0] == T0 + 2 * hour)


def test_product_poll(spark, tmp_path):
    landing, marker, chk, made = tmp_path / "landing", str(tmp_path / "marker"), str(tmp_path / "chk"), []
    landing.mkdir()

    def poll():
        cycles.poll_products(spark, str(landing), r"^observed_", marker, chk, lambda name, i: made.append(name)).awaitTermination()

    for names in (["observed_20260105.nc", "observed_20260110.nc"], ["other.txt"], ["observed_20260111.nc"]):
        for n in names:
            (landing / n).write_bytes(b"x")
        poll()
    assert made == ["observed_20260110.nc", "observed_20260111.nc"]
