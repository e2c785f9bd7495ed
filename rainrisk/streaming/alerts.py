"""Alert state per (channel, unit): new, escalated or due again; below the threshold it clears.

``step`` judges one cycle. ``steps`` judges any number of cycles in one pass: the cycles get numbers, the rows of a unit are
folded in their order, and a unit that misses a cycle has cleared. The stored state is a log of the units that a batch changed,
with the whole state from time to time, so what a batch writes follows its changes and not the units in alert.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import ALERTS
from ..sources.tables import exists

KEYS = ["hazard", "ua_id"]
STATE_SCHEMA = "hazard string, ua_id string, level int, sent_at timestamp"


def step(points: DataFrame, state: DataFrame, now: Column, threshold: int = ALERTS["threshold"],
         cooldown_h: int = ALERTS["cooldown_h"], channel: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to send with ``reason``, next state). Rows without data are skipped, which clears them too.

    With ``channel`` only that channel is judged and cleared; others keep their state.
    """
    judged = points.where(F.col("rd").isNotNull() & (F.coalesce("source", F.lit("")) != "NO_DATA") & (F.col("rd") >= threshold))
    if channel:
        judged = judged.where(F.col("hazard") == channel)
    both = judged.join(state, KEYS, "left")
    due = F.unix_timestamp(now) - F.unix_timestamp("sent_at") >= cooldown_h * 3600
    reason = F.when(F.col("level").isNull(), F.lit("new")).when(F.col("rd") > F.col("level"), F.lit("escalated")).when(due, F.lit("reminder"))
    both = both.withColumn("reason", reason)
    nxt = both.select(*KEYS, F.when(F.col("reason").isNotNull(), F.col("rd")).otherwise(F.col("level")).cast("int").alias("level"),
                      F.when(F.col("reason").isNotNull(), now).otherwise(F.col("sent_at")).alias("sent_at"))
    if channel:
        nxt = nxt.unionByName(state.where(F.col("hazard") != channel))
    return both.where(F.col("reason").isNotNull()).drop("level", "sent_at"), nxt


def ordered(alerts: DataFrame) -> DataFrame:
    """Worst first."""
    return alerts.orderBy(F.col("rd").desc(), F.coalesce("ac96h_mm", F.lit(0.0)).desc(), "ua_id", "hazard")


def steps(points: DataFrame, state: DataFrame, threshold: int = ALERTS["threshold"], cooldown_h: int = ALERTS["cooldown_h"],
          channel: str | None = None, at: str = "cycle_at") -> tuple[DataFrame, DataFrame]:
    """(rows to send with ``reason``, changed units with ``cleared``) after all cycles of ``points``; the same as one ``step`` after the other.

    A unit's array holds one entry for each of its cycles in ``points``. Several rows of a unit in one cycle count as its worst one.
    """
    judged = points.where(F.col("rd").isNotNull() & (F.coalesce("source", F.lit("")) != "NO_DATA") & (F.col("rd") >= threshold))
    if channel:
        judged = judged.where(F.col("hazard") == channel)
    # one row for each cycle time
    cycles = points.select(at).distinct().withColumn("_o", F.row_number().over(Window.orderBy(at)))
    last = cycles.agg(F.max("_o")).scalar()
    worst = judged.groupBy(*KEYS, at).agg(F.max("rd").cast("int").alias("rd")).join(cycles, at)
    seen = worst.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(at).alias("at"), "rd"))).alias("_seen"))
    both = seen.join(state, KEYS, "full")

    def judge(acc: Column, x: Column) -> Column:
        alive = acc["level"].isNotNull() & (x["_o"] == acc["o"] + 1)
        due = F.unix_timestamp(x["at"]) - F.unix_timestamp(acc["sent"]) >= cooldown_h * 3600
        reason = F.when(~alive, F.lit("new")).when(x["rd"] > acc["level"], F.lit("escalated")).when(due, F.lit("reminder"))
        fire = reason.isNotNull()
        return F.struct(x["_o"].alias("o"), F.when(fire, x["rd"]).otherwise(acc["level"]).alias("level"), F.when(fire, x["at"]).otherwise(acc["sent"]).alias("sent"),
                        F.when(fire, F.concat(acc["log"], F.array(F.struct(x["at"].alias("at"), x["rd"].alias("rd"), reason.alias("reason"))))).otherwise(acc["log"]).alias("log"))

    start = F.struct(F.lit(0).alias("o"), F.col("level"), F.col("sent_at").alias("sent"), F.expr("CAST(array() AS array<struct<at: timestamp, rd: int, reason: string>>)").alias("log"))
    seen_or_none = F.coalesce("_seen", F.expr("CAST(array() AS array<struct<_o: int, at: timestamp, rd: int>>)"))
    folded = both.withColumn("_end", F.aggregate(seen_or_none, start, judge))
    sent = folded.select(*KEYS, F.explode("_end.log").alias("_l")).select(*KEYS, F.col("_l.at").alias(at), F.col("_l.rd").alias("rd"), F.col("_l.reason").alias("reason"))
    alerts = judged.join(sent, [*KEYS, at, "rd"]).dropDuplicates([*KEYS, at])
    cleared = F.col("_end.o") < last
    if channel:
        cleared = cleared & (F.col("hazard") == channel)
    changed = cleared | ~F.col("_end.level").eqNullSafe(F.col("level")) | ~F.col("_end.sent").eqNullSafe(F.col("sent_at"))
    return alerts, folded.where(changed).select(*KEYS, F.col("_end.level").alias("level"), F.col("_end.sent").alias("sent_at"), cleared.alias("cleared"))


LOG_SCHEMA = STATE_SCHEMA + ", cleared boolean, whole boolean, version bigint"


def read_state(spark: SparkSession, root: str, before: int) -> DataFrame:
    """State after all versions below ``before``: the newest entry of each unit since the last whole state."""
    if not exists(spark, root):
        return spark.createDataFrame([], STATE_SCHEMA)
    log = spark.read.schema(LOG_SCHEMA).parquet(root).where(F.col("version") < before)
    base = log.where("whole").agg(F.max("version").alias("v")).first()["v"]
    if base is not None:
        log = log.where(F.col("version") >= base)
    newest = log.where("hazard IS NOT NULL").groupBy(*KEYS).agg(F.max_by(F.struct("level", "sent_at", "cleared"), "version").alias("_s"))
    return newest.where("NOT _s.cleared").select(*KEYS, "_s.level", "_s.sent_at")


def judge(spark: SparkSession, batch: DataFrame, root: str, batch_id: int, send: Callable[[DataFrame, int], None], whole_every: int = 100) -> None:
    """Judge the cycles of one batch and write the units it changed as version ``batch_id``, every ``whole_every``-th time the whole state.

    Versions that a whole state replaces go with the next batch: by then the whole state is committed and is not computed again. The same batch id starts from
    the versions before it, so it gives the same alerts again.
    """
    if batch_id and batch_id % whole_every == 0:
        remove_versions(spark, root, batch_id - 1)
    state = read_state(spark, root, batch_id)
    alerts, changes = steps(batch, state)
    send(alerts, batch_id)
    whole = batch_id % whole_every == whole_every - 1
    if whole:
        kept = state.join(changes, KEYS, "left_anti").withColumn("cleared", F.lit(False)).unionByName(changes.where("NOT cleared"))
        # a row without a unit marks the version as whole even if no unit is in alert
        mark = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in kept.dtypes])
        changes = kept.unionByName(mark)
    changes.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{root}/version={batch_id}")


def run(spark: SparkSession, cycles: DataFrame, root: str, checkpoint: str, send: Callable[[DataFrame, int], None], whole_every: int = 100):
    """Judge a stream of risk rows that carry their ``cycle_at``; a micro-batch may hold any number of cycles."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        judge(spark, batch, root, batch_id, send, whole_every)
        batch.unpersist()

    return (cycles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def remove_versions(spark: SparkSession, root: str, before: int) -> None:
    """Delete the versions of a log below ``before``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.partition("=")[2]) < before:
            fs.delete(status.getPath(), True)


def active_alerts(history: DataFrame, threshold: int = ALERTS["threshold"], ts: str = "ts", tie: str = "cycle_id") -> DataFrame:
    """Batch view of who is in alert: units whose newest cycle is at or above the threshold."""
    last = history.groupBy(*KEYS).agg(F.max_by(F.struct("rd", ts), F.struct(ts, tie)).alias("_l"))
    return last.select(*KEYS, F.col("_l.rd").alias("rd"), F.col(f"_l.{ts}").alias("since_ts")).where(F.col("rd") >= threshold)
