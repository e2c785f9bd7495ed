"""Gauge store: a log of read versions that merges by (station, hour), bounded to the last 96 hours."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import PRIMARY
from ..operators.rain import window_hours
from ..sources.tables import exists
from .alerts import remove_versions

READING_SCHEMA = "station_id string, hr timestamp, mm double, seq bigint"
MARK_SCHEMA = "version bigint, target timestamp, full_at timestamp, mesh string"


def refresh_span(mesh_changed: bool, last_target: datetime | None, target: datetime, last_full: datetime | None,
                 now: datetime, stations_loaded: int) -> int:
    """Hours to read: all 96 after a change, every 6 h, on a jump of the target or without stations; else 6."""
    jumped = last_target is None or target < last_target or target - last_target > timedelta(hours=PRIMARY["recent_h"])
    stale = last_full is None or now - last_full >= timedelta(hours=PRIMARY["full_h"])
    return PRIMARY["window_h"] if mesh_changed or jumped or stale or not stations_loaded else PRIMARY["recent_h"]


def append(spark: SparkSession, store: str, readings: DataFrame, version: int, whole_every: int = 100) -> None:
    """Write readings as one version of the log: what a version holds follows the batch, every ``whole_every``-th one holds the whole 96 hours.

    Versions that a whole one replaces go when the next one is written. The same version number gives the same version again.
    """
    if version and version % whole_every == 0 and exists(spark, store):
        remove_versions(spark, store, version - 1)
    whole = version % whole_every == whole_every - 1
    own = readings.select(*_columns()).withColumn("version", F.lit(version).cast("long"))
    if whole:
        own = _log(spark, store, version - 1).unionByName(own)
        own = window_hours(own, own.agg(F.max("hr").alias("hr")).scalar())
    _newest(own).withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{store}/version={version}")


def run(spark: SparkSession, source: str, store: str, checkpoint: str, whole_every: int = 100):
    """Stream landed readings into the log, one version per micro-batch; a replayed batch rewrites its own version."""
    return (spark.readStream.schema(READING_SCHEMA).parquet(source).writeStream
            .foreachBatch(lambda batch, batch_id: append(spark, store, batch, batch_id, whole_every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Readings after a version: one per station and hour, for the 96 hours up to the newest hour of the log."""
    log = _log(spark, store, version)
    return _newest(window_hours(log, log.agg(F.max("hr").alias("hr")).scalar()))


def refresh(spark: SparkSession, store: str, marks: str, fetch: Callable[[int], DataFrame], target: datetime, now: datetime, mesh: str, version: int) -> int:
    """Read the gauges once: ``fetch(hours)`` gives the readings of the last hours, as many as ``refresh_span`` asks for; returns that number.

    ``marks`` keeps one row for each version: its target, the time of the last full read and the mesh it was read for.
    """
    last = None
    if exists(spark, marks):
        seen = spark.read.schema(MARK_SCHEMA).json(marks).where(F.col("version") < version)
        last = seen.agg(F.max_by(F.struct("target", "full_at", "mesh"), "version").alias("m")).first()["m"]
    loaded = 0 if read(spark, store, version - 1).isEmpty() else 1
    span = refresh_span(last is None or last["mesh"] != mesh, last and last["target"], target, last and last["full_at"], now, loaded)
    append(spark, store, fetch(span), version)
    mark = (version, target, now if span == PRIMARY["window_h"] else last["full_at"], mesh)
    spark.createDataFrame([mark], MARK_SCHEMA).write.mode("overwrite").json(f"{marks}/read={version}")
    return span


def _columns() -> list[str]:
    return [c.split()[0] for c in READING_SCHEMA.split(", ")]


def _log(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Readings of all versions up to one, from the last whole version on."""
    if version < 0 or not exists(spark, store):
        return spark.createDataFrame([], f"{READING_SCHEMA}, version bigint")
    log = spark.read.schema(f"{READING_SCHEMA}, whole boolean, version bigint").parquet(store).where(F.col("version") <= version)
    base = log.where("whole").agg(F.max("version").alias("v")).first()["v"]
    return (log if base is None else log.where(F.col("version") >= base)).drop("whole")


def _newest(readings: DataFrame) -> DataFrame:
    """One reading per station and hour: the highest ``seq``, of equal ones the later version, then the larger value."""
    best = F.max_by(F.struct("mm", "seq"), F.struct("seq", "version", "mm")).alias("_r")
    return readings.groupBy("station_id", "hr").agg(best).select("station_id", "hr", "_r.mm", "_r.seq")
