"""Continuous rain ingest: hours are upserted, late republications replace them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..constants import READY_HOURS, REFETCH
from ..functions import rain
from ..operators.rain import window_hours
from ..operators.scale import checkpointed
from ..sources.tables import exists

# --- fixed values: trigger periods ------------------------------------------
INGEST_EVERY = "120 seconds"
RISK_EVERY = "10 minutes"
FIRE_POLL_EVERY = "30 minutes"

CELL_SCHEMA = "lat_idx int, lon_idx int, hr timestamp, mm double, published timestamp"
HOUR_KEY = "hour_key"
#: Folders of the store: readers of days prune the first level.
PARTITION = ["day", HOUR_KEY]


def newest_publication(cells: DataFrame) -> DataFrame:
    """Per hour, the cells of its newest publication; per cell one value."""
    newest = cells.groupBy("hr").agg(F.max("published").alias("published"))
    kept = cells.join(newest, ["hr", "published"], "left_semi")
    return kept.groupBy("hr", "lat_idx", "lon_idx").agg(F.max_by("mm", "published").alias("mm"), F.max("published").alias("published"))


def store_hours(cells: DataFrame, store: str) -> None:
    """Merge a batch into the hours it touches; other hours stay.

    Per hour the newest publication wins, wherever its cells come from: a publication that lands in several batches
    adds up, an older one that lands late changes nothing. A replayed batch gives the same hours again.
    """
    spark = cells.sparkSession
    batch = checkpointed(cells.select(*[f.name for f in T.StructType.fromDDL(CELL_SCHEMA)]).withColumns(_partition()))
    if exists(spark, store):
        touched = batch.select(*PARTITION).distinct()
        # small batches prune the folders at run time; a long backfill joins by the hour
        stored = read_hours(spark, store).join(touched, PARTITION, "left_semi")
        batch = batch.unionByName(stored)
    # the merged hours must be complete before their folders are replaced
    merged = checkpointed(newest_publication(batch).withColumns(_partition()))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(store)


def _partition() -> dict[str, Column]:
    return {"day": F.to_date("hr"), HOUR_KEY: F.date_format("hr", "yyyyMMddHH")}


def read_hours(spark: SparkSession, store: str, target: Column | None = None) -> DataFrame:
    """Stored cells; with a target the 96 hours up to it, for which only the folders of their days are read."""
    hours = spark.read.schema(f"{CELL_SCHEMA}, day date, {HOUR_KEY} string").parquet(store)
    if target is None:
        return hours
    first = F.to_date(target - F.expr("INTERVAL 95 HOURS"))
    return window_hours(hours.where((F.col("day") >= first) & (F.col("day") <= F.to_date(target))), target)


def valid_hours(hourly: DataFrame, target: Column) -> DataFrame:
    """One row: readable hours among the 96 up to the target and whether output may start."""
    n = window_hours(hourly, target).select("hr").distinct().agg(F.count(F.lit(1)).alias("hours"))
    return n.withColumn("ready", F.col("hours") >= READY_HOURS)


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None,
           once: bool = True, every: str = INGEST_EVERY) -> StreamingQuery:
    """Stream landed cell files into the hour store; ``on_batch`` gets the 96 hours up to the newest stored one after each stored batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store_hours(batch, store)
        newest = newest_hour(spark, store)
        if on_batch and newest:
            on_batch(read_hours(spark, store, F.lit(newest)), batch_id)

    writer = (spark.readStream.schema(CELL_SCHEMA).parquet(source)
              .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def when_ready(target: Column, emit: Callable[[DataFrame, int], None], no_data: Callable[[int], None] | None = None):
    """Batch hook that emits once enough hours are there, else reports no data."""
    def hook(hourly: DataFrame, batch_id: int) -> None:
        if valid_hours(hourly, target).first()["ready"]:
            emit(hourly, batch_id)
        elif no_data:
            no_data(batch_id)

    return hook


def hours_to_fetch(known: DataFrame, target: Column, now: Column) -> DataFrame:
    """Hours of the last 96 to read again by age, absent ones included.

    ``known`` has ``hr, ok, last_check``. The spine is 96 rows.
    """
    spine = known.sparkSession.range(96).select((target - F.make_interval(hours=F.col("id").cast("int"))).alias("hr"))
    plan = spine.join(known, "hr", "left").withColumn("fetch", rain.needs_refetch(
        F.col("hr"), now, F.col("last_check"), F.col("ok"), REFETCH["fresh_h"], REFETCH["stale_h"], REFETCH["recheck_h"]))
    return plan.where("fetch").select("hr")


def hourly_totals_stream(readings: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Hourly sum per station from a stream of raw readings; an hour is final after the delay."""
    return (readings.withWatermark("ts", delay).groupBy("station_id", F.window("ts", "1 hour").alias("w"))
            .agg(F.sum(rain.ticks(F.col("value"))).alias("_t"), F.count(F.lit(1)).alias("qtd"))
            .select("station_id", F.col("w.start").alias("hr"), (F.col("_t") / F.lit(float(rain.TICKS_PER_MM))).alias("mm"), "qtd"))


def newest_hour(spark: SparkSession, store: str) -> datetime | None:
    """Newest stored hour by folder names; None for a store without hours."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    under = lambda path, prefix: sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix)), key=lambda p: p.getName())
    for day in reversed(under(root, "day=2")):
        if hours := under(day, f"{HOUR_KEY}="):
            return datetime.strptime(hours[-1].getName().split("=")[1], "%Y%m%d%H")
    return None


def prune_hours(spark: SparkSession, store: str, now: str, days: int = REFETCH["ttl_days"]) -> list[str]:
    """Drop hour partitions older than ``days`` (0 keeps all); only folder names are listed."""
    if days == 0:
        return []
    limit = spark.sql(f"SELECT date_format(TIMESTAMP '{now}' - INTERVAL {int(days)} DAYS, 'yyyyMMddHH') AS k").first()["k"]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = []
    for folder in fs.listStatus(root):
        day = folder.getPath().getName().removeprefix("day=").replace("-", "")
        if not day.isdigit() or day > limit[:8]:
            continue
        for status in fs.listStatus(folder.getPath()):
            name = status.getPath().getName()
            if name.startswith(f"{HOUR_KEY}=") and name.split("=")[1] < limit:
                fs.delete(status.getPath(), True)
                old.append(name)
    return sorted(old)
