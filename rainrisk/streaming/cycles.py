"""The running system: one stream stores landed rain and runs every cycle in order, another polls for new fire products."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import exists
from . import alerts, history, ingest

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MARKER_SCHEMA = "file string, completed boolean, product_date date, run_at timestamp"


def run(spark: SparkSession, source: str, root: str, checkpoint: str, evaluate: Callable[[DataFrame, Column], DataFrame],
        send: Callable[[DataFrame, int], None], once: bool = True, every: str = ingest.RISK_EVERY, whole_every: int = 100) -> StreamingQuery:
    """Store landed rain, then run its cycle: risk, history, alerts and the record, in this order.

    ``evaluate(hours, target)`` returns the risk rows (``hazard, ua_id, rd, source, ac96h_mm`` and more) for the newest stored hour. Folders under ``root``:
    ``hours``, ``risk``, ``history``, ``alerts`` and ``log``. Each step writes under the id of its batch and reads only what earlier batches wrote, so a batch that
    runs again after a failure replaces itself and sends the same alerts. With too few hours the cycle is skipped and recorded as such.
    """
    def cycle(hours: DataFrame, batch_id: int) -> int | None:
        target = F.lit(ingest.newest_hour(spark, f"{root}/hours"))
        if not ingest.valid_hours(hours, target).first()["ready"]:
            return None
        at = f"{root}/risk/batch_id={batch_id}"
        evaluate(hours, target).withColumn("cycle_at", target).write.mode("overwrite").parquet(at)
        points = spark.read.parquet(at)
        _history(points, batch_id).write.mode("overwrite").parquet(f"{root}/history/batch_id={batch_id}")
        alerts.judge(spark, points, f"{root}/alerts", batch_id, send, whole_every)
        return points.count()

    return ingest.ingest(spark, source, f"{root}/hours", checkpoint, history.recorded(spark, f"{root}/log", cycle), once, every)


def _history(points: DataFrame, batch_id: int) -> DataFrame:
    """Risk rows under the names of the unit history; what the evaluation does not give is null."""
    given = {"ts": F.col("cycle_at"), "cycle_id": F.lit(batch_id)} | {
        to: F.col(name) for to, name in (("ac96h", "ac96h_mm"), ("ac24h", "ac24h_mm")) if name in points.columns}
    fields = [f.strip().split() for f in history.HISTORY_SCHEMA.split(",")]
    pick = lambda name: given.get(name, F.col(name) if name in points.columns else F.lit(None))
    return points.select(*[pick(name).cast(kind).alias(name) for name, kind in fields])


def poll_products(spark: SparkSession, landing: str, pattern: str, marker: str, checkpoint: str, produce: Callable[[str, int], None],
                  once: bool = True, every: str = ingest.FIRE_POLL_EVERY) -> StreamingQuery:
    """Run ``produce(file, batch_id)`` for the newest landed file of a poll unless the marker says it is done; a failed run is marked and ends the stream.

    Only names are read. The marker holds one row for each run, under the id of its batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        done = spark.read.schema(MARKER_SCHEMA).json(marker) if exists(spark, marker) else spark.createDataFrame([], MARKER_SCHEMA)
        found = history.needs_run(batch.select(F.element_at(F.split("path", "/"), -1).alias("name")), done, pattern).first()
        if found is None or found["name"] is None or not found["due"]:
            return
        completed = False
        try:
            produce(found["name"], batch_id)
            completed = True
        finally:
            run = (found["name"], completed, found["reference_date"], datetime.now(timezone.utc))
            spark.createDataFrame([run], MARKER_SCHEMA).write.mode("overwrite").json(f"{marker}/run={batch_id}")

    names = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(landing).select("path")
    writer = names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
