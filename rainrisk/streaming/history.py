"""Cycle records, unit history and exactly-once product runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import HISTORY_CYCLES, TELEMETRY_KEEP
from ..operators.analytics import last_trail
from ..operators.scale import with_row

HISTORY_SCHEMA = "ua_id string, hazard string, ts timestamp, cycle_id bigint, rd int, rd_geo int, rd_hid int, ac96h double, ac24h double, cpc double"
RECORD_SCHEMA = "started_at timestamp, duration_s double, outcome string, error string, rows bigint, batch_id bigint"


def append_history(spark: SparkSession, cycles: DataFrame, store: str, checkpoint: str):
    """Append risk rows, one folder per micro-batch so that a replay replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return (cycles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compact_history(spark: SparkSession, store: str, target: str, keep: int = HISTORY_CYCLES) -> None:
    """Write the last cycles of every unit and channel as a fresh table."""
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(store)
    last_trail(rows, n=keep).drop("back").write.mode("overwrite").parquet(target)


def compact_telemetry(records: DataFrame, keep: int = TELEMETRY_KEEP, slack: float = 1.25) -> DataFrame:
    """Newest ``keep`` records once the table has outgrown ``keep * slack``, else all of them.

    Both limits are plain numbers, so at most ``keep`` rows pass the top-k.
    """
    if records.limit(int(keep * slack) + 1).count() <= int(keep * slack):
        return records
    return records.orderBy(F.col("started_at").desc(), F.col("batch_id").desc()).limit(keep)


def recorded(spark: SparkSession, log: str, work: Callable[[DataFrame, int], int | None], no_data: Callable[[int], None] | None = None):
    """Wrap a ``foreachBatch`` body: writes one record with outcome ok, skipped or error and its duration.

    ``work`` returns the number of rows, or None when it had to wait. On an error the no-data branch runs and the
    record is written; then the error ends the stream, so that a restart reads the batch again.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        began, error, rows, failure = time.time(), None, None, None
        try:
            rows = work(batch, batch_id)
            outcome = "ok" if rows is not None else "skipped"
        except Exception as exc:  # noqa: BLE001 - the record carries it
            outcome, error, failure = "error", str(exc)[:500], exc
            if no_data:
                no_data(batch_id)
        record = spark.createDataFrame([(batch_id, time.time() - began, outcome, error, rows)],
                                       "batch_id bigint, duration_s double, outcome string, error string, rows bigint")
        record.withColumn("started_at", F.timestamp_seconds(F.lit(began))).write.mode("overwrite").json(f"{log}/cycle={batch_id}")
        if failure is not None:
            raise failure

    return body


def needs_run(files: DataFrame, marker: DataFrame, pattern: str) -> DataFrame:
    """One row: newest file, and whether a product run is due.

    Due when the newest file differs from the marker, the last run did not complete,
    or its product is older than the file.
    """
    from ..sources.tables import newest_file

    latest = newest_file(files, pattern)
    last = marker.agg(F.max_by(F.struct("file", "completed", "product_date"), "run_at").alias("_m"))
    done = (F.col("_m.file") == F.col("name")) & F.col("_m.completed") & (F.col("_m.product_date") >= F.col("reference_date"))
    return with_row(latest, last).select(
        "name", "reference_date", (~F.coalesce(done, F.lit(False))).alias("due"))


def keep_last_good(batch: DataFrame, target: str) -> bool:
    """Overwrite the served table only with a batch that has rows; readers keep the old one otherwise."""
    if batch.isEmpty():
        return False
    batch.write.mode("overwrite").parquet(target)
    return True
