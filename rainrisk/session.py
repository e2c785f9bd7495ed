"""Session defaults for local work; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """Local session; ``extra`` are further settings with dots written as double underscores."""
    spark = (SparkSession.builder.config(map={k.replace("__", "."): v for k, v in extra.items()}).master(f"local[{cpus}]").appName("rainrisk")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
