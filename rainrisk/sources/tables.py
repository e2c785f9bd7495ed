"""Partitioned tables and telemetry scans. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rain import window_hours

GRID_SCHEMA = "lat_idx int, lon_idx int, mm double, hr timestamp"
SAMPLE_SCHEMA = "mesh string, hour timestamp, n int, samples array<double>"
CYCLE_SCHEMA = ("started_at string, finished_at string, duration_s double, outcome string, data_status string, files_ok int, "
                "missing_24h int, max_rd int, error string, by_level array<int>, by_level_geo array<int>, "
                "by_level_hidro array<int>, alert_count int, ac24h_max double, ac24h_mean double, ac96h_max double, "
                "intensity_max double, gauge struct<applied:boolean,mean_factor:double,stations_recent:int,points_corrected:int>")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def rain_grid(spark: SparkSession, root: str, target: Column) -> DataFrame:
    """Decoded rain cells of the 96 hours up to the target; ``day`` partitions are pruned."""
    grid = spark.read.schema(GRID_SCHEMA + ", day date").parquet(root)
    first = F.to_date(target - F.expr("INTERVAL 95 HOURS"))
    return window_hours(grid.where((F.col("day") >= first) & (F.col("day") <= F.to_date(target))), target).drop("day")


def decoded_samples(spark: SparkSession, root: str, mesh: str | None = None) -> DataFrame:
    """Stored samples, one JSON per mesh and hour, exploded to (mesh, hour, position, mm).

    A file whose list length differs from its declared size is left out.
    """
    raw = spark.read.schema(SAMPLE_SCHEMA).json(root)
    if mesh:
        raw = raw.where(F.col("mesh") == mesh)
    return raw.where(F.col("n") == F.size("samples")).select("mesh", "hour", F.posexplode("samples").alias("position", "mm"))


def forecast_grid(spark: SparkSession, root: str, first_run: Column) -> DataFrame:
    """Forecast cells accumulated since the run start, newest runs only."""
    schema = "run timestamp, valid timestamp, lat_idx int, lon_idx int, acc_mm double"
    return spark.read.schema(schema).parquet(root).where(F.col("run") >= first_run)


def telemetry(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """Cycle records from JSON lines; broken lines and rows without a start are skipped."""
    rows = spark.read.schema(CYCLE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return telemetry_rows(rows, keep)


def telemetry_rows(rows: DataFrame, keep: int | None = None) -> DataFrame:
    rows = rows.where(F.col("started_at").isNotNull() & (F.col("started_at") != ""))
    return rows if keep is None else rows.orderBy(F.col("started_at").desc()).limit(keep)


def newest_file(files: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """One row: the newest name that matches, with the date written in it."""
    hit = files.where(F.col(name).rlike(pattern)).agg(F.max(name).alias(name)).where(f"{name} IS NOT NULL")
    return hit.withColumn("reference_date", F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date"))


def listed_files(spark: SparkSession, root: str, glob: str = "*", with_digest: bool = False) -> DataFrame:
    """Name, size, time and optionally SHA-256 of the files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root)
    digest = [F.sha2("content", 256).alias("sha256")] if with_digest else []
    return rows.select(F.col("path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"),
                       F.col("modificationTime").alias("modified"), *digest)


def product_index(manifest: DataFrame, published: tuple[str, ...] = ("observado", "D+1", "D+2", "D+3")) -> DataFrame:
    """Products per horizon; D+0 is kept in the manifest but not published."""
    return manifest.where(F.col("horizonte").isin(*published))


def csv_table(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), **options) -> DataFrame:
    """CSV with header; ``numbers`` become doubles, bad values null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, **options)
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def road_table(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Keep and rename road attributes, dropping the rest at the scan."""
    return raw.select(*[F.col(a).alias(b) for a, b in columns.items()])
