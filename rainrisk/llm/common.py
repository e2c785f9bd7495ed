"""Shared pieces: text atoms, stored intermediate tables, exact ranks inside groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROW = "_row_id"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's checkpoint folder. Only a local master takes a new one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends at files that survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order: runs of anything but ASCII white space. Null counts as empty."""
    # one plain space between words lets split() work without a pattern
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_row_id(df: DataFrame) -> DataFrame:
    """Tag rows, repeated ones too. Store the result before the tag is used twice."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def identified(df: DataFrame) -> DataFrame:
    """``_row``, all columns as one struct, with ``_a`` and ``_b``, 128 bits of hash over them: equal rows share these, so texts need not be stored to be found again.

    Inside the struct the columns of ``df`` may have any names. What has maps inside is hashed by its JSON text.
    """
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    # a null hashes like nothing at all, so its place is hashed too
    blanks = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.xxhash64(F.lit(1), blanks, *cols).alias("_a"), F.xxhash64(F.lit(2), *reversed(cols), blanks).alias("_b"))


def found_again(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``_row`` of the rows of ``docs`` that ``marked`` (one row per identity: _a, _b, _n equal rows, further columns) names, each identity once, with the further columns."""
    tagged = identified(docs)
    out = tagged.join(marked.where("_n = 1"), ["_a", "_b"])
    several = marked.where("_n > 1")
    if not several.isEmpty():
        out = out.union(tagged.join(several, ["_a", "_b"]).dropDuplicates(["_a", "_b"]))
    return out.drop("_a", "_b", "_n")


def ranked(df: DataFrame, keys: list[str], spread: str, name: str, lookup: DataFrame | None = None, slices: int = 256) -> DataFrame:
    """Exact 0-based rank of each row inside non-null ``keys`` in the order of the hash column ``spread``; ties by row id.

    Each key is cut into ``slices`` even pieces by the hash; ranks run inside a piece and start where the smaller pieces
    end, so no task ever holds a whole hot key. The columns of ``lookup`` (one row per key) come along.
    """
    df = df.withColumn("_slice", F.pmod(F.shiftrightunsigned(spread, 24), F.lit(slices)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    starts = stored(starts if lookup is None else starts.join(lookup, keys))
    inside = Window.partitionBy(*keys, "_slice").orderBy(spread, ROW)
    return (df.withColumn("_rn", F.row_number().over(inside)).join(starts, [*keys, "_slice"])
            .withColumn(name, F.col("_start") + F.col("_rn") - 1).drop("_slice", "_start", "_rn"))
