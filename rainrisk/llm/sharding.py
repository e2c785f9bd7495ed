"""Byte-limited shards by extendible hashing.

The directory is indexed by the leading bits of a row's hash. A bucket above the byte limit splits on the next bit, all others stay,
so a shard is the shortest bit prefix whose rows fit. The directory is built from byte sums per prefix, never from the
rows of a bucket: one pass sums a window of bits, the levels above are sums of those sums, and only
rows of buckets that are still too large look at further bits.

Defined cases: a null text has no bytes and is placed like any other. Keys are hashed by md5; repeated or null keys are told apart by a hash of
the row id after its 128 bits. A single row above the limit is a shard of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rainrisk.llm.common import ROW, stored, with_row_id

LIMIT = 64 << 20
#: Bits of a row: md5 of the key, then a hash of the row id.
BITS = 192


def _bits(key: str) -> Column:
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    halves = [F.lpad(F.conv(F.substring(digest, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.concat(*halves, F.lpad(F.bin(F.xxhash64(ROW)), 64, "0"))


def sharded(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", spare: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, n_bytes, shard (its bit prefix), depth and shard_bytes of every row; ``keep`` names further columns, returned as ``_in0``, ..."""
    rows = with_row_id(docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(keep)],
                                   F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    rows = stored(rows.withColumn("_bits", _bits("_key")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    used, width = 0, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + spare
    open_rows, done = rows, []
    while True:
        leaf = F.substring("_bits", 1, used + width)
        leaves = stored(open_rows.groupBy(leaf.alias("_leaf")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
        prefixes = leaves.select("_leaf", "b", "n", F.explode(F.sequence(F.lit(used), F.lit(used + width))).alias("d")).withColumn("p", F.expr("substring(_leaf, 1, d)"))
        buckets = stored(prefixes.groupBy("d", "p").agg(F.sum("b").alias("bucket_bytes"), F.sum("n").alias("bucket_rows")))
        fits = buckets.where((F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1) | (F.col("d") >= BITS))
        # a larger bucket on the same path is never smaller, so the first that fits is where splitting ends
        directory = stored(prefixes.select("_leaf", "d", "p").join(fits, ["d", "p"]).groupBy("_leaf")
                           .agg(F.min(F.struct("d", "p", "bucket_bytes")).alias("s")).select("_leaf", "s.*"))
        placed = stored(open_rows.withColumn("_leaf", leaf).join(directory, "_leaf", "left"))
        done.append(placed.where("d IS NOT NULL"))
        open_rows = placed.where("d IS NULL").select(*rows.columns)
        if open_rows.isEmpty():
            break
        used, width = used + width, min(spare + 4, BITS - used - width)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(F.col("_key").alias(key), "n_bytes", F.col("p").alias("shard"), F.col("d").alias("depth"), F.col("bucket_bytes").alias("shard_bytes"),
                      *[f"_in{i}" for i in range(len(keep))])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard; rows of a shard meet in one task only up to the byte limit."""
    names = docs.columns
    # the letter keeps readers from taking the bits for a number
    out = sharded(docs, limit, key, keep=tuple(names)).select(F.concat(F.lit("b"), "shard").alias("shard"), *[F.col(f"_in{i}").alias(c) for i, c in enumerate(names)])
    out.repartition("shard").write.partitionBy("shard").parquet(path)
