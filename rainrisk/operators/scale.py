"""Building blocks that stay flat when one key holds a large share of the rows.

``OrderedBlocks`` range-partitions rows by (key, order), so even a single hot key
spreads over many blocks. Ordered results (ranks, running sums, exact quantiles,
neighbour windows) are computed per block and stitched together through a table
with one row per (key, block).
"""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BLOCK = "_block"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder of the session.

    Where none is set, a local master takes a temporary one; a cluster must name a folder that all machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rainrisk-checkpoint-"))
    return df.checkpoint()


@dataclass
class OrderedBlocks:
    """Rows tagged with their block; blocks are ordered like the rows of a key."""

    rows: DataFrame
    keys: list[str]
    order: list[str]

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str]) -> "OrderedBlocks":
        """``order`` must be a total order inside a key (or ties must not matter)."""
        ranged = df.repartitionByRange(*[F.col(c) for c in keys + order])
        # the block number depends on the sampled range bounds, so it is fixed once
        return cls(checkpointed(ranged.withColumn(BLOCK, F.spark_partition_id())), keys, order)

    def extend(self, columns: dict[str, tuple[str, Column, bool]]) -> "OrderedBlocks":
        """``cumulative`` that keeps the blocks, for a running value built on another one."""
        return OrderedBlocks(self._add(columns), self.keys, self.order)

    def select(self, **columns: Column) -> "OrderedBlocks":
        """Add plain columns without leaving the blocks."""
        return OrderedBlocks(self.rows.withColumns(columns), self.keys, self.order)

    def cumulative(self, columns: dict[str, tuple[str, Column, bool]]) -> DataFrame:
        return self._add(columns).drop(BLOCK)

    def _add(self, columns: dict[str, tuple[str, Column, bool]]) -> DataFrame:
        """Add running values.

        ``columns`` maps a new name to (how, value, inclusive); how is ``sum``,
        ``max``, ``last`` (latest non-null), ``ahead`` (next non-null), ``prev`` or ``next`` (the
        adjacent row, null included) or ``total`` (sum over the whole key); the first four heed inclusive.
        """
        order = [F.col(c) for c in self.order]
        inside = Window.partitionBy(*self.keys, BLOCK).orderBy(*order)
        before = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        edge_aggs, carries, local, merged = [], [], {}, {}
        for name, (how, value, inclusive) in columns.items():
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            edge, carry = f"_edge_{name}", F.col(f"_carry_{name}")
            if how in ("sum", "total"):
                edge_aggs.append(F.sum(value).alias(edge))
                over = before if how == "sum" else whole
                carries.append(F.sum(edge).over(over).alias(f"_carry_{name}"))
                zero = F.lit(0)
                if how == "sum":
                    local[name] = F.sum(value).over(frame)
                    merged[name] = F.coalesce(carry, zero) + F.coalesce(F.col(name), zero)
                else:
                    merged[name] = carry
            elif how == "max":
                edge_aggs.append(F.max(value).alias(edge))
                carries.append(F.max(edge).over(before).alias(f"_carry_{name}"))
                local[name] = F.max(value).over(frame)
                merged[name] = F.greatest(carry, F.col(name))
            elif how == "last":
                edge_aggs.append(F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))["_v"].alias(edge))
                carries.append(F.last(edge, ignorenulls=True).over(before).alias(f"_carry_{name}"))
                local[name] = F.last(value, ignorenulls=True).over(frame)
                merged[name] = F.coalesce(F.col(name), carry)
            elif how == "ahead":
                edge_aggs.append(F.min(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))["_v"].alias(edge))
                after = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
                carries.append(F.first(edge, ignorenulls=True).over(after).alias(f"_carry_{name}"))
                local[name] = F.first(value, ignorenulls=True).over(inside.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing))
                merged[name] = F.coalesce(F.col(name), carry)
            elif how in ("prev", "next"):
                row = F.struct(value.alias("v"))
                pick, shift = (F.max, F.lag) if how == "prev" else (F.min, F.lead)
                # the row next to this block is the last of the block before or the first of the block after
                edge_aggs.append(pick(F.struct(*order, row.alias("_v")))["_v"].alias(edge))
                carries.append(shift(edge).over(Window.partitionBy(*self.keys).orderBy(BLOCK)).alias(f"_carry_{name}"))
                local[name] = shift(row).over(inside)
                merged[name] = F.coalesce(F.col(name), carry)["v"]
            else:
                raise ValueError(f"unknown running value {how!r}")
        edges = self.rows.groupBy(*self.keys, BLOCK).agg(*edge_aggs).select(*self.keys, BLOCK, *carries)
        out = self.rows.withColumns(local) if local else self.rows
        out = out.join(edges, [*self.keys, BLOCK]).withColumns(merged)
        return out.drop(*[f"_carry_{n}" for n in columns])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based row number inside a key of any size; optionally the key's row count."""
    columns = {name: ("sum", F.lit(1).cast("long"), True)}
    if total:
        columns[total] = ("total", F.lit(1).cast("long"), True)
    return OrderedBlocks.of(df, keys, order).cumulative(columns)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    method: str = "linear") -> DataFrame:
    """One row per key with exact quantiles of the non-null values.

    ``linear`` interpolates at (n-1)*q; ``index`` picks the element at
    round-half-even((n-1)*q). Equal values are counted before the shuffle, ranks
    run over the counts, so no task ever holds all values of a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = OrderedBlocks.of(counts, keys, [value]).cumulative({
        "_upto": ("sum", F.col("_n"), True), "_all": ("total", F.col("_n"), True)})
    return quantiles_of_ranked(ranked, keys, value, quantiles, method)


def quantiles_of_ranked(ranked: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                        method: str = "linear") -> DataFrame:
    """Pick quantiles from (value, rows up to and including it, rows of the key)."""
    aggs = [F.max("_all").alias("_n_rows")]
    results = []
    for name, q in quantiles.items():
        position = (F.col("_all") - 1) * F.lit(q)
        at = (lambda rank: F.min(F.when(F.col("_upto") >= rank + 1, F.col(value))))
        if method == "index":
            aggs.append(at(F.bround(position)).alias(name))
            results.append(F.col(name))
        else:
            aggs += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
            rank = (F.col("_n_rows") - 1) * F.lit(q)
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            results.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, F.col("_n_rows").alias("n_values"), *results)


def attach(big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", by: list[str] | None = None,
           salts: int = 16) -> DataFrame:
    """Join a lookup table to rows whose keys may be very uneven.

    The lookup (one or a few rows per key) is copied ``salts`` times and the rows pick
    a copy by a hash of ``by`` (default: all their plain columns), so a key that owns
    most rows still spreads over many tasks. Small lookups are broadcast by Spark's
    own size check; larger ones shuffle evenly.
    """
    by = by or [c for c, t in big.dtypes if not t.startswith(("map", "array", "struct", "void"))]
    rows = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies, [*on, "_salt"], how).drop("_salt")


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row: a scalar subquery, evaluated once, no join."""
    names = one_row.columns
    out = df.withColumn("_row", one_row.select(F.struct(*names)).scalar())
    return out.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in names])


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a foldable expression, so its size is known to the planner."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<{T.StructType.fromDDL(schema).simpleString()}>")))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First n rows per key. The rank filter lets Spark cut every map task to n rows per key before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def neighbour_chunks(rows: DataFrame, keys: list[str], rn: str, reach: int, chunk: int = 50_000) -> tuple[DataFrame, Window]:
    """Cut numbered rows into chunks that also see ``reach`` rows of both neighbours.

    Returns the rows with ``_own`` (false for borrowed rows) and the window to use;
    filter on ``_own`` after the window expressions.
    """
    at = F.pmod(F.col(rn) - 1, F.lit(chunk))
    home = F.floor((F.col(rn) - 1) / F.lit(chunk)).cast("long")
    copies = F.array(
        F.struct(home.alias("c"), F.lit(True).alias("own")),
        F.when(at < reach, F.struct((home - 1).alias("c"), F.lit(False).alias("own"))),
        F.when(at >= chunk - reach, F.struct((home + 1).alias("c"), F.lit(False).alias("own"))))
    out = (rows.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
           .withColumns({"_chunk": F.col("_copy.c"), "_own": F.col("_copy.own")}).drop("_copy"))
    return out, Window.partitionBy(*keys, "_chunk").orderBy(rn)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")
