"""Embedding near-duplicates by sorted projection passes.

Equal vectors become one class. In every pass a class gets a signature, the concatenated signs of random projections;
classes are sorted by it and each is compared with a bounded window of neighbours. Links are verified by cosine in double
precision and united over the passes. The links of every component are then counted exactly, by blocks of its classes
against each other; counts leave the tasks, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component. Vectors of
different length never meet. Repeated rows are vectors of their own; equal ones link. A row with null vec_id takes part, a component is named by
its smallest non-null vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rainrisk.llm.common import ROW, stored, with_row_id
from rainrisk.llm.graph import components

SIGNED = 60


@dataclass(frozen=True)
class Passes:
    """Production values: passes, neighbours on each side, classes per block when the links of a component are counted."""

    min_cosine: float = 0.95
    passes: int = 16
    window: int = 40
    block: int = 512
    seed: int = 11


def projections(size: int, n: int, seed: int) -> np.ndarray:
    """The same random directions in every task."""
    return np.random.default_rng([seed, size]).standard_normal((size, n))


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    # the largest component goes first, so that squares neither overflow nor vanish
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def signatures(classes: DataFrame, how: Passes) -> DataFrame:
    """A row per class and pass: lane (vector size and pass), signature, class and vector."""
    element = classes.schema["vec"].dataType.simpleString()

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIGNED, dtype=np.int64)
        for part in parts:
            sizes = part.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                own = part.filter(pa.array(sizes == size))
                bits = unit_rows(matrix(own.column(1), size)) @ projections(size, how.passes * SIGNED, how.seed) > 0
                for p in range(how.passes):
                    sig = bits[:, p * SIGNED:(p + 1) * SIGNED] @ weights
                    lane = np.full(len(sig), int(size) * 1024 + p, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(sig), own.column(0), own.column(1)], names=["lane", "sig", "cls", "vec"])

    return classes.select("cls", "vec").mapInArrow(sign, f"lane long, sig long, cls long, vec {element}")


def window_links(ordered: DataFrame, how: Passes) -> DataFrame:
    """Verified links (a, b) inside each partition of rows sorted by lane and signature, the rows at both ends of the partition, and its size.

    ``side`` is 0 for a link, -1 for one of the first rows and 1 for one of the last, with ``place`` counted from that end; the row of side 2
    holds the number of rows in ``place``.
    """
    element = ordered.schema["vec"].dataType.simpleString()

    def slide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "side", "place", "lane", "sig", "vec"]

        def rows(a, b, side, place, lane, sig, vec):
            longs = [pa.array(x, pa.int64()) for x in (place, lane, sig)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(side, pa.int32()), *longs, vec], names=names)

        def ends(part, side, place):
            n = part.num_rows
            return rows(part.column(2), [None] * n, [side] * n, place, part.column(0), part.column(1), part.column(3))

        tail, head, total = None, 0, 0
        for part in parts:
            if head < how.window:
                first = part.slice(0, how.window - head)
                yield ends(first, -1, np.arange(head, head + first.num_rows))
                head += min(part.num_rows, how.window - head)
            both = part if tail is None else pa.concat_batches([tail, part])
            a, b = neighbour_links(both, 0 if tail is None else tail.num_rows, how)
            none = [None] * len(a)
            yield rows(a, b, [0] * len(a), none, none, none, pa.nulls(len(a), part.schema.field("vec").type))
            total += part.num_rows
            tail = both.slice(max(0, both.num_rows - how.window))
        if total:
            yield ends(tail, 1, np.arange(tail.num_rows)[::-1])
            yield rows([None], [None], [2], [total], [None], [None], pa.nulls(1, tail.schema.field("vec").type))

    return ordered.mapInArrow(slide, f"a long, b long, side int, place long, lane long, sig long, vec {element}")


def seam_rows(slid: DataFrame, how: Passes) -> DataFrame:
    """Rows around the start of each partition that holds rows: its first ones, and those at most a window before, however many partitions back.

    One row per partition goes through an unpartitioned window: as many as there are partitions.
    """
    order = Window.orderBy("at")
    starts = slid.where("side = 2").select("at", F.col("place").alias("n")).withColumn("start", F.sum("n").over(order) - F.col("n"))
    following = F.collect_list(F.struct("at", "start")).over(order.rowsBetween(1, how.window))
    starts = starts.select("at", (F.col("start") + F.col("n")).alias("stop"), following.alias("following"))
    last = slid.where("side = 1").join(starts, "at")
    reached = F.filter("following", lambda f: f["start"] - F.col("stop") + F.col("place") < how.window)
    last = last.withColumn("f", F.explode(reached)).withColumn("seam", F.col("f.at"))
    first = slid.where("side = -1").withColumn("seam", F.col("at"))
    return first.select("seam", "lane", "sig", "a", "vec").unionByName(last.select("seam", "lane", "sig", "a", "vec"))


def neighbour_links(rows: pa.RecordBatch, old: int, how: Passes) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows at most a window apart in one lane; pairs of the first ``old`` rows are known already."""
    lanes, cls = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    cuts = np.flatnonzero(np.diff(lanes)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(lanes)]):
        if hi - lo < 2:
            continue
        unit = unit_rows(matrix(rows.column(3).slice(lo, hi - lo), int(lanes[lo]) // 1024))
        for step in range(1, min(how.window, hi - lo - 1) + 1):
            first = max(0, old - lo - step)
            near = np.flatnonzero(np.einsum("ij,ij->i", unit[first:-step], unit[first + step:]) >= how.min_cosine) + first + lo
            out_a.append(cls[near])
            out_b.append(cls[near + step])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def found_links(classes: DataFrame, how: Passes) -> DataFrame:
    """Distinct links (a < b) between classes over all passes."""
    ordered = signatures(classes, how).repartitionByRange("lane", "sig", "cls").sortWithinPartitions("lane", "sig", "cls")
    slid = stored(window_links(ordered, how).withColumn("at", F.spark_partition_id()))
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lane", "sig", "a"], kind="stable")
        part = pa.RecordBatch.from_arrays([pa.array(pdf[c].to_numpy()) for c in ("lane", "sig", "a")] + [pa.array(pdf["vec"].tolist(), pa.list_(pa.float64()))], names=["lane", "sig", "cls", "vec"])
        a, b = neighbour_links(part, 0, how)
        return pd.DataFrame({"a": a, "b": b})

    across = seam_rows(slid, how).groupBy("seam").applyInPandas(meet, "a long, b long")
    return stored(slid.where("side = 0").select("a", "b").union(across).where("a <> b").distinct())


def link_counts(members: DataFrame, how: Passes) -> DataFrame:
    """(cls, linked): vectors linked with each class inside its component, from all pairs of blocks of the component.

    ``members`` has root, size (classes of the component), cls, copies, vec. A class goes to as many tasks as there are blocks.
    """
    blocks = F.ceil(F.col("size") / how.block).cast("int")
    rows = members.withColumns({"nb": blocks, "blk": F.pmod(F.xxhash64("cls"), blocks).cast("int")})
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, F.col("blk")).alias("i"), F.greatest(j, F.col("blk")).alias("j")))
    rows = rows.withColumn("pair", F.explode(pair)).select("root", "pair.i", "pair.j", "blk", "cls", "copies", "vec")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.blk == pdf.i], pdf[pdf.blk == pdf.j]
        if left.empty or right.empty:
            return pd.DataFrame({"cls": [], "linked": []}).astype("int64")
        near = unit_rows(np.stack(left.vec.to_list())) @ unit_rows(np.stack(right.vec.to_list())).T >= how.min_cosine
        if pdf.i.iloc[0] == pdf.j.iloc[0]:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"cls": left.cls.to_numpy(), "linked": near @ right.copies.to_numpy()})
        return pd.DataFrame({"cls": np.concatenate([left.cls, right.cls]), "linked": np.concatenate([near @ right.copies.to_numpy(), left.copies.to_numpy() @ near])})

    return rows.groupBy("root", "i", "j").applyInPandas(count, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, how: Passes = Passes(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Key, n_links, component_id and kept for every row."""
    rows = stored(with_row_id(vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("vec"))))
    sound = F.expr("vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound")
    # one class per distinct vector, named by its least row id
    classes = stored(good.groupBy("vec").agg(F.min(ROW).alias("cls"), F.count(F.lit(1)).alias("copies"), F.min("_key").alias("least")))
    links = found_links(classes, how)
    roots = stored(classes.select("cls", "copies", "least").join(components(links), F.col("cls") == F.col("node"), "left")
                   .select("cls", "copies", "least", F.coalesce("root", "cls").alias("root")))
    sizes = stored(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("component_id")))
    roots = stored(roots.join(sizes, "root"))
    linked = roots.where("size > 1").join(classes.select("cls", "vec"), "cls")
    counts = link_counts(linked, how)
    summary = stored(roots.join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = stored(classes.select("cls", "vec").join(summary, "cls").drop("cls"))
    out = rows.join(named.withColumn("sound", F.lit(True)), ["vec", "sound"], "left")
    own = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("_key"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("_key")).alias("kept"))
