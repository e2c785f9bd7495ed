"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into more blocks than bits may differ, so a close pair agrees on all but that many blocks. Every choice of
agreeing blocks is a join key; pairs that share a key are verified by their Hamming distance. Work runs over distinct
fingerprints: exact copies share one. A key that many different fingerprints hold is not paired up:
its members, in groups of fingerprints one bit flip away from a common value, link to the smallest of each group.
Members of such a group differ by two bits at most, and any two that differ by two or fewer meet in one.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other. Repeated rows are equal documents. A row with null
doc_id takes part; its component is the smallest non-null doc_id reachable, null if there is none. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import stored
from rainrisk.llm.graph import components

BITS, MAX_BITS = 64, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash over the word shingles of a text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), dtype=np.uint8).reshape(-1, 8)
    # long texts in portions, as every bit becomes a byte
    ones = sum(np.unpackbits(digests[i:i + 8192], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(digests), 8192))
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` as ``_in0``, ``_in1``, ... and the fingerprint ``fp`` of every row."""
    names = [f"_in{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").alias("_text"))
    schema = rows.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def batches(parts):
        for part in parts:
            prints = pa.array([fingerprint(t.as_py(), width, seed) for t in part.column(part.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], prints], names=[*names, "fp"])

    return rows.mapInArrow(batches, schema)


def block_masks(max_bits: int = MAX_BITS, spare: int = 2) -> list[int]:
    """Signed masks of the bits that a close pair agrees on: all choices of ``spare`` out of ``max_bits + spare`` blocks."""
    n = max_bits + spare
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, spare)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, crowd: int = 128) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all pairs within two bits and no others.

    Keys with up to ``crowd`` fingerprints are joined pair by pair; in fuller ones each member links to the least of its flip
    groups. A flip group stands for all its pairs, so the result has every connection, not every pair.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks())])
    keyed = stored(prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k"))
    counts = stored(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(keyed.join(counts, ["t", "k"]))
    few = shared.where(F.col("n") <= crowd)
    other = few.select(F.col("t").alias("t2"), F.col("k").alias("k2"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = few.join(other, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2")) & (F.col("fp") < F.col("b")) & near)
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    packed = shared.where(F.col("n") > crowd).select("fp").distinct()
    # a flip group has 65 members at most
    groups = packed.select("fp", F.explode(flips).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    grouped = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.select(F.col("fp").alias("a"), "b").union(grouped)


def labels(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in ``rows`` (fp, _in0 as key): root is the same all over a component."""
    prints = stored(rows.groupBy("fp").agg(F.min("_in0").alias("least")))
    roots = components(links(prints.select("fp")))
    labelled = stored(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = stored(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    return stored(labelled.join(smallest, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Key, fingerprint (16 hex digits) and component_id of every row."""
    rows = stored(with_fingerprints(docs, width, seed, (key,)))
    # both sides come from files, so adaptive execution can split a fingerprint that many rows share
    return rows.join(labels(rows), "fp").select(F.col("_in0").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
