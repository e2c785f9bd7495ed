"""SpotSigs fingerprints: chains of content words behind common-word anchors.

Every anchor (a common word) opens a signature: the anchor and the next content words, hashed. Where no anchor has come for ``gap`` content
words, each further word is an anchor, so texts without common words have signatures too. A text's fingerprint is the set
of its signatures, so equal texts have equal fingerprints, and boilerplate without running prose adds little to it.

Fingerprints are compared by Jaccard similarity. ``near_duplicates`` partitions them by set length, so that similar
sets lie in one partition or in neighbouring ones, and compares only those that
meet by a rare signature and whose shared signatures can reach the limit. ``likeness`` ends as soon as two sets cannot be similar enough any more.

Defined cases: null, empty and blank texts have the empty fingerprint; two empty sets are alike (1), an empty and another one are not (0). A text with
words but no signature has one signature of all its words. Rows are ordered by ``doc_id`` (null first), ties by text; the row after the last one is the first,
so a single row is its own next. Repeated rows are rows of their own. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from rainrisk.llm.common import stored
from rainrisk.llm.graph import components
from rainrisk.llm.quality import COMMON_WORDS
from rainrisk.llm.simhash import LOWER
from rainrisk.llm.similar import links
from rainrisk.operators.scale import attach

ANCHORS = frozenset(w.encode() for ws in COMMON_WORDS.values() for w in ws)
PUNCTUATION = b".,;:!?'\"()[]{}-"


@dataclass(frozen=True)
class Spots:
    """Production values: content words in a chain, content words without an anchor after which every word is one, anchors."""

    chain: int = 2
    gap: int = 8
    anchors: frozenset[bytes] = ANCHORS


def signatures(text: str | None, how: Spots = Spots()) -> np.ndarray:
    """Sorted distinct 64-bit signatures of a text."""
    words = [s for w in (text or "").encode().translate(LOWER).split() if (s := w.strip(PUNCTUATION) or w)]
    if not words:
        return np.empty(0, np.uint64)
    anchors, chain, gap = how.anchors, how.chain, how.gap
    content = [w for w in words if w not in anchors]
    spots, k, since = [], 0, 0
    for w in words:
        if w in anchors:
            since = 0
        else:
            k += 1
            since += 1
            if since <= gap:
                continue
        if k < len(content):
            spots.append(b" ".join((w, *content[k:k + chain])))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, spots or [b" ".join(words)])), dtype=">u8").astype(np.uint64))


def written(sigs: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits for each signature, ascending."""
    return sigs.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where it cannot reach ``least``, which the lengths and the first halves may tell."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    if least:
        # hashes spread evenly: what the lower half of the value range lacks cannot be made up in the upper one
        mid = np.uint64(1 << 63)
        i, j = np.searchsorted(a, mid), np.searchsorted(b, mid)
        both = len(np.intersect1d(a[:i], b[:j], assume_unique=True))
        most = both + min(len(a) - i, len(b) - j)
        if most < least * (len(a) + len(b) - most):
            return 0.0
        both += len(np.intersect1d(a[i:], b[j:], assume_unique=True))
    else:
        both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_order(docs: DataFrame, key: str, part_bytes: int) -> DataFrame:
    """(key, text, part, borrowed): rows dealt to parts by ranges of the key, each part with the first row of the next one as borrowed last row.

    The only shuffle of whole texts; the bounds are ids of a sketch, one for each part.
    """
    rows = docs.select(F.col(key).alias("key"), "text", F.col(key).cast("double").alias("at"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, total // part_bytes)
    cuts = sorted(set(rows.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    # a null key is no number of any bucket and comes first
    dealt = rows.withColumn("part", F.when(F.col("key").isNull(), 0).otherwise(F.col("bucket").cast("int") + 1)).drop("at", "bucket")
    # one row for each part, as many as there are cuts
    first = stored(dealt.groupBy("part").agg(F.min("key").alias("key")))
    at_first = dealt.join(F.broadcast(first), (dealt.part == first.part) & dealt.key.eqNullSafe(first.key), "left_semi")
    heads = stored(at_first.groupBy("part", "key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    moved = heads.join(heads.select("part", before.alias("before")), "part").select("key", "text", F.col("before").alias("part"), F.lit(True).alias("borrowed"))
    return dealt.withColumn("borrowed", F.lit(False)).unionByName(moved)


def fingerprinted(docs: DataFrame, how: Spots = Spots(), key: str = "doc_id", part_bytes: int = 4 << 20) -> DataFrame:
    """Key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next row's text.
    """
    rows = in_order(docs, key, part_bytes)
    ordered = rows.repartition("part").sortWithinPartitions("part", "borrowed", "key", "text").select("key", "text", "part", "borrowed")
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    size = 4 << 20

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, room, at, own, text, sigs = [], 0, None, None, "", None
        for part in parts:
            keys, kinds = part.column(0), part.schema.field(0).type
            for i in range(part.num_rows):
                nxt, where = part.column(1)[i].as_py() or "", part.column(2)[i].as_py()
                if where != at:
                    own, sigs, at = None, None, where
                after = signatures(nxt, how)
                if sigs is not None:
                    n = len(text)
                    edited = text[:n - n // 2] + nxt[:n // 2]
                    marks = signatures(edited, how)
                    row = (own, n, hashlib.sha256(edited.encode()).hexdigest(), written(sigs), written(marks), likeness(sigs, marks), likeness(sigs, after))
                    done.append(row)
                    room += len(row[3]) + len(row[4]) + 200
                if room > size:
                    yield table(done, kinds)
                    done, room = [], 0
                own, text, sigs = keys[i].as_py(), nxt, after
                if part.column(3)[i].as_py():
                    sigs = None
            kept = kinds
        if done:
            yield table(done, kept)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ordered.mapInArrow(batches, schema)


def sets(docs: DataFrame, how: Spots, key: str) -> DataFrame:
    """(key, cls, sigs): the signatures of every row, and the class of rows with equal ones."""
    rows = docs.select(F.col(key).alias("key"), "text")
    kind = docs.schema[key].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [signatures(t.as_py(), how) for t in part.column(1)]
            cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["key", "cls", "sigs"])

    return rows.mapInArrow(batches, f"key {kind}, cls long, sigs array<bigint>")


def near_duplicates(docs: DataFrame, tenths: int = 8, how: Spots = Spots(), key: str = "doc_id") -> DataFrame:
    """Key and component_id of every row: the smallest key reachable over pairs with a Jaccard similarity of ``tenths`` or more.

    Set lengths are cut into partitions so wide that similar sets lie in the same or in neighbouring ones; a set stands in its own partition and the next.
    Inside a partition sets meet by the rarest of their signatures: as many as leave too few others for the limit, so that no pair is missed.
    """
    rows = stored(sets(docs, how, key))
    classes = stored(rows.groupBy("cls").agg(F.first("sigs").alias("hashes")))
    each = classes.select("cls", F.size("hashes").alias("n"), F.explode("hashes").alias("sig"))
    counts = stored(each.groupBy("sig").agg(F.count(F.lit(1)).alias("m")))
    # what only one class holds meets nobody, but counts as rare
    rated = attach(each, counts, ["sig"], "inner").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("m", "sig"))).alias("s"))
    rare = F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * tenths / 10).cast("int") + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(10 / tenths) + 1e-9).cast("long")
    places = rated.withColumns({"s": F.filter(rare, lambda x: x["m"] > 1), "p": part})
    keyed = places.select("cls", "n", "p", F.explode("s").alias("x")).select("cls", "n", F.explode(F.array("p", F.col("p") + 1)).alias("p"), "x.sig")
    keyed = stored(keyed.select("cls", "n", F.xxhash64("p", "sig").alias("k")))
    found = components(links(keyed, lambda wanted: classes.join(wanted, "cls"), tenths)).withColumnRenamed("node", "cls")
    placed = stored(rows.drop("sigs").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = stored(placed.groupBy("root").agg(F.min("key").alias("component_id")))
    return placed.join(least, "root").select(F.col("key").alias(key), "component_id")
