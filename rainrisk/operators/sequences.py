"""Ordered operators along a road: smoothing, runs, neighbours, quotas by rank.

A road may hold any share of the rows; order is resolved block-wise (see ``scale``).
Two rules carry a state from row to row; they run in small grouped-map helpers over
stretches that are provably independent of each other.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geo
from .scale import BLOCK, OrderedBlocks, attach, checkpointed, neighbour_chunks, numbered, own_rows

TRUST = 0.35


def _mode_first_seen(values: Column) -> Column:
    """Most frequent element of an array; the one seen first on a tie; null for an empty array."""
    distinct = F.array_distinct(values)
    votes = F.transform(distinct, lambda v: F.size(F.filter(values, lambda x: x == v)))
    return F.get(distinct, F.array_position(votes, F.array_max(votes)).cast("int") - 1)


def moving_mode(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int = 5, name: str = "smooth",
                fill: bool = False) -> DataFrame:
    """Mode of a centred window; nulls have no vote; optionally fill gaps forward, then backward."""
    half = size // 2
    blocks = OrderedBlocks.of(rows, keys, order).extend({"_rn": ("sum", F.lit(1).cast("long"), True)})
    chunks, w = neighbour_chunks(blocks.rows, keys, "_rn", half)
    seen = F.collect_list(value).over(w.rowsBetween(-half, half))
    out = own_rows(chunks.withColumn(name, _mode_first_seen(seen)))
    if not fill:
        return out.drop("_rn", BLOCK)
    out = OrderedBlocks(out, keys, ["_rn"]).cumulative({"_ff": ("last", F.col(name), True)})
    first = out.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min_by(name, "_rn").alias("_first"))
    return attach(out, first, keys).withColumn(name, F.coalesce("_ff", "_first")).drop("_ff", "_first", "_rn")


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], cls: str, start: str, stop: str | None = None,
                drop: int | None = -1) -> DataFrame:
    """Contiguous runs of one class per key with first and last position; class ``drop`` is left out."""
    stop = stop or start
    blocks = OrderedBlocks.of(rows, keys, order).extend({"_prev": ("last", F.struct(F.col(cls).alias("c")), False)})
    changed = F.when(F.col("_prev").isNull() | ~F.col("_prev.c").eqNullSafe(F.col(cls)), 1).otherwise(0)
    runs = (blocks.cumulative({"run": ("sum", changed.cast("long"), True)})
            .groupBy(*keys, "run", cls).agg(F.min(start).alias("run_start"), F.max(stop).alias("run_stop"),
                                            F.count(F.lit(1)).alias("n")))
    return runs if drop is None else runs.where(F.col(cls) != drop)


def _absorb(runs: Iterable[dict], cls: str, allowed_col: str | None, min_km: float) -> Iterator[dict]:
    """Leftmost unwanted run joins its longer neighbour (left on a tie) until none is left; then equal ones fuse.

    One pass from left to right. All before the current run is wanted, so only the last kept run, the start that absorbed runs
    hand on to the right, and the width of the next run matter.
    """
    out = kept = carry = current = None  # the fused result so far; start and stop of its last run
    for nxt in chain(runs, [None]):
        if current is not None:
            start, stop = current["run_start"] if carry is None else carry, current["run_stop"]
            carry = None
            unwanted = not current[allowed_col] if allowed_col else stop - start < min_km
            if not unwanted or (kept is None and nxt is None):
                if out is not None and out[cls] == current[cls]:
                    out["run_stop"] = stop
                else:
                    if out is not None:
                        yield out
                    out = current | {"run_start": start}
                kept = [start, stop]
            elif nxt is None or (kept is not None and kept[1] - kept[0] >= nxt["run_stop"] - nxt["run_start"]):
                kept[1] = out["run_stop"] = stop
            else:
                carry = start
        current = nxt
    if out is not None:
        yield out


def _streamed(parts: DataFrame, keys: list[str], order: str, rule: Callable[[Iterable[dict]], Iterator[dict]], chunk: int = 20_000) -> DataFrame:
    """Stream every stretch through ``rule``: tasks hold a batch of rows, never a stretch."""
    group = [*keys, "_part"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        found = (out for _, stretch in groupby(rows, key=itemgetter(*group)) for out in rule(stretch))
        while done := list(islice(found, chunk)):
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = to_arrow_schema(parts.schema)
    return parts.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(stream, parts.schema)


def absorb_runs(runs: DataFrame, keys: list[str], cls: str, min_km: float = 0.15, allowed: str | None = None) -> DataFrame:
    """Absorb runs shorter than ``min_km`` (or not ``allowed``, a boolean column), then fuse equal neighbours.

    Where two wanted runs touch, nothing on one side can change the other side, and
    both stay with their different classes, so the sequence is cut there and the
    stretches run in parallel. ``run`` keeps the order of the result.
    """
    wanted = F.col(allowed) if allowed else (F.col("run_stop") - F.col("run_start")) >= F.lit(min_km)
    blocks = OrderedBlocks.of(runs.withColumn("_w", wanted), keys, ["run"]).extend({"_pw": ("last", F.col("_w"), False)})
    cut = F.when(F.col("_w") & F.coalesce(F.col("_pw"), F.lit(False)), 1).otherwise(0)
    # the stretches are read by both branches below, so they are computed once
    parts = checkpointed(blocks.cumulative({"_part": ("sum", cut.cast("long"), True)}).drop("_w", "_pw"))
    schema = parts.schema
    # stretches of one run need no Python
    lone = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    sized = parts.join(lone, [*keys, "_part"])
    quiet = sized.where("_size = 1").select(*schema.names)
    busy = _streamed(sized.where("_size > 1").select(*schema.names), keys, "run", lambda runs: _absorb(runs, cls, allowed, min_km))
    return quiet.unionByName(busy).drop("_part", "n")


def fill_from_neighbours(rows: DataFrame, keys: list[str], order: list[str], score: str = "score", conf: str = "conf",
                         trust: float = TRUST) -> DataFrame:
    """Scores below the trust limit take the mean of the trusted neighbours.

    The rule runs left to right and reads values it has just filled, which comes to:
    the last trusted score before, averaged with the next row's score if that is
    trusted. Rows before the first trusted score only look right. Filled rows get
    confidence 0.5 and a whole-number ``mode``.
    """
    return _filled_blocks(rows, keys, order, score, conf, trust).rows.drop(BLOCK)


def _filled_blocks(rows: DataFrame, keys: list[str], order: list[str], score: str, conf: str, trust: float) -> OrderedBlocks:
    known = F.when(F.col(conf) >= trust, F.col(score))
    blocks = OrderedBlocks.of(rows, keys, order).extend({
        "_rn": ("sum", F.lit(1).cast("long"), True), "_left": ("last", known, False), "_right": ("next", known, False)})
    mean = (F.when(F.col("_left").isNotNull() & F.col("_right").isNotNull(), (F.col("_left") + F.col("_right")) / F.lit(2.0))
            .otherwise(F.coalesce("_left", "_right")))
    filled = (F.col(conf) < trust) & mean.isNotNull()
    out = blocks.rows.withColumns({"_filled": filled, "_mean": mean}).withColumns({
        score: F.when(F.col("_filled"), F.col("_mean")).otherwise(F.col(score)),
        conf: F.when(F.col("_filled"), F.lit(0.5)).otherwise(F.col(conf))}).drop("_left", "_right", "_mean")
    return OrderedBlocks(out, keys, ["_rn"])


def _fix_outliers(rows: Iterable[dict], trust: float) -> Iterator[dict]:
    left = None
    for r in rows:
        left_s, left_c = left or (r["_ls"], r["_lc"])
        if (r["_inner"] and r["conf"] >= trust and abs(left_s - r["_rs"]) <= 1.0 and abs(r["score"] - left_s) > 1.5):
            r["score"], r["_fixed"] = (left_s if left_c >= r["_rc"] else r["_rs"]), True
            r["conf"] = min(r["conf"], 0.6)
        left = r["score"], r["conf"]
        yield r


def smooth_neighbours(rows: DataFrame, keys: list[str], order: list[str], trust: float = TRUST) -> DataFrame:
    """Fill weak scores, then correct a score that departs from two agreeing neighbours.

    Input columns ``score, conf, mode``. The correction reads corrected left values.
    A row whose right neighbour is within 0.5 can never change, whatever its left
    value is, so the sequence is cut after such rows and after untrusted ones.
    """
    filled = _filled_blocks(rows, keys, order, "score", "conf", trust)
    pair = F.struct(F.col("score").alias("s"), F.col("conf").alias("c"))
    near = filled.extend({"_p": ("prev", pair, False), "_n": ("next", pair, False)}).select(
        _ls=F.col("_p.s"), _lc=F.col("_p.c"), _rs=F.col("_n.s"), _rc=F.col("_n.c"), _inner=F.col("_p").isNotNull() & F.col("_n").isNotNull())
    frozen = ~F.col("_inner") | (F.col("conf") < trust) | (F.abs(F.col("score") - F.col("_rs")) <= 0.5)
    parts = near.select(_frozen=frozen, _fixed=F.lit(False)).cumulative(
        {"_part": ("sum", F.when(F.col("_frozen"), 1).otherwise(0).cast("long"), False)}).drop("_p", "_n")
    # both branches below read the stretches, so they are computed once
    parts = checkpointed(parts)
    still = parts.groupBy(*keys, "_part").agg((F.count_if(~F.col("_frozen")) == 0).alias("_still"))
    tagged = parts.join(still, [*keys, "_part"])
    quiet = tagged.where("_still").select(*parts.columns)
    busy = _streamed(tagged.where("NOT _still").select(*parts.columns), keys, "_rn", lambda rows: _fix_outliers(rows, trust))
    out = quiet.unionByName(busy)
    mode = F.when(F.col("_filled") | F.col("_fixed"), F.bround("score").cast("int")).otherwise(F.col("mode"))
    return out.withColumn("mode", mode).select(*rows.columns)


def continuity(rows: DataFrame, keys: list[str], order: list[str], cls: str) -> DataFrame:
    """Share of neighbour pairs whose class jump is at most 1, per key."""
    prev = OrderedBlocks.of(rows, keys, order).cumulative({"_prev": ("last", F.col(cls), False)})
    pair = F.col("_prev").isNotNull() & F.col(cls).isNotNull()
    smooth = F.count_if(pair & (F.abs(F.col(cls) - F.col("_prev")) <= 1))
    return prev.groupBy(*keys).agg(F.count_if(pair).alias("pairs"), smooth.alias("smooth_pairs")).withColumn(
        "continuity", F.try_divide(F.col("smooth_pairs"), F.col("pairs")))


def chain_runs(chain: DataFrame, keys: list[str], order: list[str], max_gap_m: float) -> DataFrame:
    """Split a point chain where the step exceeds the gap; points and length in metres per run."""
    here = F.struct("lat", "lon")
    blocks = OrderedBlocks.of(chain, keys, order).extend({"_p": ("last", here, False)})
    step = geo.haversine_km(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")) * F.lit(1000.0)
    blocks = blocks.select(_step=step)
    cut = F.when(F.col("_step") > max_gap_m, 1).otherwise(0)
    inside = F.when(F.col("_step") <= max_gap_m, F.round(F.col("_step") * 1000).cast("long")).otherwise(F.lit(0))
    return (blocks.cumulative({"run": ("sum", cut.cast("long"), True)})
            .groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n_points"), (F.sum(inside) / F.lit(1000.0)).alias("length_m")))


def cycle_gaps(cycles: DataFrame, ts: str = "started_at", tie: str = "cycle_id", keys: list[str] | None = None) -> DataFrame:
    """Minutes since the previous cycle."""
    prev = OrderedBlocks.of(cycles, keys or [], [ts, tie]).cumulative({"_prev": ("last", F.col(ts), False)})
    seconds = F.unix_micros(ts) - F.unix_micros("_prev")
    return prev.withColumn("gap_min", seconds / F.lit(60e6)).drop("_prev")


def allocate_quota(rows: DataFrame, quotas: DataFrame, keys: list[str], suggested: str, order: str, name: str = "assigned") -> DataFrame:
    """Hand out classes 4..0 by rank: highest suggestion first (null last), then position.

    ``quotas`` has the keys and ``quota`` = units in class 0..4. Rows beyond the quota
    get null; check the sizes with ``quota_mismatches``.
    """
    ranked = numbered(rows.withColumn("_s", -F.coalesce(F.col(suggested), F.lit(-1))), keys, ["_s", order], "_rn").drop("_s")
    q = lambda i: F.get("quota", F.lit(i))
    upto4, upto3 = q(4), q(4) + q(3)
    upto2 = upto3 + q(2)
    upto1 = upto2 + q(1)
    rn = F.col("_rn")
    cls = (F.when(rn <= upto4, 4).when(rn <= upto3, 3).when(rn <= upto2, 2).when(rn <= upto1, 1).when(rn <= upto1 + q(0), 0))
    return attach(ranked, quotas.select(*keys, "quota"), keys).withColumn(name, cls).drop("quota", "_rn")


def quota_mismatches(rows: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose size differs from the sum of their quota."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"))
    wanted = quotas.select(*keys, F.aggregate("quota", F.lit(0), lambda a, x: a + x).alias("quota_units"))
    return sizes.join(wanted, keys, "full_outer").where(~F.col("units").eqNullSafe(F.col("quota_units")))


class _Marks:
    """Places of one class from 1 on, with the nearest one on either side: words of 64 bits, and above them words that say which are in use."""

    def __init__(self, flags: np.ndarray):
        self.levels = []
        while True:
            bits = np.zeros(-(-len(flags) // 64) * 64, bool)
            bits[:len(flags)] = flags
            words = np.packbits(bits, bitorder="little").view("<u8")
            self.levels.append(array("Q", words.tobytes()))
            if len(words) == 1:
                return
            flags = words != 0

    def add(self, i: int) -> None:
        for words in self.levels:
            words[i >> 6] |= 1 << (i & 63)
            i >>= 6

    def remove(self, i: int) -> None:
        for words in self.levels:
            words[i >> 6] &= ~(1 << (i & 63))
            if words[i >> 6]:
                return
            i >>= 6

    def after(self, i: int) -> int | None:
        for depth, words in enumerate(self.levels):
            if w := words[i >> 6] >> (i & 63) + 1:
                i += (w & -w).bit_length()
                for lower in reversed(self.levels[:depth]):
                    i = (i << 6) + (lower[i] & -lower[i]).bit_length() - 1
                return i
            i >>= 6
        return None

    def before(self, i: int) -> int | None:
        for depth, words in enumerate(self.levels):
            if w := words[i >> 6] & (1 << (i & 63)) - 1:
                i = (i >> 6 << 6) + w.bit_length() - 1
                for lower in reversed(self.levels[:depth]):
                    i = (i << 6) + lower[i].bit_length() - 1
                return i
            i >>= 6
        return None


def _balance(classes: np.ndarray, over: list[int]) -> None:
    """Move places between classes 0..4 in ``classes`` (place 0 is unused) until ``over``, the surplus of each class, is all zero.

    Each step takes the fullest and the emptiest class (the lower one on a tie) and moves the place of the first that is nearest to one of the
    second (the lower one on a tie; the first place while there is none). A full class only loses places and an empty one only gains them, so a heap for each
    pair holds every border between the two, and a move adds the borders that it opens.
    """
    n = len(classes)
    full, empty = [k for k in range(5) if over[k] > 0], [k for k in range(5) if over[k] < 0]
    marks = {k: _Marks(classes == k) for k in full + empty}
    borders = {}
    for s in full:
        for t in empty:
            at = np.flatnonzero((classes == s) | (classes == t))
            kind = classes[at]
            met = kind[1:] != kind[:-1]
            places = np.where(kind[1:] == s, at[1:], at[:-1])
            borders[s, t] = np.sort(((at[1:] - at[:-1]) * n + places)[met]).tolist()
    while any(over):
        s, t = over.index(max(over)), over.index(min(over))
        heap = borders[s, t]
        while heap and classes[heap[0] % n] != s:
            heappop(heap)
        i = heap[0] % n if heap else marks[s].after(0)
        classes[i] = t
        over[s] -= 1
        over[t] += 1
        marks[s].remove(i)
        marks[t].add(i)
        for o in full:
            left, right = marks[o].before(i), marks[o].after(i)
            for u in empty if o == s else [t]:
                if left and (a := marks[u].after(left)):
                    heappush(borders[o, u], (a - left) * n + left)
                if right and (a := marks[u].before(right)):
                    heappush(borders[o, u], (right - a) * n + right)


def _moved(group: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Places of one group that change their class, from its blocks of digits."""
    parts = group.sort_values("_first")
    digits = np.frombuffer("".join(parts["_digits"]).encode(), np.uint8).astype(np.int8) - 48
    key = {k: group[k].iloc[0] for k in keys}
    want = parts["quota"].iloc[0]
    if want is None or len(want) != 5 or sum(want) != len(digits):
        raise ValueError(f"group size does not fit its quota: {key}")
    classes = np.concatenate([np.array([-1], np.int8), digits])
    _balance(classes, [int(c) - int(w) for c, w in zip(np.bincount(digits, minlength=5), want)])
    at = np.flatnonzero(classes[1:] != digits)
    return pd.DataFrame(key | {"_rn": at + 1, "_new": classes[at + 1].astype(np.int32)}, columns=[*keys, "_rn", "_new"])


def calibrate_to_quota(rows: DataFrame, quotas: DataFrame, keys: list[str], order: str, cls: str) -> DataFrame:
    """Move units from the most overfull class to the most underfull one, nearest in sequence first, until every class 0..4 has its quota.

    Null and negative classes count as 0, a class over 4 is an error. ``order`` is unique inside a group; ``quotas`` has one row for each group, and a group
    whose size differs from its quota fails the job. Each move depends on the one before, so the moves of a group are made one after another: for that its
    classes, one digit a row, go to one task. The rows stay in their blocks and pick their new class up by number.
    """
    known = F.greatest(F.coalesce(F.col(cls), F.lit(0)), F.lit(0)).cast("int")
    digit = F.when(known <= 4, known.cast("string")).otherwise(F.raise_error(F.lit("a class over 4 has no quota")).cast("string"))
    blocks = OrderedBlocks.of(rows, keys, [order]).extend({"_rn": ("sum", F.lit(1).cast("long"), True)}).rows
    ordered = F.array_sort(F.collect_list(F.struct("_rn", digit.alias("d"))))
    packed = blocks.groupBy(*keys, BLOCK).agg(F.min("_rn").alias("_first"), F.array_join(F.transform(ordered, lambda x: x["d"]), "").alias("_digits"))
    wanted = packed.join(quotas.select(*keys, "quota"), keys, "left")
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_rn", T.LongType()), T.StructField("_new", T.IntegerType())])
    moved = wanted.groupBy(*keys).applyInPandas(lambda g: _moved(g, keys), schema)
    return blocks.join(moved, [*keys, "_rn"], "left").withColumn(cls, F.coalesce("_new", known).cast(rows.schema[cls].dataType)).select(*rows.columns)
