"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget; whole documents fill it. A budget takes all documents of its source as often as they fit,
and a part of them once more. The part is planned on the histogram of exact sizes: each size gives the same
share of its documents, largest remainders first, and a bounded-knapsack program spends the last words on single
documents. Within a size, documents are chosen by a seeded hash, so reruns agree and no order of rows matters.

Defined cases: a null text has size 0 and is never needed; a null source is a source of its own and comes last. Sources
without words have target 0. Repeated rows are documents of their own; equal ones are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import found_again, identified, ranked, stored, with_row_id, words
from rainrisk.operators.scale import numbered


#: Words that the exact program spends; below, single documents are taken by remainder. At least two documents of the largest size.
EXACT = 200_000


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code-point order; the budget is a share of all words; ``most`` bounds repeats."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: int = 17


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Add ``target`` to rows of (source, source_size): shares by weight, none above ``most`` times its size.

    The excess of full sources is shared again among the others until none is above. Each round is one aggregate over the sources.
    """
    # null comes last, the others by code point
    rows = sources.withColumns({"_one": F.lit(1), "_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    rows = numbered(rows, ["_one"], ["_last", "_name"], "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod(F.col("_at") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    rows = stored(rows.select("source", "source_size", weight.alias("_w"), (F.lit(float(mix.most)) * F.col("source_size")).alias("_cap")))
    rate, full = 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(rate) * F.col("_w")
        total, spent, open_weight, n_full = rows.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))),
            F.sum(over.cast("long"))).first()
        if n_full is None or n_full == full or not open_weight:
            break
        full, rate = n_full, max(rate, (min(mix.share, float(mix.most)) * total - spent) / open_weight)
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.lit(rate) * F.col("_w")).alias("target"))


def fill(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that their words come as close to ``budget`` as possible from below.

    ``counts`` holds (size, documents). Proportional shares first, then single documents by largest remainder, long ones first, until
    ``EXACT`` words or two documents of the largest size are left of the budget, which an exact knapsack spends.
    """
    counts = [(s, n) for s, n in counts if s > 0]
    total = sum(s * n for s, n in counts)
    if budget >= total:
        return dict(counts)
    taken = {s: n * budget // total for s, n in counts}
    left = budget - sum(s * k for s, k in taken.items())
    reserve = max(EXACT, 2 * max(s for s, _ in counts))
    for s, n in sorted(counts, key=lambda c: (-(c[1] * budget % total), -c[0])):
        if left - s < reserve:
            break
        if taken[s] < n:
            taken[s], left = taken[s] + 1, left - s
    for s, k in knapsack([(s, n - taken[s]) for s, n in sorted(counts)], left).items():
        taken[s] += k
    return taken


def knapsack(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Bounded subset sum: the reachable sums are the bits of one integer, copies of a size are added in binary portions.

    Of every sum the step that reached it first is kept, four bytes whatever the number of steps.
    """
    reach, steps, mask = 1, [], (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, dtype=np.int32)
    for s, n in counts:
        n, portion = min(n, budget // s), 1
        while n > 0:
            k = min(portion, n)
            after = (reach | reach << (s * k)) & mask
            if after != reach:
                fresh = np.frombuffer((after ^ reach).to_bytes(8 * (budget // 64 + 1), "little"), dtype="<u8")
                used = np.flatnonzero(fresh)
                word, bit = np.nonzero(np.unpackbits(fresh[used].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                first[used[word] * 64 + bit] = len(steps)
                steps.append((s, k))
                reach = after
            n, portion = n - k, portion * 2
        if reach >> budget & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    while at:
        s, k = steps[first[at]]
        taken[s], at = taken.get(s, 0) + k, at - s * k
    return taken


def _plan(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    counts = list(zip(pdf["size"].tolist(), pdf["n"].tolist()))
    total, target = sum(s * n for s, n in counts), float(pdf["target"].iloc[0])
    whole = min(int(target // total), most) if total else 0
    part = fill(counts, round(target) - whole * total) if whole < most else {}
    return pdf.assign(whole=whole, part=[part.get(s, 0) for s, _ in counts])[["_s", "_null", "size", "whole", "part"]]


def mixed(docs: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` as ``_in0``, ``_in1``, ..., then size, source_size, target and taken for every row of ``docs``.

    Texts are read once for their sizes. The plan of a source is one task over its histogram: a row per distinct size, at most the
    square root of twice its words.
    """
    carried = [F.col(c).alias(f"_in{i}") for i, c in enumerate(keep)]
    rows = stored(with_row_id(docs.select(*carried, F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"),
                                          F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(mix.seed), *keep, "text").alias("_h"))))
    histogram = stored(rows.groupBy("_s", "_null", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = histogram.groupBy("_s", "_null").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sizes.select(F.when(~F.col("_null"), F.col("_s")).alias("source"), "source_size"), mix).withColumns(
        {"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    most = mix.most
    plan = (histogram.join(goals, ["_s", "_null"]).groupBy("_s", "_null")
            .applyInPandas(lambda pdf: _plan(pdf, most), "_s string, _null boolean, size long, whole long, part long"))
    plan = stored(plan.join(goals, ["_s", "_null"]))
    out = ranked(rows, ["_s", "_null", "size"], "_h", "_rank", plan.drop("source"))
    # the first ``part`` documents of a (source, size) in hash order are taken once more than the others
    taken = F.col("size") * (F.col("whole") + (F.col("_rank") < F.col("part")).cast("long"))
    return out.select(*[f"_in{i}" for i in range(len(keep))], "size", "source_size", "target", taken.alias("taken"))


def repeated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` as the mix takes them: a row per take, all columns kept, documents that are not taken left out.

    Empty documents carry no words and are left out as well. The plan is made on row identities; texts are read again and move once at most.
    """
    slim = identified(docs).select("_a", "_b", "_row.source", "_row.text")
    takes = mixed(slim, mix, ("_a", "_b")).groupBy(F.col("_in0").alias("_a"), F.col("_in1").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.expr("taken div greatest(size, 1)")).alias("_takes"))
    out = found_again(docs, stored(takes.where("_takes > 0")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_takes")))).select("_row.*")
