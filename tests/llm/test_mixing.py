"""Targets and budget filling against plain versions."""

import random
import re
import tracemalloc

import pytest

from rainrisk.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        goal = {s: 2 * sizes[s] if s in full else left * w[s] / sum(w[o] for o in open_) for s in names}
        over = {s for s in open_ if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        full |= over


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "Z", "é", "😀", "", None, "b"])
        out.append((i, " ".join(["w"] * int(rnd.expovariate(1 / 40))), source, "x"))
    return out + [(900, None, "a", None), (901, "", "a", None), (902, " \t", "only-empty", None), (5, out[5][1], out[5][2], "x"), (None, "k " * 30, "b", None)]


def test_mix(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, source_of = plain_targets(sizes), {i: s for i, _, s, _ in data}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r["_in0"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 or sizes[s] == 0
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((str(r["_in0"]), r["taken"]) for r in got) == sorted((str(r["_in0"]), r["taken"]) for r in again)


def test_repeated_rows_of_the_mix(spark):
    docs = spark.createDataFrame(rows(2), SCHEMA)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["taken"] // r["size"] for r in mixing.mixed(docs).collect() if r["size"])


def test_one_hot_size(spark):
    """Copies of one size and source are chosen one by one, not all or none."""
    docs = spark.createDataFrame([(i, "w w w", "a" if i < 900 else "b", "x") for i in range(1000)], SCHEMA)
    got = mixing.mixed(docs).collect()
    for source in (range(900), range(900, 1000)):
        own = [r for r in got if r["_in0"] in source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_fill_is_exact_where_it_can_be():
    rnd = random.Random(9)
    for _ in range(50):
        counts = [(s, rnd.randrange(1, 30)) for s in rnd.sample(range(1, 200), rnd.randrange(1, 25))] + [(0, 5)]
        total = sum(s * n for s, n in counts)
        budget = rnd.randrange(total + 1)
        taken = mixing.fill(counts, budget)
        have = sum(s * k for s, k in taken.items())
        assert have <= budget and all(0 <= taken.get(s, 0) <= n for s, n in counts if s)
        if (1, 1) in counts or any(s == 1 for s, _ in counts) and len(counts) > 10:
            assert budget - have <= max(s for s, _ in counts)
    brute = {a * 7 + b * 5 + c * 3 for a in range(4) for b in range(3) for c in range(2)}
    for budget in range(40):
        assert sum(s * k for s, k in mixing.knapsack([(7, 3), (5, 2), (3, 1)], budget).items()) == max(x for x in brute if x <= budget)


def test_memory_of_the_plan_follows_the_budget():
    """Many sizes beside one very long text: no copy of all sums per step."""
    counts = [(s, 1) for s in range(2, 6000, 2)] + [(1_500_000, 2)]
    budget = sum(s * n for s, n in counts) * 3 // 5
    tracemalloc.start()
    taken = mixing.fill(counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert budget - 1 <= sum(s * k for s, k in taken.items()) <= budget and all(k <= dict(counts)[s] for s, k in taken.items())
    assert peak < 64_000_000


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.repeated(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None), (2, "", "a", None)], SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.mixed(nothing).collect()] == [(0.0, 0)] * 2
