"""SimHash groups and connected components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rainrisk.llm import simhash
from rainrisk.llm.graph import components

SCHEMA = "doc_id long, text string"


def plain(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n", "One", "one  TWO", "ONE two", "É é à", "a b c d e f g"]
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(200)) for _ in range(400)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"x{i}"
        out.append(" ".join(w))
    return out + ["word " * 30_000, " ".join(map(str, range(20_000)))] + [f"doc {i} " * (i % 3 + 1) for i in range(40)]


def test_fingerprints_and_components(spark):
    rows = list(enumerate(texts())) + [(9, texts()[9]), (None, texts()[8]), (None, "alone without key q r s t u")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = {i: plain(t) for i, t in rows if i is not None}
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in got if r["doc_id"] is not None)
    ids = sorted(prints)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    null = {int(r["fingerprint"], 16): r["component_id"] for r in got if r["doc_id"] is None}
    assert null[plain(texts()[8])] == want[8] and null[plain("alone without key q r s t u")] is None


@pytest.mark.parametrize("crowd", [1, 3, 128])
def test_crowded_keys_lose_no_link(spark, crowd):
    """Fuller keys go another way, which gives the same groups."""
    rnd = random.Random(crowd)
    values = {rnd.getrandbits(64) for _ in range(50)}
    for centre in list(values)[:6]:
        for _ in range(40):
            v = centre
            for _ in range(rnd.randrange(6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowd).collect()
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert {(min(r), max(r)) for r in map(tuple, links)} <= set(close)
    assert groups(signed, [tuple(r) for r in links]) == groups(signed, close)


def test_components(spark):
    rnd = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [tuple(map(int, p)) for p in rnd.integers(2000, 2400, (150, 2))]
    links = chain + star + loose + [(5, 5), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({n for p in links for n in p}, links)
    same = {}
    for n, r in got.items():
        assert same.setdefault(want[n], r) == r
    assert len(set(same.values())) == len(same)
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
