"""Trie nodes against plain dictionaries over all prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from rainrisk.llm import catalog, trie

SCHEMA = "conv_id long, turn long, role string, text string, head string, n long"


def plain(rows):
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    below, kids, leaves, saved = list(members), collections.Counter(), collections.Counter(), collections.Counter()
    for seq in below:
        if seq:
            kids[seq[:-1]] += 1
    for seq in below:
        value = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += value
            leaves[seq[:d]] += kids[seq] == 0
    digest = lambda seq: hashlib.sha256(",".join(map(str, sorted(ends[seq]))).encode()).hexdigest() if seq in ends else trie.EMPTY
    return sorted((min(members[s]), len(s), min(members[s[:-1]]) if s else -1, len(members[s]), kids[s], leaves[s], saved[s], digest(s)) for s in below)


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def conversations(n, words=3, most=9, seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if rnd.random() < 0.9:
            rows += [(c, t, rnd.choice(["user", "assistant"]), "é" * rnd.randrange(words), "x", 1) for t in range(rnd.randrange(1, most))]
    return rows


@pytest.mark.parametrize("limit", [50_000, 300, 20, 1])
def test_same_as_plain_prefixes(spark, limit):
    rows = conversations(150)
    # copies, a long chain, and one long conversation of its own
    rows += [(c, t, "user", f"copy {t}", "x", 1) for c in range(1000, 1040) for t in range(6)]
    rows += [(2000, t, "user", f"long {t}", "x", 1) for t in range(120)] + [(2005, t, "user", f"long {t}" if t < 100 else f"other {t}", "x", 1) for t in range(110)]
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA), limit=limit)) == plain(rows)


def test_nulls_ties_and_turnless(spark):
    rows = [(7, None, None, None, None, None), (7, None, "a", None, None, None), (7, 1, "a", "b", None, None), (7, 1, "a", "b", None, None), (7, 1, None, "q" * 200_000, None, None)]
    rows += [(7, 3, "a", t, None, None) for t in ("y", "x", "y", "z", "")]
    rows += [(None, 1, "user", "nobody's", None, None), (3, 1, "user", "one", None, None), (-4, 2, "user", "", None, None)]
    want = plain(rows)
    assert any(r[1] == 0 and r[7] != trie.EMPTY for r in want)
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA))) == want
    assert got(trie.trie(spark.createDataFrame(rows, SCHEMA), limit=2)) == want


def test_empty(spark):
    assert got(trie.trie(spark.createDataFrame([], SCHEMA))) == []


def test_query_on_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.op13_trie(spark, "/root/testdata/sf0.01")) == plain(rows)
