"""Manifest and proofs against a plain tree over all rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainrisk.llm import catalog, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"
LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text, lang, source, n):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """Expected rows in any order: every tree as lists of levels, every proof by walking them."""
    order = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {x: sorted(((r[0], leaf(*r[:5]), r) for r in rows if r[2] == x), key=lambda t: (order(t[0]), t[1])) for x in langs}
    inner = {x: levels([t[1] for t in trees[x]]) for x in langs}
    outer, out = levels([inner[x][-1][0] for x in langs]), []
    for k, x in enumerate(langs):
        for i, (d, own, r) in enumerate(trees[x]):
            proof, node = [], own
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and r[1] is not None:
                node = leaf(d, r[1].translate(LOWER), *r[2:5])
            for tree, at in ((inner[x], i), (outer, k)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    proof += run[:at % 8] + run[at % 8 + 1:]
                    node, at = h(*run[:at % 8], node, *run[at % 8 + 1:]), at // 8
            out.append((d, own, inner[x][-1][0], outer[-1][0], h(*proof), node, node == outer[-1][0]))
    return sorted(out, key=str)


def got(docs, **how):
    out = merkle.proven(docs, claimed=merkle.tampered(F.crc32(F.col("doc_id").cast("string")) % 3 == 0), **how)
    return sorted((tuple(r)[:7] for r in out.collect()), key=str)


@pytest.mark.parametrize("part", [4096, 50, 7])
def test_same_as_plain_tree(spark, part):
    rows = [(i, f"Text {i} É", "ab"[i % 7 == 0], f"s{i % 5}", i, "x", 1) for i in range(700)]
    rows += [(1000 + i, "T" * i, f"lang{i}", None, i, None, None) for i in range(80)]
    assert got(spark.createDataFrame(rows, SCHEMA), part=part) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None, "x", 1)] * 3 + [(5, "A", None, "s", 1, "x", 1), (5, "B", None, "s", 1, "x", 1), (5, "B", None, "s", 1, "y", 2)]
    rows += [(6, "", "é", "", 0, None, None), (None, "Q" * 300_000, "z", "s", 0, None, None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_one_row_and_no_row(spark):
    rows = [(3, "Upper", "en", "s", 5, None, None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_fewest_coordinates():
    """Nothing fetched can be derived, and nothing else is needed, for any set of leaves."""
    rnd = np.random.default_rng(1)
    for n in (1, 2, 8, 9, 64, 65, 600):
        tree = levels([h(str(i)) for i in range(n)])
        for size in {1, n // 3, n} - {0}:
            have = np.sort(rnd.choice(n, size, replace=False))
            ask = merkle.missing(have, n)
            assert len(set(ask)) == len(ask) and not any((have // 8 ** level == i).any() for level, i in ask)
            paths = merkle.Paths({int(i): tree[0][i] for i in have}, {(v, i): tree[v][i] for v, i in ask}, n)
            assert paths.top == tree[-1][0]


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    out = catalog.op12_merkle(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r)[:7] for r in out.collect()), key=str) == plain(rows)
    assert 0 < out.where("NOT verified").count() < len(rows)
