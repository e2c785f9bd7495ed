"""Spot signatures against a plain reading of the rule, edited texts against plain slices."""

import hashlib
import re

import pytest

from rainrisk.llm import catalog, spotsigs
from tests.llm.test_simhash import groups

SCHEMA = "doc_id long, text string, key string, part int, fingerprint string"


def plain(text, chain=2, gap=8):
    """Set of (anchor, following content words)."""
    words = [w.strip(".,;:!?'\"()[]{}-") or w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    anchors, out = {a.decode() for a in spotsigs.ANCHORS}, set()
    far, after = [], []
    for w in words:
        far.append(0 if w in anchors else (far[-1] if far else 0) + 1)
    for w in reversed(words):
        after.append(([w] if w not in anchors else []) + (after[-1] if after else []))
        after[-1] = after[-1][:chain + 1]
    for i, w in enumerate(words):
        nxt = after[len(words) - i - 2][:chain] if i + 1 < len(words) else []
        if nxt and (w in anchors or far[i] > gap):
            out.add((w, *nxt))
    return out or ({("", *words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (d, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[:len(text) - len(text) // 2] + nxt[:len(text) // 2]
        a, b, c = plain(text), plain(edited), plain(nxt)
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    have = [(r[0], r[1], r[2], len(r[3]) // 16, len(r[4]) // 16, round(r[5], 9), round(r[6], 9)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 22, 300])
def test_cases(spark, part_bytes):
    texts = [None, "", " \n\t", "the", "The cat sat on the mat, and the dog lay by the door.", "a b c d e f g h i j k l m n o p q r s t u", "wort " * 40, "der Hund und die Katze",
             "Ünder the bridge: of time", "| x | y | z |" * 30, "the of and to in", "é" * 500, "the " + "long word " * 30_000]
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(10, "the tie one"), (10, "the tie one"), (10, "a tie two"), (None, "the null key"), (None, None)]
    docs = spark.createDataFrame([(*r, "k", 7, "f") for r in rows], SCHEMA)
    got = spotsigs.fingerprinted(docs, part_bytes=part_bytes).collect()
    check(got, rows)
    prints = {}
    for r in got:
        assert re.fullmatch("([0-9a-f]{16})*", r["fingerprint"])
        prints.setdefault(dict(rows).get(r["doc_id"]), set()).add(r["fingerprint"])


def test_one_row_and_no_row(spark):
    check(spotsigs.fingerprinted(spark.createDataFrame([(1, "the cat of a house", "", 1, "")], SCHEMA)).collect(), [(1, "the cat of a house")])
    assert spotsigs.fingerprinted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.op11_spotsigs(spark, sf).collect()
    check(got, rows)
    text = dict(rows)
    assert len({r["fingerprint"] for r in got}) > 0.9 * len({" ".join((text[r["doc_id"]] or "").lower().split()) for r in got})
    assert sum(r["near_edited"] for r in got) > 2 * sum(r["near_next"] for r in got)


def test_pruned_likeness():
    import numpy as np
    rnd = np.random.default_rng(3)
    for _ in range(300):
        base = rnd.integers(0, 2**64, rnd.integers(1, 60), dtype=np.uint64)
        other = np.concatenate([base[rnd.integers(0, len(base)):], rnd.integers(0, 2**64, rnd.integers(0, 20), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        true = jaccard(set(a.tolist()), set(b.tolist()))
        for least in (0.0, 0.5, 0.8):
            assert spotsigs.likeness(a, b, least) == (true if true >= least or not least else spotsigs.likeness(a, b, least)) and (true < least or spotsigs.likeness(a, b, least) == true)


def test_near_duplicates(spark):
    """Components of all pairs at or above the limit, lengths around the borders of partitions included."""
    import random
    rnd = random.Random(5)
    content = lambda: "".join(rnd.choices("bcdfghklm", k=5))
    texts = [None, "", "the", "the cat"]
    for size in (5, 12, 40, 200):
        base = [w for _ in range(size) for w in ("the", content(), content())]
        for cut in range(0, 8):
            w = base[:len(base) - 3 * (size * cut // 20)]
            for _ in range(rnd.randrange(1 + size // 8)):
                w = [*w, "of", content()] if rnd.random() < 0.5 else [x if rnd.random() > 0.02 else content() for x in w]
            texts += [" ".join(w)] * rnd.choice([1, 2])
    ids = list(range(len(texts)))
    marks = [plain(t) for t in texts]
    close = [(a, b) for a in ids for b in ids if a < b and jaccard(marks[a], marks[b]) >= 0.8]
    want = groups(ids, close)
    got = spotsigs.near_duplicates(spark.createDataFrame([(i, t, "k", 0, "f") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(texts)
    assert len(set(want.values())) < len(ids) - 10
    assert spotsigs.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
