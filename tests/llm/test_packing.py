"""Packing against plain tokenization, and the placement rules."""

import zlib
from collections import Counter

import numpy as np
import pytest

from rainrisk.llm import packing
from rainrisk.llm.catalog import tokenizer_path

SCHEMA = "doc_id long, text string, offset int"
TEXTS = [None, "", "  \n ", "Hello wörld, it's <|endoftext|> ok", "日本語　テスト a\xa0b", "İ W̊ ﬁ ẞ don't I'LL " * 50, "word " * 6000, "x" * 9000, *(f"text {i} " * (i * 7 % 300 + 1) for i in range(60))]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_and_sequences(spark, tokenizer):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "no key", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.packed(docs, tokenizer_path(), with_ids=True)
    have = got.collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    pieces = Counter((r["doc_id"], r["start"]) for r in have)
    for r in have:
        own = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], dtype="<u4")
        assert len(own) == r["length"] <= 2048 and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["ids"] == own.tolist()
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, t, _ in rows:
        assert all(pieces[i, a] == (2 if i == 3 else 1) for a in range(0, len(ids[i]), 2048))
    assert sum(r["length"] for r in have) == sum(len(ids[i]) for i, _, _ in rows)
    by_sequence = {}
    for r in have:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(got).collect()
    assert len(whole) == len(by_sequence) and sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in have)


def test_coder_equals_whole_texts(tokenizer):
    import random

    coder, rnd = packing.WordIds(tokenizer_path()), random.Random(2)
    odd = ["".join(chr(rnd.choice([rnd.randrange(1, 0x180), rnd.randrange(32, 127), 32, rnd.randrange(0x300, 0x370), rnd.randrange(0x370, 0x2000)])) for _ in range(40)) for _ in range(500)]
    for t in odd + [x or "" for x in TEXTS[:8]] + ["A<|startoftext|>B <|ENDOFTEXT|> <|endoftext|>"]:
        assert np.frombuffer(next(coder.encode_all([t])), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_memory_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    coder = packing.WordIds(tokenizer_path())
    for i in range(50):
        t = f"alpha{i} beta gamma{i // 2} delta " + "long" * 30
        assert np.frombuffer(next(coder.encode_all([t])), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_patterns_hold_the_histogram():
    rnd = np.random.default_rng(4)
    for sizes in (rnd.integers(1, 2049, 3000), rnd.geometric(0.004, 5000).clip(1, 2048), np.full(1000, 700), np.array([2048, 2048, 1])):
        histogram = dict(Counter(map(int, sizes)))
        packs = packing.patterns(histogram)
        held = Counter()
        for n, lengths in packs:
            assert n > 0 and sum(lengths) <= 2048
            for x in lengths:
                held[x] += n
        assert held == histogram
    # many short pieces leave little room empty
    histogram = dict(Counter(map(int, rnd.geometric(0.004, 5000).clip(1, 2048))))
    packs = packing.patterns(histogram)
    assert sum(n for n, _ in packs) * 2048 <= 1.02 * sum(k * v for k, v in histogram.items()) + 2048
    rows = packing.places(histogram)
    for size, n in histogram.items():
        spans = sorted((a, c) for s, a, c, _, _ in rows if s == size)
        assert spans[0][0] == 0 and all(a + c == b for (a, c), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == n


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
