"""Language-model scores: exact base, proper probabilities, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rainrisk.llm import scoring

SCHEMA = "doc_id long, text string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + ["\n"]


def corpus(n=700):
    rnd = random.Random(3)
    parts = {"en": ("the", "of", "and", "was", "rain", "ing", "er", "st", "on"), "de": ("der", "und", "nicht", "ein", "sch", "ung", "ber", "keit", "auf")}
    out = []
    for i in range(n):
        words = parts["en" if i % 2 else "de"]
        out.append(" ".join(rnd.choice(words) if rnd.random() < 0.6 else "".join(rnd.choice(words) for _ in range(2)) + rnd.choice(["", ".", ","]) for _ in range(rnd.randrange(5, 80))))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())] + [(1000, None, None), (1001, "", None), (1002, "É zz\x00q 日本 \t THE", None), (1003, "y" * 5000, None), (3, corpus()[3], "x"), (None, "the rain", None)]
    return rows, scoring.scored(spark.createDataFrame(rows, SCHEMA)).collect()


def test_base(scored):
    rows, got = scored
    assert len(got) == len(rows)
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _, _ in rows}
    c = Counter()
    for i, t, _ in rows:
        if fold[i] != 2:
            c.update(tokens(t))
    n, v, text_of = sum(c.values()), len(c), {i: t for i, t, _ in rows}
    for r in got:
        own = tokens(text_of[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[r["doc_id"]] == 2, len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / r["n_bytes"])


def test_held_out_texts_gain(scored):
    _, got = scored
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(held) > 50 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_spelled_probabilities_sum_to_one():
    """Whatever the counters say, all next bytes together have probability one."""
    rng = np.random.default_rng(2)
    speller = scoring.Speller(rng.random(256) * 1000)
    tables = rng.integers(0, 50, (2, len(scoring.ORDERS), scoring.SLOTS)).astype(np.float32)
    mixer = scoring.Mixer()
    mixer.weights += rng.normal(0, 0.2, mixer.weights.shape)
    texts = [bytes([b]) for b in range(256) if b not in (0x0A, 0x20)]
    owner, bit, slots, gate = speller.decisions(texts)
    p = mixer.refined(mixer.inputs(*scoring._looked_up(tables, slots)), gate)
    cost = np.where(bit, p, 1 - p)
    first = 0.0
    for i, t in enumerate(texts):
        own = np.flatnonzero(owner == i)[:speller.length[t[0]]]
        first += np.prod(cost[own])
    rest = 0.0
    for b in (b"\n",):
        owner, bit, slots, gate = speller.decisions([b])
        q = mixer.refined(mixer.inputs(*scoring._looked_up(tables, slots)), gate)
        rest += np.prod(np.where(bit, q, 1 - q))
    # a space cannot start a token, its share is lost
    assert 0.9 < first + rest < 1.0


def test_mixer_learns():
    rng = np.random.default_rng(5)
    mixer = scoring.Mixer()
    bit = rng.random(40_000) < 0.8
    all_ = np.full((len(scoring.ORDERS), len(bit)), 100.0, np.float32)
    ones = np.where(rng.random(all_.shape) < 0.5, 80, 50).astype(np.float32)
    gate = np.zeros(len(bit), np.int32)
    x = mixer.inputs(ones, all_)
    before = mixer.refined(x, gate)
    for a in range(0, len(bit), 2000):
        mixer.learn(x[:, a:a + 2000], gate[a:a + 2000], bit[a:a + 2000].astype(float), np.ones(2000))
    after = mixer.refined(x, gate)
    cost = lambda p: -np.log(np.where(bit, p, 1 - p)).mean()
    assert cost(after) < cost(before)


def test_empty_and_all_held_out(spark):
    assert scoring.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = scoring.scored(spark.createDataFrame([(held, "new words", None)], SCHEMA)).collect()[0]
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0.0) and r["score"] < 0


def test_counts_follow_the_texts(spark):
    """Every byte of the training texts is counted after the five before it, over the borders of tokens, whatever the portions."""
    rows = [(i, t, "x") for i, t in enumerate(corpus(60))] + [(100, None, None), (101, " A\x01b  é ", None)]
    want, weights = Counter(), Counter()
    for i, t, _ in rows:
        data = b"\x01" * 5 + b"".join((w if w == "\n" else w + " ").encode() for w in tokens(t))
        for at in range(5, len(data)):
            want[int.from_bytes(data[at - 5:at + 1], "big")] += zlib.crc32(str(i).encode()) % 7 != 2
            weights[data[at]] += zlib.crc32(str(i).encode()) % 7 != 2
    blocks = scoring.stored(scoring.encode_blocks(spark.createDataFrame(rows, SCHEMA).repartition(3), "doc_id", 8))
    grams = scoring.gram_counts(blocks)
    assert {r["gram"]: r["total"] for r in grams.collect()} == want
    assert dict(enumerate(scoring.byte_weights(grams))) == {b: weights[b] for b in range(256)}
    ids = np.array([1, 2, 0, 0, 2, 1, 0])
    whole = [np.concatenate([g for _, _, g in scoring.text_grams(ids, np.array([0, 3, 4]), [b"\n", b"a ", b"long "], size)]) for size in (1, 2, 3, 100)]
    assert all(np.array_equal(whole[0], x) for x in whole)


def test_word_order_counts(spark):
    """The same words in another order score apart, passages of the training texts higher."""
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ber", "dor", "fel", "gan", "hum")]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    shuffled = " ".join(rnd.sample(passage.split(), 60))
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [passage if n % 10 == 0 else " ".join(rnd.choice(words) for _ in range(60)) for n in range(len(train))]
    rows = [*zip(train, texts, texts), (held[0], passage, None), (held[1], shuffled, None)]
    got = {r["doc_id"]: r for r in scoring.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a["base_score"] == pytest.approx(b["base_score"]) and a["n_bytes"] == b["n_bytes"]
    assert a["score"] > b["score"] + 5


def test_shares_follow_each_text():
    """The mix along a text against plain loops; what comes later does not change what came before."""
    rng = np.random.default_rng(4)
    sizes = np.array([1, 5, 40])
    starts = np.cumsum(sizes) - sizes
    logs = np.log(rng.random((4, 46)))
    logs[:3, rng.random(46) < 0.3] = -np.inf
    got = scoring.followed(logs, starts, sizes)
    for a, n in zip(starts, sizes):
        shares = [[0.25] * 4 for _ in range(n)]
        for _ in range(scoring.ROUNDS):
            past, later = [scoring.EVEN / 4] * 4, []
            for t in range(n):
                part = [s * math.exp(x) for s, x in zip(shares[t], logs[:, a + t])]
                later.append([p / sum(past) for p in past])
                past = [p + x / sum(part) for p, x in zip(past, part)]
            shares = later
        for t in range(n):
            assert got[a + t] == pytest.approx(math.log(sum(s * math.exp(x) for s, x in zip(shares[t], logs[:, a + t]))))
    cut = logs.copy()
    cut[:, 30:] = -3.0
    assert np.allclose(scoring.followed(cut, starts, sizes)[:30], got[:30])


def test_finder():
    rng = np.random.default_rng(6)
    known = rng.permutation(np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64)))
    at = rng.integers(0, len(known), 20_000)
    assert np.array_equal(scoring.Finder(known).find(known[at]), at) and scoring.Finder(known[:1]).find(known[:1]).tolist() == [0]


def test_grams_are_spelled_once():
    """Kept logarithms against spelling every gram anew, with grams that share slots and come again."""
    rng = np.random.default_rng(7)
    spells = scoring.Spells(scoring.Speller(rng.random(256) * 1000), rng.integers(0, 50, (2, len(scoring.ORDERS), scoring.SLOTS)).astype(np.float32), scoring.Mixer())
    grams = rng.integers(0, 2**48, 4000, dtype=np.uint64)
    for size in (1, 7, 500, 4000):
        some = grams[rng.integers(0, size, 3000)]
        assert np.array_equal(spells.of(some), spells.spelled(some))
    assert spells.n == len(np.unique(spells.grams[:spells.n])) <= 4000


def test_grams_wait_for_further_blocks(spark, monkeypatch):
    """Blocks of one task share their rows of grams, whatever their number; no gram or count is lost."""
    rows = [(i, t, "x") for i, t in enumerate(corpus(200))]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)

    def read():
        blocks = scoring.stored(scoring.encode_blocks(docs, "doc_id", 4))
        kinds = Counter(r["part"] for r in blocks.select("part").collect())
        return kinds, {r["gram"]: r["total"] for r in scoring.gram_counts(blocks).collect()}

    kinds, whole = read()
    assert kinds[scoring.DOCS] == 1 and kinds[scoring.GRAMS] == 4
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 1000)
    kinds, several = read()
    assert kinds[scoring.DOCS] > 5 and kinds[scoring.GRAMS] == 4 and several == whole
    monkeypatch.setattr(scoring, "HELD_GRAMS", 500)
    kinds, passed_on = read()
    assert kinds[scoring.GRAMS] > 4 and passed_on == whole
