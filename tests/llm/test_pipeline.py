"""The pipeline stage by stage against brute force on the smallest table, and every query of the catalog."""

import collections
import math
import re

import pytest

import corpus_pipeline
from rainrisk.llm import catalog, mixing, quality, secrets
from rainrisk.llm.common import table
from tests.llm.test_mixing import plain_targets
from tests.llm.test_quality import plain as base_rules
from tests.llm.test_secrets import plain as base_secrets
from tests.llm.test_similar import wanted as similar_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        nxt = spark.read.parquet(path)
        out.append((docs, nxt))
        docs = nxt
    return [([r for r in a.collect()], [r for r in b.collect()], b.columns) for a, b in out]


def histograms(r):
    t = r["text"] or ""
    base = base_rules(t)
    upper, digit = sum(len(x) for x in re.findall(r"[^\W\d_a-zß-öø-ÿ]+", t) if x.isupper()), len(re.findall(r"\d", t))
    marks = len(re.findall(r"[.,;:!?'()\-]", t))
    chars = [upper, digit, marks, len(t) - base[1], base[2]]
    words = collections.Counter(w for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    common = [words[w] for w in quality.COMMON_WORDS.get(r["lang"], [])]
    return base, chars + [len(t) - sum(chars)], [base[0] - sum(common), *common]


def distance(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return None
    half = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(half(x / a, y / b) + half(y / b, x / a) for x, y in zip(p, q)) / 2))


def test_quality_stage(stages):
    docs, kept, columns = stages[0]
    assert columns == COLUMNS
    all_ = {r["doc_id"]: histograms(r) for r in docs}
    lang, limits, want = {r["doc_id"]: r["lang"] for r in docs}, quality.Limits(), set()
    sums = lambda code, i: [sum(x) for x in zip(*(h[i] for d, h in all_.items() if lang[d] == code and not h[0][5]))]
    reference = {code: (sums(code, 1), sums(code, 2)) for code in quality.COMMON_WORDS}
    for d, (base, chars, words) in all_.items():
        judge = lang[d] in reference and sum(chars) >= limits.min_chars and base[0] >= limits.min_words
        c = distance(chars, reference[lang[d]][0]) if judge else None
        w = distance(words, reference[lang[d]][1]) if judge and base[0] >= limits.min_judged else None
        if not base[5] and (c is None or c <= limits.char_distance) and (w is None or w <= limits.word_distance):
            want.add(d)
    assert {r["doc_id"] for r in kept} == want and len(kept) == len(want) < len(docs)
    assert {r["doc_id"]: r["text"] for r in kept}.items() <= {r["doc_id"]: r["text"] for r in docs}.items()


def test_near_dedup_stage(stages):
    docs, kept, columns = stages[1]
    assert columns == COLUMNS and sorted(r["doc_id"] for r in kept) == similar_groups([(r["doc_id"], r["text"]) for r in docs])
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs}


def test_secret_stage(stages):
    docs, out, columns = stages[2]
    assert columns == COLUMNS and len(out) == len(docs)
    before = {r["doc_id"]: r for r in docs}
    for r in out:
        spans = base_secrets(before[r["doc_id"]]["text"])
        assert not base_secrets(r["text"])
        assert r["n_chars"] == len(r["text"]) if spans else True
        if not spans and not re.search(secrets.BARE, before[r["doc_id"]]["text"]):
            assert r == before[r["doc_id"]]


def test_mixing_stage(stages):
    docs, out, columns = stages[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    total = collections.Counter()
    for r in docs:
        total[r["source"]] += size(r)
    want, got = plain_targets(dict(total)), collections.Counter()
    for r in out:
        got[r["source"]] += size(r)
    assert columns == COLUMNS and max(collections.Counter(r["doc_id"] for r in out).values()) <= mixing.Mix().most
    for s in total:
        # no other choice of documents comes closer from below
        whole, reach = int(want[s] // total[s]), 1
        for r in docs:
            if r["source"] == s:
                reach |= reach << size(r)
        part = round(want[s]) - whole * total[s]
        assert got[s] == whole * total[s] + (reach & ((1 << part + 1) - 1)).bit_length() - 1 or whole == 2


def test_packing_stage(stages):
    docs, out, columns = stages[4]
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    copies, pieces = collections.Counter(r["doc_id"] for r in docs), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == set(copies)
    for d, own in pieces.items():
        assert sum(n for _, n, _ in own) == copies[d] * own[0][2]


def test_no_rows(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[4][2] and out.count() == len(stages[4][1])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_cover_their_table(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    n = df.count()
    if name == "op8_packing":
        assert df.select("doc_id").distinct().count() == table(spark, SF, "documents").count()
    elif name == "op10_warc":
        assert n == 2 * table(spark, SF, "pages").count()
    elif name == "op13_trie":
        assert df.where("depth = 0").first()["n_convs"] == table(spark, SF, "conversations").select("conv_id").distinct().count()
    else:
        assert n == table(spark, SF, "embeddings" if name == "op6_vectors" else "documents").count()
