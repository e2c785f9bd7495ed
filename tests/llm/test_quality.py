"""Quality rules against a plain count."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from rainrisk.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


PROSE = ("the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been "
         "river stone window garden market letter winter summer engine bottle ladder mirror pocket basket corner ").split()


def prose(seed, n=120):
    return " ".join(PROSE[(seed * 31 + i * i * 7 + i // 5) % len(PROSE)] + str(i % 7 == 0 and "." or "") for i in range(n))


TEXTS = [None, "", " \t\n\x0b\f\r", "one", "a b", "a b c", "a b c a b c", "x " * 60, "é à ü 日本 😀 a b c\nline\nline\n \nline\r\n", "z z z z q q q q",
         "#*$%&|<> [](){}\\ | a", "w" * 5000, " ".join(f"v{i % 900}" for i in range(4000)), "1 2 3 4 1 2 3 5 2 3 4"] + [prose(i) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 5 else None, "s") for i, t in enumerate(TEXTS)] + [(3, "one", "en", None), (3, "one", "en", None), (None, prose(3), "zz", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_base_rules(docs):
    for r in quality.base_rules(docs).collect():
        assert tuple(r[c] for c in quality.BASE) == plain(r["text"])


def test_texts_decide_where_hashes_clash(docs):
    """The exact way behind the hashes gives the same positions."""
    rows = quality.base_rules(docs).where("size(_words) > 2").select("text", "n_repeat_words", F.expr(quality._BY_TEXT).alias("at"))
    for r in rows.collect():
        assert len({p + d for p in r["at"] for d in range(3)}) == r["n_repeat_words"]


def test_verdicts(spark, docs):
    marks = "%%% $$$ ### &&&".split()
    odd = [(100, " ".join(w + marks[i % 4] for i, w in enumerate(prose(1).split())), "en", "s"), (101, prose(2).upper().replace(" ", "!! "), "en", "s")]
    got = {r["doc_id"]: r for r in quality.judged(docs.union(spark.createDataFrame(odd, SCHEMA))).collect()}
    assert not got[100]["kept"] and not got[101]["kept"]
    assert not got[100]["base_failed"]
    # prose stays; without a language or reference only the base rules count
    for i in range(14, 44):
        assert got[i]["kept"]
        assert (got[i]["char_distance"] is None) == (i % 5 == 0)
    assert got[None]["kept"] and not got[0]["kept"] and not got[1]["kept"]


def test_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([1, 1], [1, 1]), ([1, 0], [0, 3]), ([3, 1], [1, 3])], "p array<bigint>, q array<bigint>")
    d = [r[0] for r in df.select(quality.js_distance("p", "q")).collect()]
    assert d[0] == 0 and d[1] == 1 and abs(d[2] - 0.4344) < 1e-3


def test_passing_keeps_columns(spark, docs):
    extra = docs.withColumns({"kept": F.lit("x"), "n_words": F.lit(1), "_in0": F.lit(2)})
    out = quality.passing(extra)
    assert out.columns == extra.columns
    want = sum(1 for r in quality.judged(docs).collect() if r["kept"])
    assert out.count() == want and out.select("kept").distinct().collect()[0][0] == "x"


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(empty).count() == 0 and quality.passing(empty).count() == 0


def test_words_without_prose_are_judged(spark):
    """Word tables and texts of another language go although they hold no common words; prose and short texts stay."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("bcdfghklmnprst", k=3)) + rnd.choice("aeiou")
    text = lambda code, n: " ".join(rnd.choice(quality.COMMON_WORDS[code]) if code and i % 4 == 0 else word() for i in range(n))
    tables, foreign, english = [text(None, 300) for _ in range(3)], text("de", 300), [text("en", 240) for _ in range(19)]
    rows = [*enumerate(english), *((100 + i, t) for i, t in enumerate(tables)), (200, foreign), (300, " ".join(tables[0].split()[:90]))]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    for i in (100, 101, 102, 200):
        assert got[i]["word_distance"] > quality.Limits().word_distance and not got[i]["kept"]
    assert all(got[i]["kept"] for i in range(19)) and got[300]["word_distance"] is None


def test_limits_on_labelled_rows(spark):
    """Judged texts of quality 0 go, those of quality 1 stay."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("word_distance IS NOT NULL AND NOT base_failed")
    counts = {(r["quality"], r["word_distance"] <= quality.Limits().word_distance) for r in got.collect()}
    assert counts == {(0, False), (1, True)}
