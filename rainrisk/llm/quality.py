"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with the reference of its language: a histogram of character classes and one of
common words and all others. References are the summed histograms of all documents of the language that pass the
base rules, so they follow the corpus. The distance is the square root of the Jensen-Shannon
divergence in bits (0 equal, 1 disjoint). Short histograms say little, so a distance only counts from a minimum length on.

Defined cases: null and empty texts have no words and fail the base rules. A document whose language is
null or has no word list or no reference is judged by the base rules alone. Repeated rows are
judged row by row. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rainrisk.llm.common import identified, stored, words

#: Common words of the languages that have a reference.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he are at".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}
#: Character classes that are rare in prose. White space and symbols come from the base rules, all else is the last bin.
CLASSES = (r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?'()\-]+")
N_CLASSES = len(CLASSES) + 3


@dataclass(frozen=True)
class Limits:
    """Production values. Distances above these reject; histograms below these sizes are not judged."""

    char_distance: float = 0.28
    word_distance: float = 0.26
    min_chars: int = 200
    min_words: int = 50
    #: words from which on the word distance counts; how many of them are common ones does not matter
    min_judged: int = 100


#: Hashes of the 3-word windows. Where none repeats, no window does; elsewhere the hashes get their position into the low
#: bits, so that one sort of plain longs brings equal windows together. Should two different windows clash there, the texts are sorted instead.
_HASHES = """CASE WHEN size(_words) < 3 THEN array() ELSE transform(arrays_zip(slice(_words, 1, size(_words) - 2), slice(_words, 2, size(_words) - 2),
    slice(_words, 3, size(_words) - 2)), w -> xxhash64(w)) END"""
_PACKED = "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN sort_array(transform(_hashes, (x, i) -> (x & ~_mask) | i)) ELSE array() END"
_CLOSE = """filter(_packed, (x, j) -> coalesce(shiftright(x, _bits) = shiftright(get(_packed, j - 1), _bits), false)
    OR coalesce(shiftright(x, _bits) = shiftright(get(_packed, j + 1), _bits), false))"""
_CLASH = """exists(transform(_close, (x, j) -> CASE WHEN shiftright(x, _bits) = shiftright(get(_close, j - 1), _bits)
        THEN struct(int(x & _mask) AS a, int(get(_close, j - 1) & _mask) AS b) END),
    p -> p IS NOT NULL AND NOT (_words[p.a] = _words[p.b] AND _words[p.a + 1] = _words[p.b + 1] AND _words[p.a + 2] = _words[p.b + 2]))"""
_BY_TEXT = """transform(array(sort_array(transform(sequence(0, size(_words) - 3),
        i -> struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS w, i AS i)))),
    s -> transform(filter(s, (x, j) -> coalesce(x.w = get(s, j - 1).w, false) OR coalesce(x.w = get(s, j + 1).w, false)), x -> x.i))[0]"""
_STARTS = f"""sort_array(CASE WHEN size(_close) = 0 THEN array() WHEN {_CLASH} THEN {_BY_TEXT}
    ELSE transform(_close, x -> int(x & _mask)) END)"""
_COVERED = "aggregate(transform(_starts, (x, j) -> least(3, coalesce(get(_starts, j + 1) - x, 3))), 0L, (a, x) -> a + x)"


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_rules(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; ``_words`` stays for later steps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (docs.withColumns({"_words": words(F.col("text")), "_lines": lines})
           .withColumn("_bits", F.expr("int(ceil(log2(size(_words) + 2)))")).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
           .withColumn("_hashes", F.expr(_HASHES)).withColumn("_packed", F.expr(_PACKED)).withColumn("_close", F.expr(_CLOSE)).withColumn("_starts", F.expr(_STARTS)))
    return (out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(_COVERED)})
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .drop("_lines", "_bits", "_mask", "_hashes", "_packed", "_close", "_starts"))


def char_histogram(text: Column) -> Column:
    """Code points per class, then white space, symbols and the rest; needs the base columns."""
    size = F.char_length(text).cast("long")
    counts = [size - F.char_length(F.regexp_replace(text, c, "")) for c in CLASSES]
    counts += [size - F.col("word_chars"), F.col("n_symbols")]
    return F.array(*counts, size - sum(counts[1:], counts[0]))


def common_string(found: str) -> Column:
    """The common words of any language in a text, each between bars, so that one byte search counts a word."""
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    return F.concat(F.lit("|"), F.array_join(F.filter(F.col(found), lambda w: w.isin(known)), "||"), F.lit("|"))


def word_histogram(bars: str, lang: str) -> Column:
    """Counts of all other words, then of the language's common ones; null without a word list. Needs the base columns."""
    def counts(ws: list[str]) -> Column:
        each = [((F.octet_length(bars) - F.octet_length(F.replace(F.col(bars), F.lit(f"|{w}|"), F.lit("")))) / len(f"|{w}|".encode())).cast("long") for w in ws]
        return F.array(F.col("n_words") - sum(each[1:], each[0]), *each)

    pick = F.lit(None).cast("array<bigint>")
    for code, ws in COMMON_WORDS.items():
        pick = F.when(F.col(lang) == code, counts(ws)).otherwise(pick)
    return pick


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance in [0, 1] of two count arrays; null if either is null or sums to zero."""
    total = "nullif(aggregate({0}, 0L, (s, v) -> s + v), 0)"
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (v.a + v.b)) ELSE 0d END"
    divergence = f"""aggregate(zip_with({p}, {q}, (x, y) -> struct(x / {total.format(p)} AS a, y / {total.format(q)} AS b)), 0d,
        (s, v) -> s + ({term.format('v.a')} + {term.format('v.b')}) / 2)"""
    # greatest() would hide a null
    return F.expr(f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL AND {total.format(p)} > 0 AND {total.format(q)} > 0 THEN sqrt(greatest(0d, {divergence})) END")


def _sums(column: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)])


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` as _in0, _in1, ..., language, base columns and both histograms of every row."""
    names = [f"_in{i}" for i in range(len(keep))]
    rows = base_rules(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], "text", "lang"))
    rows = (rows.withColumn("_lower", F.array_remove(F.split(F.lower(F.array_join("_words", " ")), " "), ""))
            .withColumn("_bars", common_string("_lower"))
            .withColumns({"_chars": char_histogram(F.coalesce(F.col("text"), F.lit(""))), "_common": word_histogram("_bars", "lang")}))
    return rows.select(*names, F.col("lang").alias("_of"), *BASE, "_chars", "_common")


def _references(rows: DataFrame) -> DataFrame:
    """Summed histograms per language with a word list: as many rows at most."""
    good = rows.where(~F.col("base_failed") & F.col("_of").isin(list(COMMON_WORDS)))
    return stored(good.groupBy(F.col("_of").alias("_lang")).agg(
        _sums("_chars", N_CLASSES).alias("_ref_chars"), _sums("_common", 1 + max(map(len, COMMON_WORDS.values()))).alias("_ref_common")))


def _compared(rows: DataFrame, references: DataFrame, limits: Limits) -> DataFrame:
    out = rows.join(F.broadcast(references), F.col("_of") == F.col("_lang"), "left")
    zero = F.lit(0).cast("long")
    judge = (F.aggregate("_chars", zero, lambda a, x: a + x) >= limits.min_chars) & (F.col("n_words") >= limits.min_words)
    out = out.withColumns({"char_distance": F.when(judge, js_distance("_chars", "_ref_chars")),
                           "word_distance": F.when(judge & (F.col("n_words") >= limits.min_judged), js_distance("_common", "_ref_common"))})
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("char_distance") <= limits.char_distance, F.lit(True))
                          & F.coalesce(F.col("word_distance") <= limits.word_distance, F.lit(True)))


def judged(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """Key, base columns, ``kept`` and both distances for every row of ``docs`` (key, text, lang).

    One pass reads the texts; its small histograms are stored, since the references need all of them first.
    """
    rows = stored(_measured(docs, (key,)))
    out = _compared(rows, _references(rows), limits)
    return out.select(F.col("_in0").alias(key), *BASE, "kept", "char_distance", "word_distance")


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns.

    Only row identities and small histograms are stored; the texts are read again and move once at most.
    """
    slim = identified(docs).select("_a", "_b", "_row.text", "_row.lang")
    rows = stored(_measured(slim, ("_a", "_b")))
    kept = stored(_compared(rows, _references(rows), limits).where("kept").select(F.col("_in0").alias("_a"), F.col("_in1").alias("_b")).distinct())
    # equal rows share their verdict, so a semi join keeps all of them
    return identified(docs).join(kept, ["_a", "_b"], "left_semi").select("_row.*")
