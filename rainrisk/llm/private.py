"""Personal data by bootstrapped contextual extraction.

Fixed patterns find seeds. The words around every seed and around every other identifier-like token (one that holds a digit) are lexical
patterns, and patterns with the distinct values they surround form a graph. Scores pass between both sides: a pattern
is as good as the share of its values that are known, a value as good as its best pattern. After a few rounds, values of
reliable patterns are spans wherever they occur. Values count once however often their text is copied.

Defined cases: null and empty texts have no spans and still give a row. Repeated rows give repeated results and add no evidence.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import ROW, stored, with_row_id

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An email is found from its @ on; a number never starts inside another one.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token with a digit, and what is cut from its ends.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_EDGE = "\"'()[]{}<>,;:!?.*%#&$|=`"
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]")
FOUND = "start int, end int, kind string, value string, patterns array<string>"


@dataclass(frozen=True)
class Limits:
    """Production values: distinct known values that make a pattern count, the score that makes it reliable, rounds, value sizes."""

    min_known: int = 5
    min_score: float = 0.8
    rounds: int = 3
    shortest: int = 6
    longest: int = 64


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the order of kinds."""
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the two words before, and the words on both sides; digits count as 0. Each word must hold a letter."""
    left = [w for w in _DIGIT.sub("0", text[max(0, start - 80):start].lower()).split()[-2:] if _LETTER.search(w)]
    right = [w for w in _DIGIT.sub("0", text[end:end + 40].lower()).split()[:1] if _LETTER.search(w)]
    out = [f"L {' '.join(left)}"] if len(left) == 2 else []
    return out + [f"B {left[-1]} _ {right[0]}"] if left and right else out


def found_in(text: str, limits: Limits) -> tuple[list[tuple[int, int, str]], list[dict]]:
    base = base_spans(text)
    found = [{"start": a, "end": b, "kind": k, "value": text[a:b].lower(), "patterns": contexts(text, a, b)} for a, b, k in base]
    ends = iter(sorted((a, b) for a, b, _ in base))
    span = next(ends, None)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while span and span[1] <= a:
            span = next(ends, None)
        if limits.shortest <= b - a <= limits.longest and not (span and span[0] < b):
            found.append({"start": a, "end": b, "kind": None, "value": text[a:b].lower(), "patterns": contexts(text, a, b)})
    return base, found


def extracted(docs: DataFrame, limits: Limits, key: str) -> DataFrame:
    """Row id, key, base counts and digest, and everything found with its patterns."""
    rows = with_row_id(docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"))).select(ROW, "_key", "_text")
    counts = [f"n_{k}" for k in KINDS]
    schema = f"{ROW} long, _key {rows.schema['_key'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, base string, base_sha256 string, found array<struct<{FOUND.replace(' ', ': ').replace(',:', ',')}>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            each, text, digest, found = {k: [] for k in KINDS}, [], [], []
            for value in part.column(2):
                base, more = found_in(value.as_py() or "", limits)
                for k in KINDS:
                    each[k].append(sum(s[2] == k for s in base))
                text.append(",".join(f"{k}:{a}:{b}" for a, b, k in base))
                digest.append(hashlib.sha256(text[-1].encode()).hexdigest())
                found.append(more)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(each[k], pa.int64()) for k in KINDS), pa.array(text, pa.string()),
                                              pa.array(digest, pa.string()), pa.array(found, kind)], names=[ROW, "_key", *counts, "base", "base_sha256", "found"])

    return rows.mapInArrow(scan, schema)


def discovered(edges: DataFrame, limits: Limits) -> DataFrame:
    """(value, new_kind, score) of values that reliable patterns surround; ``edges`` holds distinct (pattern, value, kind)."""
    values = stored(edges.groupBy("value").agg(F.max("kind").alias("known"), F.max(F.col("kind").isNotNull().cast("double")).alias("score")))
    patterns = None
    for _ in range(limits.rounds):
        # both sides of the joins are stored, so adaptive execution can split a pattern or value that many edges share
        rated = edges.join(values, "value")
        patterns = stored(rated.groupBy("pattern").agg(
            F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"), *[F.count_if(F.col("known") == k).alias(f"n_{k}") for k in KINDS])
            .where(F.col("n_known") >= limits.min_known).withColumn("score", F.col("mass") / F.col("n")).where(F.col("score") >= limits.min_score)
            # the values of a pattern are of one kind but for a few
            .withColumn("top", F.greatest(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS]))
            .where(F.col("top.n") >= limits.min_score * F.col("n_known")).withColumn("new_kind", F.col("top.kind"))
            .select("pattern", F.col("score").alias("pattern_score"), "new_kind"))
        lifted = edges.where("kind IS NULL").join(patterns, "pattern").groupBy("value").agg(F.max(F.struct("pattern_score", "new_kind")).alias("best"))
        values = stored(values.select("value", "known").join(lifted, "value", "left").select(
            "value", "known", F.when(F.col("known").isNotNull(), 1.0).otherwise(F.coalesce("best.pattern_score", F.lit(0.0))).alias("score"), F.col("best.new_kind").alias("new_kind")))
    return values.where(F.col("known").isNull() & (F.col("score") >= limits.min_score)).select("value", "new_kind", "score")


def scanned(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, base counts and digest, all spans, and how many the method added."""
    rows = stored(extracted(docs, limits, key))
    uses = rows.where("size(found) > 0").select(ROW, F.explode("found").alias("f")).select(ROW, "f.*")
    edges = stored(uses.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct())
    new = stored(uses.where("kind IS NULL").select(ROW, "start", "end", "value")).join(discovered(edges, limits), "value")
    added = new.groupBy(ROW).agg(F.collect_list(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("added"))
    order = f"array({', '.join(repr(k) for k in KINDS)})"
    merged = F.expr(f"""array_join(transform(sort_array(concat(
        transform(CASE WHEN base = '' THEN array() ELSE split(base, ',') END, x -> struct(int(split_part(x, ':', 2)) AS a, array_position({order}, split_part(x, ':', 1)) AS b, int(split_part(x, ':', 3)) AS c)),
        transform(added, x -> struct(x.start AS a, array_position({order}, x.kind) AS b, x.end AS c)))), x -> concat({order}[int(x.b) - 1], ':', x.a, ':', x.c)), ',')""")
    out = rows.join(added, ROW, "left")
    return out.select(F.col("_key").alias(key), *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("added").isNull(), F.col("base")).otherwise(merged).alias("spans"),
                      F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
