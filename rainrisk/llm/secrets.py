"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the matches of the base patterns plus long mixed tokens that may be bare credentials. Every candidate
value is hashed and counted over the distinct repositories and owners that hold it. A value spread over many
owners is a copied example, one that a few owners hold and that looks random is a live credential. A bare
token becomes a span of its own if it is live. Uses next to a keyword and bare uses count together.

Defined cases: null and empty texts have no candidates and still give a row. Repeated rows give repeated results and
count once, as repositories and owners are counted distinct; null ones count as nobody. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rainrisk.llm.common import ROW, identified, stored, with_row_id

#: Kinds of base secrets in their order, the group that counts and its least length. Runs of one class hold
#: their least length in the pattern already: a shorter run cannot match, a longer one matches as a whole.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
ORDER = [k for k, *_ in BASE_KINDS] + ["bare"]
#: A bare token: a long run of the characters that credentials are made of.
BARE = r"[A-Za-z0-9+/_=-]{20,}"


@dataclass(frozen=True)
class Limits:
    """Production values: a live value has at most so many owners and repositories, and so many bits per character."""

    max_owners: int = 2
    max_repositories: int = 50
    min_bits: float = 3.0


def matches(text: str, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, kind, value), code points, short ones dropped afterwards.

    The pieces between matches and the matches themselves alternate, so running lengths give the positions.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, value = f"regexp_extract_all({text}, '{quoted}', 0)", f"regexp_extract_all({text}, '{quoted}', {group})"
    pieces = f"split({text}, '{quoted}', -1)"
    lengths = f"zip_with(slice({pieces}, 1, size({found})), {found}, (gap, m) -> struct(char_length(gap) AS gap, char_length(m) AS len))"
    walked = (f"aggregate({lengths}, struct(0 AS at, cast(array() AS array<struct<start: int, end: int>>) AS spans), (a, x) -> struct(a.at + x.gap + x.len AS at, "
              f"concat(a.spans, array(struct(a.at + x.gap AS start, a.at + x.gap + x.len AS end))) AS spans), a -> a.spans)")
    rows = f"zip_with({walked}, {value}, (s, v) -> struct(s.start AS start, s.end AS end, '{kind}' AS kind, v AS value))"
    return F.expr(f"CASE WHEN {text} rlike '{quoted}' THEN filter({rows}, x -> char_length(x.value) >= {least}) ELSE array() END")


def span_text(spans: str, order: list[str]) -> Column:
    """kind:start:end joined by commas, by start, then by the order of kinds."""
    rank = f"array_position(array({', '.join(repr(k) for k in order)}), x.kind)"
    return F.expr(f"""array_join(transform(sort_array(transform({spans}, x -> struct(x.start AS a, {rank} AS b, x.end AS c, x.kind AS k))),
        x -> concat(x.k, ':', x.a, ':', x.c)), ',')""")


def entropy_bits(value: str) -> Column:
    """Shannon bits per character of a value."""
    chars = f"split({value}, '')"
    return F.expr(f"""-aggregate(transform(array_distinct({chars}), c -> (char_length({value}) - char_length(replace({value}, c, ''))) / char_length({value})), 0d,
        (a, p) -> a + p * log2(p))""")


def candidates(docs: DataFrame) -> DataFrame:
    """Row id, key, repository, owner and the found spans of every row."""
    rows = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({k: matches("text", k, p, g, n) for k, p, g, n in BASE_KINDS} | {"bare": matches("text", "bare", BARE, 0, 20)})
    covered = "exists(concat(assign, access, hex), y -> y.start < x.end AND x.start < y.end)"
    mixed = "x.value rlike '[0-9]' AND x.value rlike '[A-Z]' AND x.value rlike '[a-z]'"
    return rows.withColumn("bare", F.expr(f"filter(bare, x -> {mixed} AND NOT {covered})")).drop("text")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners per candidate hash, counted before and after the shuffle, so a hot value stays spread."""
    return found.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"))


def added_spans(rows: DataFrame, limits: Limits) -> DataFrame:
    """Row id, live bare spans, counts of live and copied values; ``rows`` holds the candidates of every row."""
    found = (rows.where("size(assign) + size(access) + size(hex) + size(bare) > 0")
             .select(ROW, "repository", "owner", F.explode(F.concat("assign", "access", "hex", "bare")).alias("x"))
             .select(ROW, "repository", "owner", "x", F.sha2("x.value", 256).alias("hash"), (F.col("x.kind") != "bare").alias("is_base")))
    # both sides of this join come from files, so adaptive execution can split a value that many rows hold
    rated = found.join(stored(ownership(found)), "hash").withColumn("random", entropy_bits("x.value") >= limits.min_bits)
    live = F.col("random") & (F.col("n_owners") <= limits.max_owners) & (F.col("n_repositories") <= limits.max_repositories)
    return rated.withColumn("live", live).where(F.col("is_base") | F.col("live")).groupBy(ROW).agg(
        F.collect_list(F.when(~F.col("is_base"), F.col("x"))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"))


def scanned(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, base counts and digest, all spans, and how many are live or copied."""
    rows = with_row_id(docs.select(F.col(key).alias("key"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), "text"))
    rows = stored(candidates(rows))
    out = rows.join(added_spans(rows, limits), ROW, "left").withColumns({
        "base": F.concat("assign", "access", "hex"), "all": F.concat("assign", "access", "hex", F.coalesce("added", F.expr("slice(assign, 1, 0)")))})
    return out.select(F.col("key").alias(key), *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE_KINDS],
                      F.sha2(span_text("base", ORDER), 256).alias("base_sha256"), span_text("all", ORDER).alias("spans"),
                      F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def redacted(docs: DataFrame, limits: Limits = Limits(), repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """``docs`` with every found span replaced by a marker; rows, columns and their order stay, ``n_chars`` follows the text.

    Overlapping spans become one marker. Only candidates and row identities are stored: base spans are found again in the texts,
    added ones come by identity, for the few rows that have any.
    """
    names = docs.columns
    slim = identified(docs).select("_a", "_b", F.col(f"_row.`{repository}`").alias("repository"), F.col(f"_row.`{owner}`").alias("owner"), "_row.text")
    rows = stored(candidates(with_row_id(slim)).where("size(assign) + size(access) + size(hex) + size(bare) > 0"))
    added = added_spans(rows, limits).where("size(added) > 0")
    named = stored(rows.select(ROW, "_a", "_b").join(added, ROW).select("_a", "_b", "added").dropDuplicates(["_a", "_b"]))
    out = identified(docs).join(named, ["_a", "_b"], "left").withColumn("_text", F.coalesce("_row.text", F.lit("")))
    out = out.withColumns({k: matches("_text", k, p, g, n) for k, p, g, n in BASE_KINDS})
    out = out.withColumn("_cuts", F.expr("""sort_array(transform(concat(assign, access, hex, coalesce(added, slice(assign, 1, 0))), x -> struct(x.start AS a, x.end AS b)))"""))
    cleaned = F.expr("""aggregate(_cuts, struct(cast(array() AS array<string>) AS t, 0 AS at), (s, c) -> CASE WHEN c.a < s.at THEN struct(s.t AS t, greatest(s.at, c.b) AS at)
        ELSE struct(concat(s.t, array(substring(_text, s.at + 1, c.a - s.at), '[SECRET]')) AS t, c.b AS at) END, s -> array_join(concat(s.t, array(substring(_text, s.at + 1))), ''))""")
    out = out.withColumn("_new", F.when(F.size("_cuts") > 0, cleaned))
    at = {c: F.col(f"_row.`{c}`") for c in names} | {"text": F.coalesce("_new", "_row.text")}
    if "n_chars" in at:
        at["n_chars"] = F.coalesce(F.char_length("_new").cast("long"), at["n_chars"])
    return out.select(*[at[c].alias(c) for c in names])
