"""Text, number and time coercions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRUE_WORDS = ("true", "1", "1.0", "t", "yes")
DASH = "—"
LOCAL_ZONE = "America/Sao_Paulo"


def to_float(value: Column) -> Column:
    """Number or null; NaN is null."""
    number = value.try_cast("double")
    return F.when(F.isnan(number), F.lit(None)).otherwise(number)


def to_int(value: Column) -> Column:
    """Half-even rounding to int, null when not a number."""
    return F.bround(to_float(value)).try_cast("int")


def to_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def parse_thresholds(text: Column, default: Column | None = None) -> Column:
    """``"a;b;c"`` or ``"[a,b,c]"`` to ascending ``array<double>``; anything else gives the default."""
    default = F.lit(None).cast("array<double>") if default is None else default
    body = F.regexp_replace(text, r"[\[\]\s]", "")
    parts = F.filter(F.split(body, "[;,]"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    usable = (F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull())
    return F.when(usable, numbers).otherwise(default)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with Z, offset or naive (= session zone, UTC)."""
    return F.try_to_timestamp(text)


def parse_gauge_hour(text: Column) -> Column:
    """``2026/09/15 19``."""
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH"))


def parse_first_format(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def normalize_road(code: Column) -> Column:
    """``sp 098`` to ``SP-098``."""
    return F.replace(F.upper(F.trim(code)), F.lit(" "), F.lit("-"))


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1; text that cannot be repaired stays."""
    marked = text.rlike("Ã|â€|�")
    latin = ~text.rlike("[^\\x{00}-\\x{FF}]")
    repaired = F.try_validate_utf8(F.encode(F.when(marked & latin, text), "ISO-8859-1"))
    return F.when(marked & latin & (F.length(repaired) > 0), repaired).otherwise(text)


def format_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, LOCAL_ZONE), "dd/MM/yyyy HH:mm:ss"), F.lit(DASH))


def format_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit(DASH))


def clean_path(path: Column, marker: str = "data/") -> Column:
    """Path from the marker on, else the file name."""
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(text, marker)
    tail = F.substring(text, at, F.length(text))
    name = F.substring_index(text, "/", -1)
    return (F.when(path.isNull() | (path == ""), F.lit(DASH))
            .when(at > 0, tail).otherwise(name))


def unit_label(road: Column, km0: Column, km1: Column, region: Column) -> Column:
    r = F.coalesce(region.cast("string"), F.lit("None"))
    road = F.when(road.isNull() | (road == ""), F.lit("UA")).otherwise(road)
    short = F.concat(road, F.lit(" (R"), r, F.lit(")"))
    long = F.concat(road, F.lit(" km "), F.format_string("%.1f", km0), F.lit("-"),
                    F.format_string("%.1f", km1), F.lit(" (R"), r, F.lit(")"))
    return F.when(km0.isNotNull() & km1.isNotNull(), long).otherwise(short)


def unit_id(region: Column, town: Column, scale: Column, n: Column) -> Column:
    return F.concat(F.lit("UA-R"), region.cast("string"), F.lit("-"), town, F.lit("-"), scale, F.lit("-"),
                    F.format_string("%03d", n.cast("long")))


def split_action(text: Column) -> tuple[Column, Column]:
    """(agency, text) around the first colon; no colon means no agency."""
    at = F.instr(text, ":")
    agency = F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(F.lit(""))
    rest = F.when(at > 0, F.trim(F.substring(text, at + 1, F.length(text)))).otherwise(F.trim(text))
    return agency, rest


def office_code(code: Column) -> Column:
    return F.regexp_replace(code, r"^\s*DR\b", "CGR")


def traffic_light(status: Column) -> Column:
    return (F.when(status.isin("ok", "fresh"), F.lit("ok"))
            .when(status.isin("degraded", "loading", "warn", "no_data"), F.lit("warn"))
            .otherwise(F.lit("fail")))


def mid_km(km0: Column, km1: Column) -> Column:
    """Mean of both ends; null unless both are known."""
    return (km0 + km1) / F.lit(2.0)


def km_text(km: Column) -> Column:
    """One decimal with a decimal comma; a dash when unknown."""
    return F.coalesce(F.translate(F.format_number(km, 1), ",.", ".,"), F.lit(DASH))


def segment_id(*fields: Column) -> Column:
    """First 16 hex digits of SHA-1 over the ``|``-joined fields, null as empty."""
    joined = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.substring(F.sha1(joined), 1, 16)


def parse_distribution(text: Column) -> Column:
    """JSON object class -> units to ``map<int,int>`` without non-positive counts."""
    raw = F.from_json(text, "map<string,int>")
    return F.transform_keys(F.map_filter(raw, lambda k, v: v > 0), lambda k, v: k.cast("int"))
