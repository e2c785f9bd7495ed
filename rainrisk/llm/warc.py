"""Derivatives of web responses: linked metadata and plain-text conversion records.

Every response gives a ``metadata`` record (JSON with title, links and the headers of the source) and a ``conversion`` record (its
text). Both point at the response by WARC-Refers-To, keep its target and date, name its payload digest
and carry a digest of their own block. Record ids derive from their content, so a repeated run gives the same ids.

Defined cases: a null page body is an empty payload, a null url leaves the target out and its links relative, null headers are none, a null
date is ``DATE``. Repeated rows give the same records again, with the same ids. An empty table gives an empty result. Pages of any length are
read once from front to back, broken markup included: a tag ends at the next ``<`` at the latest, a comment or hidden element that never
closes stays text. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Date of records whose source gives none.
DATE = "2024-01-01T00:00:00Z"
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "block_digest string, source_payload_digest string, content_length long, block string")
# every pattern stops at the next "<", so a page of unclosed tags is read once
_HIDDEN = re.compile(r"<!--|<(script|style|template|noscript|head)\b[^<>]*>|<!doctype[^<>]*>", re.I)
_HIDDEN_END = re.compile(r"</(script|style|template|noscript|head)\s*+>", re.I)
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*+>", re.I)
_LANG = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINKING = re.compile(r"<(a|area|link|img|script|iframe|source)\b((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^<>=]++|=)*+)", re.I)
_TARGET = re.compile(r"\b(href|src)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LONG_NUMBER = re.compile(r"&#(?:([xX])(?=[0-9a-fA-F]{9})0*+([0-9a-fA-F]*+)|(?=[0-9]{9})0*+([0-9]*+))")
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|section|article|header|footer|nav|aside|blockquote|pre|form|figure|main|option)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def unescaped(text: str) -> str:
    """Character references resolved; a number beyond Unicode, of any length, becomes the replacement character."""
    def short(m: re.Match) -> str:
        digits = m[2] or m[3] or "0"
        return f"&#{m[1] or ''}{digits if len(digits) < 9 else '99999999'}"

    return html.unescape(_LONG_NUMBER.sub(short, text))


def visible(page: str) -> str:
    """Page with a line break in place of each comment, doctype and hidden element; what never closes stays."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _HIDDEN_END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    kept, at, place, comments = [], 0, 0, True
    while m := _HIDDEN.search(page, place):
        place = m.end()
        if m[1]:
            known = ends.get(m[1].lower(), [])
            i = bisect.bisect_left(known, (place, 0))
            if i == len(known):
                continue
            place = known[i][1]
        elif m[0] == "<!--":
            end = page.find("-->", place) if comments else -1
            comments = end >= 0
            if not comments:
                continue
            place = end + 3
        kept += [page[at:m.start()], "\n"]
        at = place
    return "".join([*kept, page[at:]])


def plain_text(page: str) -> str:
    """Visible text of a page, one line per block element."""
    text = _TAG.sub("", _BREAK.sub("\n", visible(page)))
    return _LINES.sub("\n", _BLANK.sub(" ", unescaped(text))).strip()


def header_fields(lines: list[str]) -> dict:
    """Headers by name in order of appearance, split at the first colon; a repeated name keeps the list of its values.

    A folded line continues the value before it; a line without a colon is kept under the empty name.
    """
    pairs: list[list[str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1][1] += " " + line.strip()
        elif line:
            pairs.append([name.strip(), value.strip()] if colon else ["", line])
    fields: dict = {}
    for name, value in pairs:
        fields.setdefault(name, []).append(value)
    return {name: values[0] if len(values) == 1 else values for name, values in fields.items()}


def title_of(page: str) -> str | None:
    opened = _TITLE.search(page)
    closed = _TITLE_END.search(page, opened.end()) if opened else None
    return _BLANK.sub(" ", unescaped(page[opened.end():closed.start()])).strip() if closed else None


def absolute(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def metadata(page: str, url: str | None, headers: str) -> dict:
    lang, links, joined = _LANG.search(page), [], {}
    for tag in _LINKING.finditer(page):
        m = _TARGET.search(tag[2]) if "=" in tag[2] else None
        if not m:
            continue
        target = m[2] or m[3] or m[4] or ""
        if target not in joined:
            joined[target] = absolute(url or "", unescaped(target).strip())
        links.append({"path": f"{tag[1].upper()}@/{m[1].lower()}", "url": joined[target]})
    status, *lines = headers.split("\r\n")
    return {"Title": title_of(page), "Language": lang[1] if lang else None, "Response-Headers": header_fields(lines), "Status-Line": status, "Links": links}


def responses(pages: DataFrame, key: str = "page_id", date: str = DATE) -> DataFrame:
    """Response records of a table of pages (key, url, html): key, target_uri, warc_date, http_headers, payload."""
    body = F.coalesce("html", F.lit(""))
    headers: Column = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(F.col(key).alias("_key"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), body.alias("payload"))


def derived(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for every response: key, then the columns of ``RECORD``."""
    source = source.select("_key", "target_uri", "warc_date", "http_headers", "payload")
    schema = f"_key {source.schema['_key'].dataType.simpleString()}, {RECORD}"

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = {"at": [], "out": []}
            for i, (uri, date, headers, page) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 5)))):
                page, date, headers = page or "", date or DATE, headers or ""
                payload = page.encode()
                of = record_id("response", uri or "", date, digest(payload))
                made = (("metadata", "application/json", json.dumps(metadata(page, uri, headers), ensure_ascii=False)), ("conversion", "text/plain", plain_text(page)))
                for kind, content, block in made:
                    data = block.encode(errors="replace")
                    rows["at"].append(i)
                    rows["out"].append((kind, record_id(kind, of), of, uri, date, content, digest(data), digest(payload), len(data), data.decode()))
            columns = list(zip(*rows["out"])) or [()] * 10
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows["at"], pa.int64())), *(pa.array(c, pa.int64() if n == 8 else pa.string()) for n, c in enumerate(columns))],
                names=["_key", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "source_payload_digest",
                       "content_length", "block"])

    return source.mapInArrow(build, schema).withColumnRenamed("_key", key)


def rendered(records: DataFrame) -> DataFrame:
    """One string per record: WARC headers, a blank line, the block."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"),
             F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "warc_date"),
             F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("X-Source-Payload-Digest: "), "source_payload_digest"),
             F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"))]
    return records.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files in ``path``: each record ends with two line breaks."""
    rendered(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
