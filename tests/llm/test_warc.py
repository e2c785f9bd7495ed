"""Derived records: links, digests, texts."""

import base64
import hashlib
import json

from rainrisk.llm import warc

SCHEMA = "page_id long, url string, html string, block string"
PAGE = ('<!DOCTYPE html><html lang="fr"><head><title>A &amp;  B</title><script>var t="</p>";</script></head><body><!-- no --><p>One<br>two &eacute; <b>bold</b></p>'
        '<a href="/x?a=1&amp;b=2">link</a><img src=pic.png><style>p{}</style><p>1 &lt; 2</body></html>')


def sha(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records(spark):
    rows = [(1, "http://ex.org/d/p.html", PAGE, "b"), (2, None, None, None), (3, "not a url [", "<<<" * 5000, None), (1, "http://ex.org/d/p.html", PAGE, "b"), (None, "http://ex.org", "plain é", None)]
    got = warc.derived(warc.responses(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 2 * len(rows)
    meta, text = ([r for r in got if r["page_id"] == 1 and r["warc_type"] == t] for t in ("metadata", "conversion"))
    assert len(meta) == len(text) == 2 and meta[0] == meta[1]
    assert text[0]["block"] == "One\ntwo é bold\nlink\n1 < 2" and text[0]["content_type"] == "text/plain"
    data = json.loads(meta[0]["block"])
    assert data["Title"] == "A & B" and data["Language"] == "fr" and data["Status-Line"] == "HTTP/1.1 200 OK"
    assert data["Response-Headers"]["Content-Length"] == str(len(PAGE.encode()))
    assert [x["url"] for x in data["Links"]] == ["http://ex.org/x?a=1&b=2", "http://ex.org/d/pic.png"]
    assert meta[0]["refers_to"] == text[0]["refers_to"] != text[0]["record_id"] != meta[0]["record_id"]
    for r in got:
        assert r["block_digest"] == sha(r["block"]) and r["content_length"] == len(r["block"].encode())
        page = {1: PAGE, 2: "", 3: "<<<" * 5000, None: "plain é"}[r["page_id"]]
        assert r["source_payload_digest"] == sha(page)
    assert {r["block"] for r in got if r["page_id"] == 2 and r["warc_type"] == "conversion"} == {""}


def test_files_can_be_read_back(spark, tmp_path):
    records = warc.derived(warc.responses(spark.createDataFrame([(1, "http://ex.org/", PAGE, None), (2, None, "x\r\n\r\ny", None)], SCHEMA)))
    warc.write_warc(records, str(tmp_path / "w"))
    import glob
    import gzip

    data, seen = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "w/*.gz")))), []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        seen.append((fields["WARC-Type"], rest[:n].decode()))
        assert rest[n:n + 4] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == sha(seen[-1][1])
        data = rest[n + 4:]
    assert sorted(seen) == sorted((r["warc_type"], r["block"]) for r in records.collect())


def test_empty(spark):
    assert warc.derived(warc.responses(spark.createDataFrame([], SCHEMA))).count() == 0


BROKEN = ["<script>", "<!--", "<a ", "<title", "<title>", "<html ", "<a href=\"", "<a href='", "<!doctype ", "&#9", "<a x=\"'", "</script ", "<a href  ", "<", "<style></script>"]


def test_five_megabytes_of_broken_markup():
    import time

    for piece in BROKEN:
        page = piece * (5_000_000 // len(piece))
        began = time.process_time()
        warc.plain_text(page), warc.metadata(page, "http://ex.org/", "HTTP/1.1 200 OK")
        assert time.process_time() - began < 5, piece


def test_unclosed_parts_stay_text():
    assert warc.plain_text("a<script>b<!-- c<p>d") == "ab<!-- c\nd"
    assert warc.plain_text("a<script>x</script>b<script>c") == "a\nbc"
    assert warc.plain_text("&#" + "9" * 6000 + "; &#0000000000065; &#x000041;") == "� A A"
    assert warc.plain_text("&#123abcdefg; &#x00000000041; &#000000000;") == "{abcdefg; A \ufffd"
    assert [x["url"] for x in warc.metadata("<a title='x>y' href=/1>it's</a><a title=\"<b>\" href='/2'>z<a href=/3", None, "")["Links"]] == ["/1", "/2", "/3"]


def test_headers_are_all_kept(spark):
    lines = ["HTTP/1.1 200 OK", "Set-Cookie: a=1", "X-A:1", "Set-Cookie: b=2; p: q", "X-Long: one", "  two", "odd", "Empty:"]
    rows = [("k", "http://ex.org/", None, "\r\n".join(lines), "<p>x</p>", "clash"), (None, None, None, None, None, None)]
    source = spark.createDataFrame(rows, "_key string, target_uri string, warc_date string, http_headers string, payload string, block string")
    got = {r["page_id"]: json.loads(r["block"]) for r in warc.derived(source).where("warc_type = 'metadata'").collect()}
    assert got["k"]["Response-Headers"] == {"Set-Cookie": ["a=1", "b=2; p: q"], "X-A": "1", "X-Long": "one two", "": "odd", "Empty": ""}
    assert got[None]["Response-Headers"] == {} and got[None]["Links"] == []


class Reader(__import__("html.parser").parser.HTMLParser):
    """Independent reading of well-formed pages."""

    HIDDEN = {"script", "style", "template", "noscript", "head"}
    BLOCKS = {"p", "div", "br", "li", "ul", "table", "tr", "h1", "section"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.text, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        name = next((n for n, _ in attrs if n in ("href", "src")), None)
        if tag in ("a", "img", "script", "link") and name:
            self.links.append((f"{tag.upper()}@/{name}", found[name].strip()))
        self.depth += tag in self.HIDDEN
        if tag in self.HIDDEN | self.BLOCKS and self.depth <= (tag in self.HIDDEN):
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN
        if tag in self.BLOCKS and not self.depth:
            self.text.append("\n")

    def handle_comment(self, data):
        if not self.depth:
            self.text.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def test_random_pages_against_a_parser():
    import random
    import re

    rng = random.Random(5)
    words = ["alpha", "b &amp; c", "x &lt; y", "d&eacute;j&agrave;", " ", "\n", "&#65;&#x42;", "it's", 'say "so"']

    def part(depth):
        kind = rng.randrange(9)
        if kind < 3 or depth > 4:
            return rng.choice(words)
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(4)))
        tag = rng.choice(["p", "div", "b", "i", "ul", "li", "section", "span", "h1"])
        return [f"<{tag} class='x=1'>{inner}</{tag}>", f"<br>{inner}", f"<!-- {rng.choice(words)} <p> -->{inner}",
                f"<script src='/s{rng.randrange(9)}.js'>var a = 'x';</script>{inner}", f'<a title="q" href="/p?a=1&amp;b={rng.randrange(99)}">{inner}</a>',
                f"<img alt='z' src=i{rng.randrange(9)}.png>{inner}"][kind - 3]

    for _ in range(400):
        page = f"<!doctype html><html lang='de'><head><title>t</title></head><body>{''.join(part(0) for _ in range(8))}</body></html>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = (re.sub(r"[^\S\n]+", " ", x).strip(" ") for x in "".join(reader.text).split("\n"))
        assert warc.plain_text(page) == "\n".join(x for x in lines if x), page
        assert [(x["path"], x["url"]) for x in warc.metadata(page, None, "")["Links"]] == reader.links, page
