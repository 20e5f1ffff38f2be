from __future__ import annotations

import gzip
import json
import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from seriesloom.llm import warc

SCHEMA = "page_id long, url string, html string, data string, key int"
DATE = "2024-01-01T00:00:00Z"
PAGE = (
    "<!DOCTYPE html><html><head><title>A &amp; b</title><style>p{x:1}</style><script>var a='<p>no</p>';</script></head>"
    "<body><!-- <p>gone</p> --><p>One <b>bold</b> word&nbsp;here &lt;x&gt;<br>next</p><div>1 < 2 é</div>"
    "<a href='/a?b=1&amp;c=2'>go</a> <A HREF=\"http://e.org/\">out</A><a href=plain>x</a></body></html>"
)


def test_page_text():
    assert warc.plain_text(PAGE) == "A & b\nOne bold word here <x>\nnext\n1 < 2 é\ngo outx"
    assert warc.plain_text("") == ""


def test_records_round_trip_and_keep_their_source():
    source = warc.response("http://x.org/é", PAGE, DATE)
    headers, block = warc.parse(source)
    body = PAGE.encode()
    assert block.endswith(body) and dict(headers)["WARC-Payload-Digest"] == warc.digest(body)
    meta, text = warc.derive(source)
    for kind, row in (("metadata", meta), ("conversion", text)):
        own, content = warc.parse(row[-1])
        own = dict(own)
        assert own["WARC-Type"] == kind == row[0]
        assert own["WARC-Refers-To"] == dict(headers)["WARC-Record-ID"] == row[2]
        assert own["WARC-Target-URI"] == "http://x.org/é" and own["WARC-Date"] == DATE
        assert own["WARC-Source-Payload-Digest"] == warc.digest(body)
        assert own["WARC-Block-Digest"] == warc.digest(content) and int(own["Content-Length"]) == len(content)
    assert warc.parse(text[-1])[1].decode() == warc.plain_text(PAGE)
    about = json.loads(warc.parse(meta[-1])[1])
    assert [tuple(x) for x in about["warc_headers"]] == headers
    assert about["title"] == "A & b" and about["links"] == ["/a?b=1&c=2", "http://e.org/", "plain"]
    assert about["conversion"] == text[1] == dict(warc.parse(meta[-1])[0])["WARC-Concurrent-To"]
    assert about["http_status"] == "HTTP/1.1 200 OK" and ["Content-Type", "text/html; charset=utf-8"] in about["http_headers"]


def test_odd_records():
    assert warc.derive(b"") == [] and warc.derive(b"garbage\r\n\r\n") == []
    assert warc.derive(warc.record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")) == []
    bare = b"WARC/1.0\nwarc-type: response\nX-Long: a\n  b\n\nHTTP/1.0 404 Not\nContent-Type: text/html; charset=latin-1\n\n<p>\xe9</p>"
    meta, text = warc.derive(bare)
    assert warc.parse(text[-1])[1].decode() == "é"
    about = json.loads(warc.parse(meta[-1])[1])
    assert ["X-Long", "a b"] in about["warc_headers"] and about["source"]["payload_digest"] == warc.digest(b"<p>\xe9</p>")
    odd = warc.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n<p>a")
    assert warc.parse(warc.derive(odd)[1][-1])[1] == b"a"


class Text(HTMLParser):
    """Words of a page by the standard parser."""

    def __init__(self, page):
        super().__init__()
        self.skip, self.parts = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.parts.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.parts.append("" if tag in ("a", "b", "i", "em", "strong", "span") else " ")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_given_pages_agree_with_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    made = warc.derivatives(warc.responses(pages, DATE)).where("record_type = 'conversion'").join(pages.select("page_id", "html"), "page_id")
    rows = made.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert warc.parse(bytes(r.data))[1].decode().split() == "".join(Text(r.html).parts).split()


def test_tables_and_files(spark, tmp_path):
    rows = [(1, "http://a/", PAGE, "d", 1), (1, "http://a/", PAGE, "d", 1), (None, None, None, None, None), (3, "", "", "", 2), (4, "u", "long <p>" * 50_000, "", 2)]
    pages = spark.createDataFrame(rows, SCHEMA)
    records = warc.responses(pages, DATE)
    made = warc.derivatives(records.unionByName(spark.createDataFrame([(9, None), (10, bytearray(b"x"))], records.schema)))
    assert sorted((str(r.page_id), r.record_type) for r in made.collect()) == sorted((str(r[0]), t) for r in rows for t in ("metadata", "conversion"))
    assert warc.derivatives(records.where("page_id < 0")).count() == 0
    folder = tmp_path / "warcs"
    total = warc.write_records(made, f"file://{folder}").agg(F.sum("records")).first()[0]
    held = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(folder.iterdir()))
    assert total == 10 and held.count(b"WARC/1.1\r\nWARC-Type:") == 10


def test_pages_that_never_close_take_linear_time():
    """A megabyte of each opening, with and without brackets, in under a second or so."""
    marks = ["<script>", "<script ", "<!-- ", "<a ", "<a href=", "<a href=\"", "<title>", "<title ", "<p ", "<", "</", "</script ", "href= "]
    for mark in marks:
        page = mark * (1_000_000 // len(mark))
        start = time.perf_counter()
        warc.plain_text(page), warc.links(page), warc.title_of(page)
        assert time.perf_counter() - start < 3, mark


def test_scanner_equals_the_plain_patterns():
    """On short pages of random pieces: what backtracking patterns would drop, link and name."""
    dropped = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
    link = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
    pieces = ["<script>", "</script >", "<SCRIPT src=x>", "</style>", "<style a", ">", "<!--", "-->", "<a ", "href=", "href = 'b>'", "x", " ", '"',
              "<a", "<title>", "</title>", "<p>", "<template>", "</Template>", "'", "href", "<b", "\n"]
    rng = random.Random(3)
    for _ in range(20_000):
        page = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert warc._without_dropped(page) == dropped.sub(" ", page), page
        assert warc.links(page) == [x.strip("\"'") for x in link.findall(page)], page
        found = title.search(page)
        assert warc.title_of(page) == (" ".join(found[1].split()) if found else None), page


def test_control_characters_do_not_end_a_header():
    source = warc.response("http://x.org/a\r\nWARC-Date: 1999\r\n\r\nb\x00", "<p>a</p>", DATE)
    headers = dict(warc.parse(source)[0])
    assert headers["WARC-Target-URI"] == "http://x.org/a%0D%0AWARC-Date: 1999%0D%0A%0D%0Ab%00" and headers["WARC-Date"] == DATE
    for row in warc.derive(source):
        own = dict(warc.parse(row[-1])[0])
        assert own["WARC-Target-URI"] == headers["WARC-Target-URI"] and own["WARC-Date"] == DATE
