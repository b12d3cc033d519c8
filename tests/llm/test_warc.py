from __future__ import annotations

import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from storyrank.llm import warc_derive as warc
from storyrank.sources.scratch import scratch_path

PAGES = [
    (1, "http://a/", "<html lang=EN><head><title>A &amp;\n B</title><style>p{}</style></head><body>"
     "<p>One  &eacute;&#33;<br>two<script>var t='</p>';</script></p><!-- <p>no</p> --><a href='/x?a=1&amp;b'>x</a></body></html>"),
    (2, None, None),
    (3, "http://b/", ""),
    (4, "http://c/", "plain < 5 text > and &lt;b&gt;"),
    (4, "http://c/", "plain < 5 text > and &lt;b&gt;"),
    (None, "http://d/", "<script>never closed <p>x</p>"),
    (5, "http://e/", "<p>" + "long text " * 20_000 + "</p>"),
]


def derived(spark, rows=PAGES):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    pages = pages.withColumns({c: F.lit("own") for c in ("record_id", "payload", "headers", "block")})
    return warc.derive_records(warc.page_responses(pages))


def test_records_of_hard_pages(spark):
    rows = derived(spark).collect()
    assert len(rows) == 2 * len(PAGES)
    text = {r["row"]["page_id"]: r["block"] for r in rows if r["record_type"] == "conversion"}
    assert text[1] == "A & B\nOne é!\ntwo\nx"
    assert text[2] == text[3] == text[None] == ""
    assert text[4] == "plain < 5 text > and <b>"
    assert text[5] == ("long text " * 20_000).strip()
    about = {r["row"]["page_id"]: r["block"].split("\r\n") for r in rows if r["record_type"] == "metadata"}
    assert about[1][1:3] == ["title: A & B", "language: en"]
    assert "http-header: Content-Type: text/html; charset=utf-8" in about[1]
    assert about[1][-2:] == ["outlink: /x?a=1&b", ""]
    for r in rows:
        named = {h["name"]: h["value"] for h in r["headers"]}
        payload = (r["row"]["html"] or "").encode()
        assert named["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert named["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert named["Content-Length"] == str(len(r["block"].encode()))
        assert ("WARC-Target-URI" in named) == (r["row"]["url"] is not None)
    linked = {}
    for r in rows:
        linked.setdefault({h["name"]: h["value"] for h in r["headers"]}["WARC-Refers-To"], []).append(r["record_type"])
    assert all(sorted(set(v)) == ["conversion", "metadata"] for v in linked.values())


def test_links_of_plain_pages(spark):
    page = (
        """<a href="/o'neil">x</a><a data-href="/no" href="/yes">x</a><A\tclass=b href\t=\n/unquoted>x</a>"""
        """<a href='/a"b'>x</a><a href="/split\r\nWARC-Type: x">x</a><a name="href=/not">x</a><abbr href="/no">x</abbr>"""
        """<a href="">x</a><a href="/q?a=1&amp;b=2">x</a>"""
    )
    block = next(r["block"] for r in derived(spark, [(1, "http://a/", page)]).collect() if r["record_type"] == "metadata")
    links = [line.removeprefix("outlink: ") for line in block.split("\r\n") if line.startswith("outlink: ")]
    assert links == ["/o'neil", "/yes", "/unquoted", '/a"b', "/splitWARC-Type: x", "", "/q?a=1&b=2"]
    assert not any(line.startswith("WARC-") for line in block.split("\r\n"))


def test_blanks_of_text(spark):
    page = "a \t b\u00a0c&nbsp;&nbsp;d\r\n e\f<br> \t<P >f  g</P\n>&#9;h&#10;i"
    block = next(r["block"] for r in derived(spark, [(1, "u", page)]).collect() if r["record_type"] == "conversion")
    assert block == "a b c d e\nf g\nh\ni"


def read_warc(data: bytes):
    """Records of a WARC file, by the lengths in their headers."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        named = dict(line.split(": ", 1) for line in lines[1:])
        size = int(named["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield named, rest[:size].decode()
        data = rest[size + 4 :]


def test_written_files_are_read_back(spark):
    records = derived(spark)
    path = scratch_path(spark, "warc")
    warc.write_warc(records, path)
    back = []
    for name in glob.glob(f"{path}/*.gz"):
        with gzip.open(name) as file:
            back += [(n["WARC-Record-ID"], n["WARC-Type"], b) for n, b in read_warc(file.read())]
    expected = [(r["record_id"], r["record_type"], r["block"]) for r in records.collect()]
    assert sorted(back) == sorted(expected)


def test_empty_table(spark):
    assert derived(spark, []).count() == 0
