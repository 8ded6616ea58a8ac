"""WARC derivatives: links between records, digests, and hostile responses."""

import base64
import gzip
import hashlib
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

from topshare.llm import warc_derivatives as W
from topshare.llm.html_layout import visible_text
from topshare.llm.queries import op2_warc_derivatives

SF = "/root/testdata/sf0.001"
PAGE = "<html><body><p>Hi é<a href='/x'>x</a><a href=\"https://e.org/y\">y</a></body></html>"


def head(**more):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://h.example/d/p", "WARC-Date": "2020-02-02T00:00:00Z"}
    fields |= {k.replace("_", "-"): v for k, v in more.items()}
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items())


def http(body=PAGE.encode(), *fields, kind="text/html; charset=utf-8", status="200 OK"):
    return "\r\n".join([f"HTTP/1.1 {status}", f"Content-Type: {kind}", *fields, "", ""]).encode() + body


def derived(block, lines=None):
    return {d[0]: d for d in W.derive(lines or head(), block)}


def told(record):
    return W.fields_of(record[4].decode())


def test_records_are_linked():
    body = PAGE.encode()
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    found = derived(http(), head(WARC_Payload_Digest=sha1, WARC_Block_Digest="sha1:" + "A" * 32))
    metadata, conversion = found["metadata"], found["conversion"]
    assert metadata[2] == conversion[2] == "<urn:uuid:1>"
    for record in found.values():
        fields = dict(W.fields_of(record[3]))
        assert fields["WARC-Refers-To"] == "<urn:uuid:1>" and fields["WARC-Target-URI"] == "http://h.example/d/p"
        assert fields["WARC-Record-ID"] == record[1] and fields["WARC-Date"] == "2020-02-02T00:00:00Z"
        assert int(fields["Content-Length"]) == len(record[4]) and W.digest_agrees(fields["WARC-Block-Digest"], record[4])
    lines = told(metadata)
    assert ("source-payload-digest", sha1) in lines and ("source-payload-digest-agrees", "true") in lines
    assert ("source-block-digest-agrees", "false") in lines and ("conversion", conversion[1]) in lines
    assert ("http-status", "HTTP/1.1 200 OK") in lines and ("http-header-content-type", "text/html; charset=utf-8") in lines
    assert [v for n, v in lines if n == "outlink"] == ["http://h.example/x", "https://e.org/y"]
    assert conversion[4].decode() == "Hi éxy"
    assert derived(http()) == derived(http())


def test_codings_and_charsets():
    body = PAGE.encode()
    packed = gzip.compress(body)
    raw = zlib.compressobj(wbits=-15)
    chunks = b"5\r\n" + body[:5] + b"\r\n%x;ext\r\n" % (len(body) - 5) + body[5:] + b"\r\n0\r\n\r\n"
    for block in (
        http(packed, "Content-Encoding: gzip"),
        http(zlib.compress(body), "Content-Encoding: deflate"),
        http(raw.compress(body) + raw.flush(), "Content-Encoding: deflate"),
        http(chunks, "Transfer-Encoding: chunked"),
        http(PAGE.encode("latin-1"), kind="text/html; charset=ISO-8859-1"),
        http(("<meta charset=latin-1>" + PAGE).encode("latin-1"), kind="text/html"),
        http(body, kind="text/html; charset=no-such"),
    ):
        assert derived(block)["conversion"][4].decode() == "Hi éxy"


def test_what_is_not_converted():
    assert set(derived(http(b"\x89PNG", kind="image/png"))) == {"metadata"}
    assert derived(http(b"plain <b>", kind="text/plain"))["conversion"][4] == b"plain <b>"
    assert told(derived(b"no http")["metadata"])[-1] == ("parse-error", "no HTTP response")
    assert W.derive(head(WARC_Type="request"), http()) == [] and W.derive("", http()) == [] and W.derive(head(), b"") != []
    assert dict(W.fields_of(derived(http(b"broken", "Content-Encoding: gzip"))["conversion"][3]))["WARC-Truncated"] == "length"
    assert set(derived(http(b"5\r\nab"))) == {"metadata", "conversion"}


def test_long_bodies_say_that_they_were_cut(monkeypatch):
    monkeypatch.setattr(W, "MOST_UNPACKED", 1000)
    record = derived(http(gzip.compress(b"word " * 100_000), "Content-Encoding: gzip"))["conversion"]
    assert dict(W.fields_of(record[3]))["WARC-Truncated"] == "length" and len(record[4]) < 1000


def test_all_members_and_stacked_codings_are_unpacked():
    body = PAGE.encode()
    members = gzip.compress(body[:20]) + gzip.compress(b"") + gzip.compress(body[20:]) + b"\0\0"
    stacked = gzip.compress(zlib.compress(body))
    for packed, *fields in (
        (members, "Content-Encoding: gzip"),
        (stacked, "Content-Encoding: deflate, gzip"),
        (stacked, "Content-Encoding: deflate", "Content-Encoding: x-gzip"),
        (body, "Content-Encoding: identity"),
        (b"", "Content-Encoding: gzip"),
    ):
        found = derived(http(packed, *fields))
        assert found["conversion"][4].decode() == ("Hi éxy" if packed else "")
        assert "WARC-Truncated" not in dict(W.fields_of(found["conversion"][3]))
        assert ("payload-digest", W.sha1_label(body if packed else b"")) in told(found["metadata"])


def test_bodies_that_end_early_say_so():
    body = b"".join(b"%d word\n" % i for i in range(20_000))
    packed = gzip.compress(body)
    raw = zlib.compress(body)
    for cut, coding in ((packed[:-9], "gzip"), (packed + packed[:30], "gzip"), (packed + b"rest", "gzip"), (raw[:-20], "deflate"), (raw + b"rest", "deflate")):
        record = derived(http(cut, f"Content-Encoding: {coding}", kind="text/plain"))["conversion"]
        assert dict(W.fields_of(record[3]))["WARC-Truncated"] == "length" and record[4][:100_000] == body[:100_000]


def test_digests_are_of_the_whole_body(monkeypatch):
    monkeypatch.setattr(W, "MOST_UNPACKED", 1000)
    body = b"word " * 700_000
    lines = head(WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest())
    metadata = told(derived(http(gzip.compress(body), "Content-Encoding: gzip"), lines)["metadata"])
    assert ("source-payload-digest-agrees", "true") in metadata and ("payload-digest", W.sha1_label(body)) in metadata


def test_unknown_codings_have_metadata_only():
    for coding in ("br", "gzip, br", "zstd"):
        found = derived(http(b"\x0b\x02\x80<a href=x>", f"Content-Encoding: {coding}"), head(WARC_Payload_Digest="sha1:" + "A" * 32))
        assert set(found) == {"metadata"} and ("payload-still-packed", coding) in told(found["metadata"])
        assert ("source-payload-digest-agrees", "unknown") in told(found["metadata"])
        assert not [v for n, v in told(found["metadata"]) if n in ("outlink", "conversion")]


def test_files_round_trip():
    records = [(r[3], r[4]) for r in W.derive(head(), http())]
    for compressed in (True, False):
        assert list(W.from_warc(b"".join(W.to_warc(*r, compressed) for r in records))) == records


def test_header_lines_cannot_be_smuggled_in():
    found = derived(http(b"<a href='x\r\nWARC-Type: no'>t</a>"), head(WARC_Target_URI="http://h/ a"))
    assert [n for n, _ in W.fields_of(found["metadata"][3])].count("WARC-Type") == 1
    assert [n for n, _ in told(found["metadata"])].count("WARC-Type") == 0


def test_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    sources = {}
    for r in rows:
        page = pages[r["page_id"]]
        assert r["target_uri"] == page["url"] and r["content_length"] == len(r["text"].encode())
        assert r["block_digest"] == W.sha1_label(r["text"].encode())
        sources.setdefault(r["page_id"], set()).add(r["refers_to"])
        if r["record_type"] == "conversion":
            assert r["text"] == visible_text(page["html"]) and r["content_type"] == "text/plain; charset=utf-8"
        else:
            assert r["source_digest_agrees"] is True
            assert r["source_payload_digest"] == "sha256:" + hashlib.sha256(page["html"].encode()).hexdigest()
    assert all(len(s) == 1 for s in sources.values()) and len({r["record_id"] for r in rows}) == len(rows)


class _Links(HTMLParser):
    """Links of a page by another parser."""

    def __init__(self, base):
        super().__init__()
        self.base, self.found = base, []

    def handle_starttag(self, tag, attrs):
        href = next((v for n, v in attrs if n == "href" and v), None)
        if tag == "a" and href:
            self.found.append(urljoin(self.base, href.strip()))


def test_links_of_the_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    seen = 0
    for r in op2_warc_derivatives(spark, SF).where("record_type = 'metadata'").collect():
        links = _Links(pages[r["page_id"]]["url"])
        links.feed(pages[r["page_id"]]["html"])
        assert [v for n, v in W.fields_of(r["text"]) if n == "outlink"] == links.found
        seen += len(links.found)
    assert seen > len(pages)


def test_joined_links():
    """The short ways give what ``urljoin`` gives."""
    bases = ["http://h.example", "http://h.example/", "https://h.example:8080/a/b.html?q=1#f", "http://h/a//b/../c", "HTTP://H/x/", "ftp://h/a/b",
             "", "a/b", "http://h/a;p=1/b", "http://h/a b/c", "http://h/a/./b", "http://é.example/d/", "http://h/a?x/y", "http://h/a#x/y"]
    hrefs = ["x", "x/", "x/y.html", "./x", "../x", "/x/../y", "/", "//k/z", "/x//y", "?q=2", "#top", "x?a=1/2#z", "/x?", "/x#", "x;p", "http://k",
             "http://k/", "http://k/a/../b", "https://k:1/a?b=c&d=%20#e", "HTTP://k/a", "mailto:a@b.c", "javascript:f()", " x ", "x y", "é/ü", "/é",
             "/.hidden/x", "..", ".", "a..b/c", "http://k/?", "data:x", "c:d/e", "/a:b", "x#a?b", "/x?a#b/../c", "http:x", "x\ny"]
    for base in bases:
        for href in hrefs:
            assert W._Joiner(base).joined(href) == W._joined(base, href), (base, href)


def test_fields_are_those_of_the_header_lines(spark):
    pages = spark.createDataFrame([(1, "http://h/\u2028a", "<p>source-payload-digest: x"), (2, None, None)], "page_id long, url string, html string")
    for r in W.derivatives(W.responses_from_pages(pages)).collect():
        fields = dict(W.fields_of(r["head"]))
        assert (r["record_id"], r["refers_to"], r["warc_date"]) == tuple(fields[f"WARC-{n}"] for n in ("Record-ID", "Refers-To", "Date"))
        assert r["target_uri"] == fields.get("WARC-Target-URI") and r["block_digest"] == fields["WARC-Block-Digest"]
        assert r["content_type"] == fields["Content-Type"] and r["content_length"] == int(fields["Content-Length"])
        told_of = dict(W.fields_of(bytes(r["block"]).decode())) if r["record_type"] == "metadata" else {}
        assert r["source_payload_digest"] == told_of.get("source-payload-digest")
        assert r["source_digest_agrees"] == (True if told_of else None)


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, None, None, "h"), (2, "u", "", "h"), (3, "u\r\nX: y", "<p>a", "h"), (3, "u\r\nX: y", "<p>a", "h"), (None, "v", "<p>b", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, head string")
    found = W.derivatives(W.responses_from_pages(pages)).collect()
    assert len(found) == 10
    assert sorted(bytes(r["block"]) for r in found if r["record_type"] == "conversion") == [b"", b"", b"a", b"a", b"b"]
    assert all("\r\nX:" not in r["head"] for r in found)
    none = spark.createDataFrame([(1, None, None), (2, "x", None)], "page_id long, head string, block binary")
    assert W.derivatives(none).collect() == [] and W.derivatives(none.limit(0)).collect() == []
