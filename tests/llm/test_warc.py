import gzip
import hashlib
import os
import zlib

import pytest

from coalign.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [
        warc.ArcRecord("http://a.example/x y", "1.2.3.4", "20240229120000", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\nhttp://b 1 2 3 4\n", version),
        warc.ArcRecord("dns:a.example", "1.2.3.4", "199912", "text/dns", b"20240101\na.example. 1.2.3.4", version),
        warc.ArcRecord("http://a.example/", "0.0.0.0", "x", "text/html", b"", version),
    ]
    data = warc.arc_version_block("t.arc", version, "20240101000000")
    for r in records:
        data += warc.arc_record(r, "t.arc", len(data))
    read = list(warc.read_arc(data))
    assert [(r.content, r.kind, r.version) for r in read] == [(r.content, r.kind, version) for r in records]
    assert read[0].url == "http://a.example/x%20y"
    blocks = [next(warc.read_warc(warc.to_warc(r, "t.arc", i))) for i, r in enumerate(read)]
    assert [f["warc-type"] for f, _ in blocks] == ["response", "resource", "resource"]
    assert [f["warc-date"] for f, _ in blocks] == ["2024-02-29T12:00:00Z", "1999-12-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert [b for _, b in blocks] == [r.content for r in records]
    fields, block = next(warc.read_warc(warc.to_warc(read[0], "t.arc", 0, (7, "http://c/", "2024-01-01T00:00:00Z", "<urn:uuid:1>"))))
    assert fields["warc-refers-to"] == "<urn:uuid:1>"
    assert fields["warc-type"] == "revisit" and block.endswith(b"\r\n\r\n") and fields["warc-refers-to-page-id"] == "7"


def test_record_ids():
    """Captures of one address and time that differ late in their content, or are alike in two places, have ids of their own."""
    record = lambda c: warc.ArcRecord("http://a/", "1.2.3.4", "20240101000000", "text/html", c, 1)
    one, two = record(b"x" * 600 + b"1"), record(b"x" * 600 + b"2")
    assert len({warc.warc_id(one, "a", 0), warc.warc_id(two, "a", 0), warc.warc_id(one, "a", 1), warc.warc_id(one, "b", 0)}) == 4


def test_blank_in_url_and_broken_archives():
    body = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    head = f"filedesc://o 0.0.0.0 2024 text/plain {len(body)}\n".encode() + body
    (r,) = warc.read_arc(head + b"\nhttp://a/b c 0.0.0.0 20240101000000 text/html 3\nabc\n")
    assert r.url == "http://a/b c" and r.content == b"abc"
    for bad in (head + b"\nhttp://a 0.0.0.0 20240101000000 text/html 9\nabc\n", b"http://a 0.0.0.0 2024 text/html 3\nabc\n", head + b"\nhttp://a 3\nabc"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_arc(bad))


@pytest.mark.parametrize("window", [1, 7, 1 << 14])
def test_members_of_any_length(monkeypatch, window):
    monkeypatch.setattr(warc, "WINDOW", window)
    members = [b"", b"a", os.urandom(40_000), b"b" * 100_000, b"", b"c"]
    data = b"".join(gzip.compress(m, 1) for m in members)
    assert list(warc.gunzip(data)) == members
    assert list(warc.gunzip(b"")) == []
    with pytest.raises(zlib.error):
        list(warc.gunzip(data + b"no member"))


def test_members_are_read_in_linear_time(monkeypatch):
    """A decompressor copies what lies behind its member, so it must not be given the whole rest of an archive."""
    given, new = [], zlib.decompressobj

    class Counted:
        def __init__(self, *args):
            self.d = new(*args)

        def decompress(self, data):
            given.append(len(data))
            return self.d.decompress(data)

        def __getattr__(self, name):
            return getattr(self.d, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    members = [os.urandom(1000) for _ in range(500)]
    assert list(warc.gunzip(b"".join(gzip.compress(m, 1) for m in members))) == members
    assert sum(given) <= 500 * 20_000  # the rests of this archive are 128 MB


def test_pages(spark):
    big = "é" * 600
    rows = [(1, "http://a", big, 0), (2, None, big, 0), (9, "http://c d", big, 0), (9, "http://c", big, 0), (3, "u", "x" * 999, 0), (4, "u", "x" * 999, 0), (5, "u", None, 0), (6, "u", "", 0), (None, "u", big, 0)]
    rows += [(100 + i, "h", "z" * 1000, 0) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = warc.read_pages(warc.pages_to_warc(pages)).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    for r in got:
        html = next(h for k, _, h, _ in rows if k == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        top = 9 if html == big else 1599 if html[:1] == "z" else r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
    assert warc.read_pages(warc.pages_to_warc(pages.limit(0))).count() == 0
