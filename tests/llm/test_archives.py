"""Archives: both ARC versions and WARC, by round trips and against plain grouping."""

import gzip
import hashlib

import pytest

from humsearch.llm import archives

BODY = "<html>" + "p" * 1500 + "é</html>"
PAGES = "refers_to long, html string, page_id long, url string, payload_bytes string, content binary"


def naive(rows):
    """rows (page_id, html)"""
    out, groups = [], {}
    for page_id, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        for k, i in enumerate(ids):
            again = len(payload) >= 1000 and k > 0
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(0, html, i, url, "x", b"y") for i, url, html in rows], PAGES)


ROWS = [
    (1, "http://a.example/x y", BODY), (2, "http://a.example/2", BODY), (3, None, BODY), (3, None, BODY), (None, "http://n.example/", BODY),
    (4, "", None), (5, "http://e.example/", ""), (6, "http://e.example/\n\t", "short"), (7, "u", "short"),
    (8, "http://l.example/", "z" * 2_500_000), (9, "http://l.example/", "z" * 2_500_000),
    (10, "http://é.example/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "q" * 1000),
    (11, "http://d.example/", "filedesc://x 0.0.0.0 20010101000000 text/plain 3\n1 0 x\n"), (None, None, "w" * 1200), (None, None, "w" * 1200), (-12, "x", "m" * 999),
]


def test_pages_to_warc_and_back(spark):
    df = pages(spark, ROWS)
    want = naive([(i, html) for i, _, html in ROWS])
    got = sorted((tuple(r) for r in archives.archived(df).collect()), key=repr)
    assert got == want
    assert archives.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions(spark, tmp_path, version, monkeypatch):
    monkeypatch.setattr(archives, "RUNS_PER_FILE", 2)
    path = str(tmp_path / "warc")
    arc = archives.arc_archives(pages(spark, ROWS).repartition(3), version)
    # on disk, as files of which every second one is compressed
    (tmp_path / "arc").mkdir()
    for k, r in enumerate(arc.collect()):
        (tmp_path / "arc" / r["path"]).write_bytes(gzip.compress(r["content"]) if k % 2 else bytes(r["content"]))
    archives.write_warc(spark.read.format("binaryFile").load(str(tmp_path / "arc")), path)
    got = archives.warc_pages(spark, path).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == naive([(i, html) for i, _, html in ROWS])
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(ROWS)
    for r in got:
        if r["record_type"] == "revisit":
            of = ids[r["refers_to_id"]]
            assert of["record_type"] == "response" and of["page_id"] == r["refers_to"] and of["payload_digest"] == r["payload_digest"]
    files = spark.read.format("binaryFile").load(path).collect()
    for f in files:
        records = list(archives.read_warc(f["content"], f["path"]))
        assert records[0][0]["warc-type"] == "warcinfo" and gzip.decompress(f["content"]).startswith(b"WARC/1.1\r\n")
        for fields, block in records:
            if "warc-block-digest" in fields:
                assert fields["warc-block-digest"] == archives._sha1(hashlib.sha1(block).hexdigest())


def test_header_lines_of_versions():
    first = archives.version_block("a.arc", 1) + archives.arc_record("http://a/ b", b"one\ntwo\n", 1, "a.arc", 0)
    second = archives.version_block("b.arc", 2) + b"\n\n" + archives.arc_record("dns:a", b"x", 2, "b.arc", 9, mime="text/dns; charset=utf-8") + archives.arc_record("u", b"", 2, "b.arc", 9)
    (one,) = archives.read_arc(first, "a.arc")
    assert (one.url, one.block, one.code, one.mime) == ("http://a/%20b", b"one\ntwo\n", None, "text/html")
    dns, none = archives.read_arc(gzip.compress(second[:90]) + gzip.compress(second[90:]), "b.arc")
    assert (dns.mime, dns.code, dns.block, none.block) == ("text/dns; charset=utf-8", "200", b"x", b"")
    assert second[dns.offset :].startswith(b"dns:a ")


@pytest.mark.parametrize("cut, why", [(b"", "no version block"), (b"3", "unknown version"), (b"short", "shorter than declared"), (b"line", "not a header line")])
def test_broken_arc(spark, cut, why):
    good = archives.version_block("a.arc", 1) + archives.arc_record("u", b"block", 1, "a.arc", 0)
    bad = {b"": good[20:], b"3": good.replace(b"\n1 0 pages", b"\n3 0 pages"), b"short": good[:-4], b"line": good.replace(b" 0.0.0.0 20010101000000 text/html", b"")}[cut]
    with pytest.raises(archives.ArchiveError, match=why):
        list(archives.read_arc(bad, "a.arc"))
    with pytest.raises(Exception, match=why):
        archives.parse_arc(spark.createDataFrame([("a.arc", bytearray(bad))], "path string, content binary")).collect()


@pytest.mark.parametrize("bad, why", [(b"HTTP/1.1\r\n", "no record"), (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", "no length"), (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", "shorter")])
def test_broken_warc(bad, why):
    with pytest.raises(archives.ArchiveError, match=why):
        list(archives.read_warc(bad))


def test_wrong_digest_is_found():
    record = archives.warc_record([("WARC-Type", "response"), ("WARC-Payload-Digest", archives._sha1(hashlib.sha1(b"b").hexdigest()))], b"a")
    ((fields, block),) = archives.read_warc(record + b"\r\n\r\n")
    with pytest.raises(archives.ArchiveError, match="another payload"):
        archives._told("f", fields, block)


@pytest.mark.parametrize("date, want", [("19960923142103", "1996-09-23T14:21:03Z"), ("199609231421", "1996-09-23T14:21:00Z"), ("19960923", "1996-09-23T00:00:00Z"), ("1996", "1996-01-01T00:00:00Z"), ("199609x", "1996-09-01T00:00:00Z"), ("-", "2001-01-01T00:00:00Z"), ("19960923142", "1996-09-23T14:00:00Z")])
def test_timestamps(date, want):
    assert archives.timestamp(date) == want


def test_types():
    http = archives.http_block(5, b"x")
    for url, block, kind in (("http://a", http, "http"), ("dns:a", b"text", "response"), ("ftp://a", b"bytes", "resource")):
        row = archives._parsed("a.arc", archives.ArcRecord(0, url, "1.2.3.4", "2001", "text/plain", None, block), True)
        assert row[7] == kind and row[9] == (1 if kind == "http" else len(block))
        record = archives._converted("a.arc", 0, url, "1.2.3.4", "2001-01-01T00:00:00Z", "text/plain", kind, block, row[10], None)
        assert (b"WARC-Type: resource" in record) == (kind == "resource") and b"WARC-IP-Address: 1.2.3.4" in record
