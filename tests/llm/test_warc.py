import gzip
import uuid
from hashlib import sha256

import pytest

from lodemap.llm import warc
from lodemap.llm.warc import RecordStream, assemble, read_captures, read_records, with_payloads, write_warc


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def brute(rows):
    out = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = sorted((p is None, p or 0) for p, _, h in rows if (h or "") == (html or ""))
        first = (page is None, page or 0) == same[0]
        out.append((page, url, len(raw), sha256(raw).hexdigest(), first or len(raw) < 100, None if same[0][0] else same[0][1], raw))
    return out


def round_trip(spark, rows, folder, parts=5):
    made = spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, n string, digest int").repartition(parts)
    write_warc(made, folder)
    return with_payloads(read_captures(spark, folder), folder).collect()


LONG = "<p>" + "ä long text\r\n\r\nWARC/1.1\r\n" * 300
ROWS = [
    (1, "https://a.example/x?y#z", LONG), (2, "https://b.example", LONG), (9, None, "<p>" + "q" * 200), (3, "u r\nl\t%0A\x0b", "<p>" + "q" * 200), (4, "", "short"), (5, "https://s.example/", "short"),
    (6, "https://n.example/", None), (7, "https://n.example/", ""), (None, "https://null.example/", LONG), (None, None, "z" * 150), (None, None, "z" * 150), (8, "https://e.example", "\r\n\r\n"),
    (10, "https://e.example", "x" * 99 + "\r\n"), (11, "https://e.example", "\r\n" * 80), (12, "h", "x" * 100), (13, "h", "x" * 100), (14, "h", "x" * 99), (15, "h", "x" * 99), (16, "h", "ä" * 50), (-5, "h", "ä" * 50),
    *[(100 + i, "https://c.example/", "copy " * 40) for i in range(60)], (17, "h", "big" * 400_000 + "\r\n\r\n"), (18, "h", "nul\x00 \x85" * 30),
]


@pytest.mark.parametrize("rough", [False, True])
def test_round_trip(spark, folder, monkeypatch, rough):
    """With every bit of the filter set all rows go the way of shared payloads; the result stays the same."""
    if rough:
        table = warc.bit_table
        monkeypatch.setattr(warc, "bit_table", lambda *a: table(*a) | 255)
        monkeypatch.setattr(warc, "_HELD", 1)
    got = round_trip(spark, ROWS, folder)
    want = brute(ROWS)
    assert len(got) == len(want)
    # Of the two equal rows without an id either is the response.
    plain = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type == "response", r.refers_to, bytes(r.payload)) for r in got if r.page_id is not None]
    assert sorted(plain, key=str) == sorted((x[:5] + (None if x[4] else x[5],) + x[6:] for x in want if x[0] is not None), key=str)
    nulls = sorted((r.record_type, r.refers_to) for r in got if r.page_id is None and r.payload_bytes == 150)
    assert nulls == [("response", None), ("revisit", None)]
    assert next(r.refers_to for r in got if r.page_id is None and r.payload_bytes > 150) == 1
    assert all(r.n_requests == r.n_metadata == 1 for r in got)
    assert len({r.capture_id for r in got}) == len(got)


def test_repeated_rows(spark, folder):
    rows = [(1, "u", "same " * 30)] * 5 + [(0, None, "same " * 30)] * 3 + [(7, "u", "s")] * 3
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in round_trip(spark, rows, folder, 3))
    assert got == [(0, "response", 0), (0, "revisit", 0), (0, "revisit", 0)] + [(1, "revisit", 0)] * 5 + [(7, "response", 0)] * 3


def test_empty_table(spark, folder):
    assert round_trip(spark, [], folder) == []


def record(kind, id_, block, *headers):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *headers, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members gzipped one by one, concurrent-to in both directions and over a request, orphans, any bytes, two files."""
    http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n\xff\xfe\r\n\r\n\x00body"
    one = [
        record("warcinfo", "<i>", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "<a>", http, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <qa>", "WARC-Target-URI: http://a/"),
        record("request", "<qb>", b"GET / HTTP/1.0\r\n\r\n", "Content-Type: application/http", "warc-concurrent-to: <b>"),
        record("metadata", "<m1>", b"page-id: 5\r\n", "WARC-Concurrent-To: <qb>"), record("metadata", "<m3>", b"", "WARC-Concurrent-To: <nobody>"),
    ]
    two = [
        record("request", "<qa>", b"GET / HTTP/1.0\r\n\r\n", "Content-Type: application/http"), record("response", "<b>", http, "Content-Type: application/http"),
        record("metadata", "<m2>", b"page-id: 6\r\nq: w\r\n", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <qa>"), record("request", "<qc>", b"", "X: y"),
        record("metadata", "<m0>", b"page-id: 4\r\n", "WARC-Concurrent-To: <a>"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(two)))
    got = {r.capture_id: r for r in assemble(read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<a>", "<b>", "<m3>", "<qc>"}
    assert bytes(got["<a>"].response.payload) == b"\xff\xfe\r\n\r\n\x00body" and got["<a>"].request.record_id == "<qa>"
    assert got["<a>"].metadata.record_id == "<m0>" and got["<a>"].n_metadata == 2 and got["<b>"].metadata.record_id == "<m1>" and got["<b>"].request.record_id == "<qb>"
    assert got["<m3>"].response is None and got["<m3>"].metadata.record_id == "<m3>" and got["<qc>"].request.record_id == "<qc>"
    pages = {r.capture_id: (r.page_id, r.payload_bytes) for r in read_captures(spark, str(tmp_path)).collect()}
    assert pages["<b>"] == (5, 11) and pages["<a>"] == (4, 11)


def test_broken_archives(spark, tmp_path):
    whole = record("response", "<a>", b"x" * 50)
    for name, raw in (("cut", whole[:-20]), ("junk", b"hello\r\n\r\n" + whole)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(gzip.compress(raw))
        with pytest.raises(Exception, match="ends within a record|no WARC record"):
            read_records(spark, str(tmp_path / name)).collect()


def test_stream_in_small_parts():
    raw = b"".join(record("response", f"<{i}>", b"\r\n\r\nWARC" * i) for i in range(9))
    for step in (1, 3, 7, len(raw)):
        stream = RecordStream()
        found = [block for at in range(0, len(raw), step) for _, block in stream.feed(raw[at : at + step])]
        assert found == [b"\r\n\r\nWARC" * i for i in range(9)]
