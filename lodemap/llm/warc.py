"""WARC archives written and read back, transactions put together from their records.

Writing: every row becomes a request, a response or revisit, and a metadata record that name each other as concurrent.
Of equal payloads one is kept; the others become revisits that refer to it. A Bloom filter of the payloads that several
rows have lets all other rows be written where they lie; of the rest only the least id that a task has met keeps its payload.
Records are UTF-8 or any bytes; they go through Spark's text writer, whose line end is the end of a WARC record, so archives
land wherever Spark can write, gzipped.

Reading: archives pass by as a stream of pieces and are cut by the records' own lengths, so that one record is held at a
time. Requests and metadata then meet their response through the concurrent-to identifiers, in either direction and
over one step between, and every capture becomes one nested row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, bit_table, cut, in_table, shared_folder, table

#: Shorter payloads are never replaced by a revisit.
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n\r\n"
#: What can't stand in a header's value, and the mark itself.
_ESCAPED = ("%", "\r", "\n", "\t", "\x0b", "\x0c", " ")
_FILTER_BITS = 1 << 26
#: Payload digests that a task remembers; forgetting only moves more payloads.
_HELD = 1 << 18

_MARKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()), ("n", pa.int64()), ("digest", pa.binary()), ("lead", pa.bool_())])
_MARKED_DDL = "page_id long, url string, html binary, n long, digest binary, lead boolean"


def _known(flags: np.ndarray, digests: list[bytes]) -> np.ndarray:
    parts = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, :3]
    return in_table(flags, (parts & np.uint64(_FILTER_BITS - 1)).astype(np.int64)).all(1)


def _page_key(page_id: int | None) -> tuple:
    return page_id is None, page_id or 0


def _marked(pages: DataFrame, flags, several: bool) -> DataFrame:
    """Rows whose payloads several rows may have, or (``several`` false) all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = flags.value
        least: dict[bytes, tuple] = {}
        for rows in batches:
            out: dict[str, list] = {n: [] for n in _MARKED.names}
            bodies = [html or b"" for html in rows.column(2).to_pylist()]
            digests = [sha256(html).digest() for html in bodies]
            known = _known(held, digests).tolist() if bodies else []
            for page, url, html, digest, met in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), bodies, digests, known, strict=True):
                if several != (met and len(html) >= LEAST_BYTES):
                    continue
                lead = True
                if several:
                    if len(least) > _HELD:
                        least.clear()
                    lead = digest not in least or _page_key(page) < least[digest]
                    if lead:
                        least[digest] = _page_key(page)
                for name, value in zip(_MARKED.names, (page, url, html if lead else None, len(html), digest, lead), strict=True):
                    out[name].append(value)
            if out["n"]:
                yield batch(_MARKED, **out)

    return pages.mapInArrow(run, _MARKED_DDL)


def _urn(hex_: Column) -> Column:
    """A record id from the first 32 of some hexadecimal digits."""
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hex_, i, n) for i, n in at]), F.lit(">"))


def captures_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (of responses), n, digest, record_type, record_id, refers_to (a record id) of every row."""
    spark = pages.sparkSession
    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("binary").alias("html"))
    sized = picked.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")).where(F.octet_length("html") >= LEAST_BYTES)
    order = F.struct(F.col("page_id").isNull().alias("missing"), "page_id")
    firsts = cut(sized.groupBy("digest").agg(F.min(order).alias("x"), F.count("*").alias("k")).filter("k > 1").select("digest", F.col("x.page_id").alias("least"), F.lit(True).alias("known")))
    words = [(F.conv(F.hex(F.substring("digest", i, 8)), 16, 10).cast("decimal(20,0)") % _FILTER_BITS).cast("long") for i in (1, 9, 17)]
    slots = firsts.select(F.explode(F.array(*words)).alias("slot"))
    flags = spark.sparkContext.broadcast(bit_table(slots, _FILTER_BITS))
    fresh = F.regexp_replace(F.expr("uuid()"), "-", "")
    alone = _marked(picked, flags, False).select("page_id", "url", "html", "n", "digest", F.lit("response").alias("record_type"), fresh.alias("own"), F.lit(None).cast("string").alias("other"))
    if firsts.isEmpty():
        return _identified(alone)
    groups = _marked(picked, flags, True).join(firsts, "digest", "left")
    groups = cut(groups.withColumn("candidate", F.col("known").isNull() | (F.col("lead") & F.col("page_id").eqNullSafe(F.col("least")))))
    # At most one candidate of each task. Of several (repeated rows) one is the response.
    nth = F.when(F.col("known"), F.row_number().over(Window.partitionBy("digest", "known").orderBy("url", "n"))).otherwise(1)
    candidates = groups.filter("candidate").withColumn("nth", nth)
    named = F.lower(F.hex("digest"))
    first = candidates.filter("nth = 1").select("page_id", "url", "html", "n", "digest", F.lit("response").alias("record_type"), F.when(F.col("known"), named).otherwise(fresh).alias("own"), F.lit(None).cast("string").alias("other"))
    again = groups.filter("NOT candidate").select("page_id", "url", "n", "digest").unionByName(candidates.filter("nth > 1").select("page_id", "url", "n", "digest"))
    again = again.select("page_id", "url", F.lit(None).cast("binary").alias("html"), "n", "digest", F.lit("revisit").alias("record_type"), fresh.alias("own"), named.alias("other"))
    return _identified(alone.unionByName(first).unionByName(again))


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record_id", _urn(F.col("own"))).withColumn("refers_to", F.when(F.col("other").isNotNull(), _urn(F.col("other")))).drop("own", "other")


def records(captures: DataFrame, date: str = DATE) -> DataFrame:
    """The text of a request, a response or revisit, and a metadata record of each capture, without the records' ends."""
    escaped = F.col("url")
    for c in _ESCAPED:
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))

    def record(kind: Column, record_id: Column, content: str, block: Column, *more: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", escaped), *more,
            line("Content-Type", F.lit(content)), line("Content-Length", F.octet_length(block).cast("string")), F.lit(_END), block,
        ).cast("binary")

    own, n = F.col("record_id"), F.col("n").cast("string")
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))))
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]*://[^/?#\s]*(/[^\s#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#\s]*)", 1)
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit(_END)).cast("binary")
    block = F.concat(head, F.coalesce("html", F.lit(b"")))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-length: "), n, F.lit("\r\n")).cast("binary")
    refers = [line("WARC-Refers-To", F.col("refers_to")), F.when(F.col("refers_to").isNotNull(), line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit(""))]
    concurrent = line("WARC-Concurrent-To", own)
    as_bytes = lambda c: c.cast("binary")
    response = F.concat(  # the block may be any bytes
        as_bytes(F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", escaped), *refers, digest,
                          line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(_END))), block)
    other = lambda kind: _urn(F.md5(F.concat(F.lit(kind), own)))
    return captures.select(F.explode(F.array(
        record(F.lit("request"), other("request"), "application/http;msgtype=request", request, concurrent), response,
        record(F.lit("metadata"), other("metadata"), "application/warc-fields", fields.cast("string"), concurrent),
    )).alias("record"))


def write_warc(pages: DataFrame, folder: str, date: str = DATE, **columns: str) -> None:
    """Archives of ``pages`` in ``folder``, which Spark must be able to write and which must not be there yet.

    Null payloads are empty, null addresses and ids are left out of their records. Of rows with equal payloads of at least
    :data:`LEAST_BYTES` bytes that with the smallest id is the response (null ids last; of repeated rows any one), the others
    are revisits. Empty tables give an empty folder.
    """
    text = records(captures_of(pages, **columns), date).select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", _END).option("compression", "gzip").text(folder)


_RECORD = pa.schema([
    ("file", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()),
    ("date", pa.string()), ("digest", pa.string()), ("http", pa.string()), ("n", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary()),
])
RECORD_TYPES = ("file string, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, http string, "
                "n long, payload_sha256 string, payload binary")
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)")


class RecordStream:
    """Cuts a stream of bytes into WARC records (headers, block) by their lengths; holds one record at a time."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = self.need = 0
        self.headers: dict[bytes, list[bytes]] | None = None

    def feed(self, part: bytes) -> Iterator[tuple[dict[bytes, list[bytes]], bytes]]:
        self.parts.append(part)
        self.size += len(part)
        while self.size > self.need:
            data = b"".join(self.parts)
            self.parts = [data]
            if self.headers is None:
                start = len(data) - len(data.lstrip(b"\r\n"))
                end = data.find(b"\r\n\r\n", start)
                if end < 0:
                    return
                if not data.startswith(b"WARC/", start):
                    raise ValueError(f"no WARC record where one is due: {data[start:start + 60]!r}")
                self.headers = {}
                for name, value in _HEADER.findall(data, start, end):
                    self.headers.setdefault(name.strip().lower(), []).append(value.strip())
                self._rest(data, end + 4)
                self.need = int(self.headers[b"content-length"][0]) - 1
                if self.need < 0:  # an empty block
                    headers, self.headers, self.need = self.headers, None, 0
                    yield headers, b""
            else:
                length = self.need + 1
                headers, self.headers, self.need = self.headers, None, 0
                self._rest(data, length)
                yield headers, data[:length]

    def _rest(self, data: bytes, at: int) -> None:
        self.parts = [data[at:]]
        self.size = len(self.parts[0])


def _record(file: str, headers: dict[bytes, list[bytes]], block: bytes, payloads: bool) -> tuple:
    def of(name: bytes) -> str | None:
        return headers[name][0].decode("utf-8", "replace") if name in headers else None

    http, payload, kind = None, block, of(b"warc-type")
    if (of(b"content-type") or "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("latin-1")
    whole = kind != "revisit"
    return (
        file, kind, of(b"warc-record-id"), [v.decode("utf-8", "replace") for v in headers.get(b"warc-concurrent-to", [])], of(b"warc-refers-to"),
        of(b"warc-target-uri"), of(b"warc-date"), of(b"warc-payload-digest"), http, len(payload) if whole else None,
        sha256(payload).hexdigest() if whole else None, payload if whole and (payloads or kind == "metadata") else None,
    )


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzipped archives below ``folder``; see :data:`RECORD_TYPES`.

    ``http`` are the HTTP headers; ``n`` and ``payload_sha256`` are measured, not read; revisits have no payload. Without
    ``payloads`` only those of metadata records are kept. Archives that Spark would split (not compressed) are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, RecordStream()
        out: list[tuple] = []
        held = 0
        for rows in batches:
            for name, start, piece in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                if start:
                    raise ValueError(f"{name} was split; archives must be compressed")
                if name != file:
                    _finished(file, stream)
                    file, stream = name, RecordStream()
                for headers, block in stream.feed(piece + b"\r\n\r\n"):
                    out.append(_record(file, headers, block, payloads))
                    held += len(block) if payloads else 256
                    if held > 1 << 22:
                        yield batch(_RECORD, **dict(zip(_RECORD.names, zip(*out, strict=True), strict=True)))
                        out, held = [], 0
        _finished(file, stream)
        if out:
            yield batch(_RECORD, **dict(zip(_RECORD.names, zip(*out, strict=True), strict=True)))

    pieces = spark.read.option("lineSep", _END).text(folder).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return pieces.mapInArrow(run, RECORD_TYPES)


def _finished(file: str | None, stream: RecordStream) -> None:
    if stream.headers is not None or b"".join(stream.parts).strip(b"\r\n"):
        raise ValueError(f"{file} ends within a record")


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata.

    A response or revisit is a capture; requests and metadata belong to it if either names the other as concurrent, or a
    metadata record names the request. Of several requests or metadata records that with the least id is shown and all are
    counted. Records that name no capture have a row of their own, with a null response and their record's id.
    """
    body = [c for c in found.columns if c not in ("concurrent_to", "file")]
    whole = F.struct(*body)
    heads = found.filter("type IN ('response', 'revisit')")
    captures = heads.select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    # Names of a capture: its own id and those of the records that it names.
    names = heads.select(F.col("record_id").alias("capture_id"), F.explode(F.array_union(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("name"))
    names = names.groupBy("name").agg(F.min("capture_id").alias("capture_id"))

    def met(kind: str, known: DataFrame) -> DataFrame:
        rows = found.filter(F.col("type") == kind).select("record_id", F.explode(F.array_union(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("name"), whole.alias("body"))
        of = rows.join(known, "name", "left").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"), F.min_by("body", "name").alias("body"))
        return of.withColumn("capture_id", F.coalesce("capture_id", "record_id"))

    def gathered(rows: DataFrame, name: str, count: str) -> DataFrame:
        return rows.groupBy("capture_id").agg(F.min_by("body", "record_id").alias(name), F.count("*").alias(count))

    requests = met("request", names)
    # Metadata may name the request instead.
    through = requests.select(F.col("record_id").alias("name"), "capture_id").filter("name <> capture_id")
    metadata = met("metadata", names.unionByName(through).groupBy("name").agg(F.min("capture_id").alias("capture_id")))
    none = F.lit(0).cast("long")
    return (
        captures.join(gathered(requests, "request", "n_requests"), "capture_id", "full").join(gathered(metadata, "metadata", "n_metadata"), "capture_id", "full")
        .select("capture_id", "response", "request", "metadata", F.coalesce("n_requests", none).alias("n_requests"), F.coalesce("n_metadata", none).alias("n_metadata"))
    )


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Nested rows of :func:`assemble`, without payloads, with page_id and url (of the page), record_type, payload_bytes,
    payload_digest (both of the full payload, also for revisits) and refers_to (the page of the capture that a revisit
    refers to; null where the archives don't hold it)."""
    whole = cut(assemble(cut(read_records(spark, folder, payloads=False))))
    page = F.nullif(F.regexp_extract(F.col("metadata.payload").cast("string"), r"(?m)^page-id: (-?[0-9]+)", 1), F.lit("")).cast("long")
    url = F.col("response.uri")
    for c in reversed(_ESCAPED):
        url = F.replace(url, F.lit(f"%{ord(c):02X}"), F.lit(c))
    stated = F.nullif(F.regexp_extract("response.http", r"(?mi)^Content-Length: *([0-9]+)", 1), F.lit("")).cast("long")
    rows = whole.select(
        page.alias("page_id"), url.alias("url"), F.col("response.type").alias("record_type"), F.coalesce("response.n", stated).alias("payload_bytes"),
        F.coalesce("response.payload_sha256", F.regexp_replace("response.digest", "^sha256:", "")).alias("payload_digest"), "capture_id", "response", "request", "metadata", "n_requests", "n_metadata",
    )
    # Each capture once; the revisits of one payload may be many, those AQE splits.
    pages = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    again = rows.filter("record_type = 'revisit'")
    return (
        rows.filter("record_type IS NULL OR record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
        .unionByName(again.join(pages, F.col("response.refers_to") == F.col("to"), "left").drop("to"))
    )


def with_payloads(captures: DataFrame, folder: str) -> DataFrame:
    """``captures`` with ``payload`` (binary), read from ``folder``; a revisit's is that of the response it refers to."""
    held = read_records(captures.sparkSession, folder).filter("type = 'response'").select(F.col("record_id").alias("to"), "payload")
    return captures.join(held, F.coalesce("response.refers_to", "capture_id") == F.col("to"), "left").drop("to")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_captures(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
n AS (SELECT page_id, h, strlen(h) AS n, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to
FROM n"""

QUERIES = {"op12_warc": (op12_warc, ORACLE)}
