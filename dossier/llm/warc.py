"""WARC archives: writing captures, reading records, and assembling transactions.

Writing.  A capture becomes three records that stand together: the response (or a revisit,
where an earlier page has the same payload), the request and a metadata record, the last
two pointing at the first through WARC-Concurrent-To.  The records are built as strings and
go through Spark's own text writer, whose line separator is the blank line that ends a
WARC record.  So archives land in any store that Spark writes to, under its commit protocol.

Reading.  Archive files are taken whole, unpacked and cut by Content-Length as a stream.
Assembly joins the three kinds of records through their identifiers into one row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import cut, forget_at_exit, scratch_path, ship

VERSION = "WARC/1.1"
EOL = "\r\n"
GAP = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a string's SHA-1: 160 bits as four times eight digits."""
    digits = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column, part: str) -> Column:
    """A record's URI, the same whenever and wherever this payload of the page is written."""
    h = F.md5(F.concat_ws(":", F.lit(part), digest, F.coalesce(page_id.cast("string"), F.lit("null"))))
    groups = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing blank line; fields with null values are left out."""
    lines = [F.lit(VERSION)]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(GAP), block)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload``, ``payload_bytes``, ``payload_digest``, ``first_id`` (null unless a revisit).

    Of pages with equal payloads of at least ``least_bytes`` the smallest page_id is the
    response.  The smallest id of each payload is combined before the shuffle, and only
    payloads that occur more than once are kept: one narrow row each, written, so that their
    measured size decides whether they are broadcast.  Beyond that size the pages are joined
    to them by digest, and adaptive execution splits a payload that is common.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    firsts = own.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    firsts = cut(firsts.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    later = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(firsts, "payload_digest", "left").withColumn("first_id", later).drop("first")


def records_of(pages: DataFrame, date: str = DEFAULT_DATE) -> DataFrame:
    """One row a page: ``record``, its three WARC records as text."""
    page, digest = F.col("page_id"), F.col("payload_digest")
    own = record_id(page, digest, "capture")
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("first_id").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(GAP),
    )
    kind = F.when(revisit, "revisit").otherwise("response")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    main = _record(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", own),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), digest, "capture"))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    place = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[^:/?#]+://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)
    request = _record(
        [
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(page, digest, "request")), *common,
            ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(GAP)),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(page, digest, "metadata")), *common,
            ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat_ws(
            EOL, F.concat(F.lit("page-id: "), page.cast("string")),
            F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string")), F.lit(""),
        ),
    )
    return pages.select(F.concat_ws(GAP, main, request, metadata).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = DEFAULT_DATE, least_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files, one for each task."""
    rows = records_of(with_revisits(pages, least_bytes), date)
    rows.write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """Pieces of the archive's plain bytes; gzip members follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + CHUNK] for at in range(0, len(content), CHUNK))
        return
    view, at = memoryview(content), 0
    tool = zlib.decompressobj(31)
    while at < len(view) or tool.unconsumed_tail:
        piece = tool.unconsumed_tail or view[at : at + CHUNK]
        if not tool.unconsumed_tail:
            at += len(piece)
        yield tool.decompress(piece, CHUNK)
        if tool.eof:
            at -= len(tool.unused_data)
            tool = zlib.decompressobj(31)
    yield tool.flush()


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    pieces, held, at, ended = _unpacked(content), bytearray(), 0, False

    def need(n: int) -> bool:
        nonlocal ended
        while len(held) - at < n and not ended:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                held.extend(piece)
        return len(held) - at >= n

    while True:
        if at >= CHUNK:
            del held[:at]
            at = 0
        while need(2) and held[at : at + 2] == b"\r\n":
            at += 2
        if not need(1):
            return
        end = held.find(b"\r\n\r\n", at)
        while end < 0:
            if not need(len(held) - at + 1):
                raise ValueError("a WARC record's header is cut short")
            end = held.find(b"\r\n\r\n", at)
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        at = end + 4
        if not need(size):
            raise ValueError("a WARC record's block is cut short")
        block = bytes(held[at : at + size])
        at += size
        yield fields, block


RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, date string, target_uri string, "
    "payload_digest string, payload_bytes long, payload_sha1 string, block string, payload binary"
)


def _read(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for fields, block in parse(content.as_py()):
                kind = fields.get("warc-type", "")
                payload, text = None, None
                if kind == "response":
                    head, gap, payload = block.partition(b"\r\n\r\n")
                    payload = payload if gap else head
                elif kind in ("metadata", "request"):
                    text = block.decode("utf-8", "replace")
                rows.append(
                    (
                        kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
                        fields.get("warc-date"), fields.get("warc-target-uri"),
                        (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        None if payload is None else len(payload),
                        None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                        text, payload if keep_payload else None,
                    )
                )
                held += len(block)
                if len(rows) >= 5_000 or held >= 16 * CHUNK:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row a record of all archives under ``path``; malformed archives raise an error.

    A file is taken whole, so archives should stay well under a task's memory, as those of
    ``write_archives`` do; their plain content is streamed.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, keep_payload), RECORD)


def field(block: Column, name: str) -> Column:
    """A field of a warc-fields block, null if it isn't there."""
    found = F.regexp_extract(block, rf"(?:^|\n){name}: ?([^\r\n]*)", 1)
    return F.when(found != "", found)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id``, ``response``, ``request``, ``metadata``, two counts.

    A capture is a response or revisit record.  Requests and metadata that are concurrent to
    it are joined by its identifier; of several the one with the smallest record_id is
    nested and ``n_requests``/``n_metadata`` tell how many there are.  A capture without
    them has nulls and zeros; those concurrent to no capture give no row.  Captures that
    share an identifier stay rows of their own.
    """
    part = F.struct("record_id", "date", "target_uri", "block")

    def least(kind: str) -> Column:
        return F.min(F.when(F.col("type") == kind, part))

    def number(kind: str) -> Column:
        return F.count_if(F.col("type") == kind)

    extra = (
        records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("capture_id"))
        .agg(
            least("request").alias("request"), least("metadata").alias("metadata"),
            number("request").alias("n_requests"), number("metadata").alias("n_metadata"),
        )
    )
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        F.struct(
            "type", "date", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload_sha1", "payload"
        ).alias("response"),
    )
    return main.join(extra, "capture_id", "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(0).cast("long")) for name in ("n_requests", "n_metadata")}
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back, and return one row a page.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``.  Bytes and digest are those of the payload read back, of a revisit those
    of the response that it refers to.  Null html is the empty payload; a null url leaves out
    the target; rows that repeat a page_id stay rows of their own, each with its own payload;
    a null page_id comes back null; other columns are ignored; no pages give no rows.
    """
    spark = pages.sparkSession
    if not path:
        path = scratch_path(spark, "warc")
        forget_at_exit(spark, path)
    write_archives(pages, path)
    records = cut(read_records(spark, path))
    id_type = pages.schema["page_id"].dataType
    rows = assemble(records).select(
        "capture_id",
        field(F.col("metadata.block"), "page-id").cast(id_type).alias("page_id"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_sha1").alias("sha1"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"),
    )
    rows = cut(rows)
    # Only responses that are referred to are joined, so their measured size decides how.
    sought = rows.filter("record_type = 'revisit'").select("to").distinct()
    named = rows.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("to")).agg(
        F.min("page_id").alias("refers_to"), F.min("bytes").alias("to_bytes"), F.min("sha1").alias("to_sha1")
    )
    named = cut(named.join(sought, "to", "left_semi"))
    return rows.join(named, "to", "left").select(
        "page_id", F.coalesce("bytes", "to_bytes").alias("payload_bytes"), F.coalesce("sha1", "to_sha1").alias("payload_digest"),
        "record_type", "refers_to",
    )
