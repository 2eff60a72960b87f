"""Operator 2, WARC archives: writing, reading back and transaction assembly.

A capture is three records: the response (or a revisit of an equal payload
captured elsewhere), the request and metadata; the last two name the first in
WARC-Concurrent-To. Each record is a gzip member of its own. Spark's text writer
lays the members down in the shared folder, whatever file system that is; its
line separator, which can't be left out, is an empty gzip member. Archives come
back as binary files, which a task takes apart member by member and cuts by
Content-Length, never by searching in payloads. Records of a capture meet in one
equi-join through the identifiers, in which payloads take no part.

Null html is the empty payload; a null url is empty. Repeated pages are captures
of their own, told apart by the record identifier, which holds the row's number.
Of equal payloads of at least ``least_bytes`` those with the smallest page_id are
responses (ties: rows that repeat it are all responses; the first url by order is
the one that others name), all others revisit it; a null page_id is never the
smallest where another is known. A long payload is one record in one file, as
whole as Spark's row; an archive is read by one task, so its size is bounded.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, few, map_batches, materialize, new_path

LEAST_BYTES = 100
FILE_BYTES = 32 << 20
CRLF = "\r\n"
VERSION = "WARC/1.1"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "id string, kind string, concurrent_to string, page_id long, uri string, digest string, refers_uri string, refers_page long, content_type string, block_bytes long, payload_bytes long, payload_digest string, payload binary"


def _uuid(kind: str) -> Column:
    """An identifier of a row's record."""
    h = F.md5(F.concat(F.lit(kind), F.lit("-"), F.col("row").cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line breaks in values become blanks."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def facts(pages: DataFrame) -> DataFrame:
    """page_id, url, html, n and digest (of the payload) of every page."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), html.alias("html"))
    return rows.select("*", F.octet_length("html").cast("long").alias("n"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))


def originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """digest, first_page and first_url of payloads that more than one row has."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = facts(pages).where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("many"))
    return first.where("many > 1").select(F.col("digest").alias("same"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))


def records(pages: DataFrame, first: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Column value: response or revisit, request and metadata of every page, as text.

    first: what ``originals`` says. ``pages`` is gone through once, so a row's number
    holds for its three records, however ``pages`` is made.
    """
    rows = facts(pages)
    again = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    joined = rows.join(first, (F.col("n") >= least_bytes) & (F.col("digest") == F.col("same")), "left")
    about = joined.select("page_id", "url", "html", "n", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first_page")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_uri"))
    about = about.withColumn("row", F.monotonically_increasing_id())
    revisit = F.col("kind") == "revisit"
    date = _line("WARC-Date", F.lit("2000-01-01T00:00:00Z"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("n")), F.lit(CRLF))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    own = _uuid("capture")

    def record(kind: Column, ident: Column, content: Column, content_type: str, *lines: Column) -> Column:
        first = F.concat(F.lit(VERSION + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", ident), date, _line("WARC-Target-URI", F.col("url")))
        return F.concat(first, *lines, _line("Content-Type", F.lit(content_type)), _line("Content-Length", F.octet_length(content)), F.lit(CRLF), content, F.lit(CRLF + CRLF))

    again = [_line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)), _line("WARC-Refers-To-Target-URI", F.col("refers_uri")), _line("WARC-Refers-To-Page", F.col("refers_to"))]
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    main = record(F.col("kind"), own, block, "application/http; msgtype=response", digest, *again, _line("WARC-Page-ID", F.col("page_id")))
    asked = F.concat(F.lit("GET "), F.regexp_replace("url", r"\s+", "%20"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = record(F.lit("request"), _uuid("request"), asked, "application/http; msgtype=request", _line("WARC-Concurrent-To", own))
    fields = F.concat(_line("payload-bytes", F.col("n")), _line("payload-digest", F.col("digest")))
    metadata = record(F.lit("metadata"), _uuid("metadata"), fields, "application/warc-fields", _line("WARC-Concurrent-To", own))
    return about.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of all pages under ``path``, of about ``file_bytes`` of records each;
    none has more than 16 times that, however the sizes of pages differ."""
    first = materialize(originals(pages, least_bytes), "originals")
    mean, most = facts(pages).agg(F.avg("n"), F.max("n")).first()
    per_file = max(3, 3 * int(min(file_bytes / ((mean or 0) + 1500), 16 * file_bytes / ((most or 0) + 1500))))

    def make():
        def member(record: bytes) -> bytes:
            z = zlib.compressobj(3, wbits=31)
            return z.compress(record) + z.flush()

        return lambda batch: pa.RecordBatch.from_arrays([pa.array([member(x.as_buffer()) for x in batch.column(0)], pa.binary())], ["value"])

    packed = map_batches(records(pages, few(first), least_bytes), make, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", per_file).text(path)
    discard(first)


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive hold, without the empty ones."""
    view, at, step = memoryview(data), 0, 1 << 14
    while at < len(view):
        z, out = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            part = view[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if whole := b"".join(out):
            yield whole


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    for record in members(data):
        at = 0
        while at < len(record):
            end = record.index(b"\r\n\r\n", at)
            lines = record[at:end].decode("utf-8", "replace").split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError("a record without its version line")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            start = end + 4
            stop = start + int(head["content-length"])
            yield head, record[start:stop]
            at = stop + 4


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``, as RECORD; payloads of
    responses, and their lengths and digests, are taken from what was read."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
    number = lambda x: int(x) if x else None

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind = head["warc-type"]
        payload = None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = None if payload is None else hashlib.sha256(payload).hexdigest()
        length = None if payload is None else len(payload)
        if kind == "revisit":
            length = int(block.decode().partition("Content-Length: ")[2].partition(CRLF)[0])
        said = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        return (head["warc-record-id"], kind, head.get("warc-concurrent-to"), number(head.get("warc-page-id")), head.get("warc-target-uri"), said, head.get("warc-refers-to-target-uri"), number(head.get("warc-refers-to-page")), head.get("content-type"), len(block), length, digest, payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(row(head, block))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), lambda: run, RECORD, whole=True)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, metadata (arrays of the
    records that are concurrent to it). Sides whose capture is missing drop out."""
    fields = [c for c in found.columns if c != "payload"]
    side = found.where("kind in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("id"))
    side = side.agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(*fields)))).alias(k) for k in ("request", "metadata")))
    main = found.where("kind in ('response', 'revisit')").select("id", F.struct(*found.columns).alias("capture"))
    return main.join(side, "id", "left")


def warc_captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and assembles captures."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    found = materialize(read(spark, path, with_payload=False).drop("payload"), "records")
    delete(spark, path)
    return assemble(found)
