"""WARC archives: pages as transactions of request, response or revisit, and metadata records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm.common import fresh_path, keyed, ship, written

#: A record ends in two line ends; Spark's text writer puts them after each row.
END = "\r\n\r\n"
#: Records of one archive, which one task reads as a whole; pages of more than LARGE bytes have archives of their own.
RECORDS_PER_FILE, LARGE = 1500, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}/{key}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block


def clean_uri(url: str | None) -> str:
    """A header line can't hold line breaks: they are percent-encoded; null: a URI of its own."""
    return (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")


def transaction(key: int, page: str | None, url: str | None, payload: bytes, first: int) -> list[bytes]:
    """The request, response (or revisit of the response of `first`) and metadata records of a page.

    The page's id stands percent-encoded in the metadata, so that blanks at its ends stay; a null id is not there."""
    uri, mark = clean_uri(url), digest(payload)
    own = record_id(key, "capture")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    marks = [("WARC-Payload-Digest", f"sha1:{mark}"), ("Content-Type", "application/http; msgtype=response")]
    if key == first:
        capture = record("response", [("WARC-Record-ID", own), *common, *marks], http + payload)
    else:
        capture = record("revisit", [("WARC-Record-ID", own), *common, ("WARC-Refers-To", record_id(first, "capture")), ("WARC-Profile", PROFILE), *marks], http)
    ask = f"GET {uri} HTTP/1.1\r\n\r\n".encode()
    request = record("request", [("WARC-Record-ID", record_id(key, "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], ask)
    metadata = record("metadata", [("WARC-Record-ID", record_id(key, "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], b"" if page is None else f"page-id: {quote(page)}\r\n".encode())
    return [request, capture, metadata]


def unzipped(data: bytes) -> bytes:
    """The bytes of an archive: gzip members, one or one for each record, are joined; others stay as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out += [z.decompress(data), z.flush()]
        data = z.unused_data
    return b"".join([*out, data])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by Content-Length alone: payloads may hold anything."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at)
        lines = data[at:body].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[body + 4 : body + 4 + size]
        at = body + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {size} bytes isn't ended at byte {at}")
        at += 4


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("_b").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(list(map(digest, payloads)), pa.string()), pa.array(list(map(len, payloads)), pa.int64())], ["_k", "_digest", "_size"])


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("_k", "_id", "_url", "_b", "_first")]
        rows = []
        size = 0
        for row in zip(*cols, strict=True):
            rows += transaction(*row)
            size += len(row[3])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])
                rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])


FIELDS = "kind string, id string, concurrent_to string, refers_to string, uri string, payload_digest string, page string, http_length long, payload_bytes long, payload_sha1 string"


def _records(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string()] + [pa.binary()] * payloads
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payloads

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers["warc-type"]
        http_length = payload = page = None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            lengths = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            http_length = int(lengths[0]) if lengths else len(payload)
        elif kind == "metadata":
            page = next((unquote(x[8:].strip().decode()) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
        seen = kind == "response"
        mark = headers.get("warc-payload-digest")
        return (kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), mark and mark.partition(":")[2], page, http_length, len(payload) if seen else None, digest(payload) if seen else None, *([payload if seen else None] * payloads))

    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows, size = [], 0
            for headers, block in parse(unzipped(data)):
                rows.append(row(headers, block))
                size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes three records a page to archives under `path`, with Spark's text writer (task commits and all), gzipped
    as whole files unless `compression` is none.

    Of equal payloads of at least `min_bytes` bytes (null: empty), the page with the smallest id holds the
    response and the others revisit it. The first of each digest comes from an aggregate over digests, joined
    back: a payload that a third of all pages share is one row of it. Repeated or null ids count as rows.
    """
    ship(pages.sparkSession)
    # the URL goes with its row, so that rows which share id and payload keep theirs
    rows, _ = keyed(pages, id_col, payload_col, (url_col,))
    urls = rows.select("_k", F.col("_id").cast("string").alias("_id"), F.col("_m0").cast("string").alias("_url"), F.coalesce("_text", F.lit("")).cast("binary").alias("_b"))
    marks = written(urls.select("_k", "_b").mapInArrow(_digests, "_k long, _digest string, _size long"), "digests")
    # the first of a digest goes to the others by a table of digests that occur more than once; others are their own
    firsts = marks.where(F.col("_size") >= min_bytes).groupBy("_digest").agg(F.min("_k").alias("_f"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_digest", "_f")
    known = marks.join(firsts, "_digest", "left").select("_k", "_size", F.when(F.col("_size") >= min_bytes, F.coalesce("_f", "_k")).otherwise(F.col("_k")).alias("_first"))
    records = urls.join(known, "_k").select("_k", "_id", "_url", "_b", "_first", "_size")
    large = F.col("_size") > LARGE

    def write(some: DataFrame, per_file: int, mode: str) -> None:
        lines = some.select("_k", "_id", "_url", "_b", "_first").mapInArrow(_transactions, "value string")
        lines.write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", compression).text(path)

    write(records.where(~large), RECORDS_PER_FILE, "errorifexists")
    if (marks.agg(F.max("_size")).first()[0] or 0) > LARGE:
        write(records.where(large), 3, "append")


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives under `path`; `payloads` adds the responses' payload bytes."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(partial(_records, payloads), FIELDS + ", payload binary" * payloads)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit, and the request and metadata concurrent to it.

    Columns: id, kind, page, uri, payload_bytes, payload_digest, refers_to (the record id), request (struct of
    id, uri), metadata (struct of id, page). Captures without a request or metadata record have nulls there.
    """
    main = records.where(F.col("kind").isin("response", "revisit"))
    about = lambda kind: records.where(F.col("kind") == kind).groupBy("concurrent_to")
    asked = about("request").agg(F.min(F.struct("id", "uri")).alias("request"))
    told = about("metadata").agg(F.min(F.struct("id", "page")).alias("metadata"))
    out = main.join(asked.withColumnRenamed("concurrent_to", "id"), "id", "left").join(told.withColumnRenamed("concurrent_to", "id"), "id", "left")
    size = F.coalesce("payload_bytes", "http_length")
    return out.select("id", "kind", F.col("metadata.page").alias("page"), "uri", size.alias("payload_bytes"), F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"), "refers_to", "request", "metadata")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """`id, payload_bytes, payload_digest, record_type, refers_to`, written to archives and read back from them."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col, min_bytes)
    seen = written(captures(read_records(spark, path)).select("id", "kind", "page", "payload_bytes", "payload_digest", "refers_to"), "captures")
    kind = pages.schema[id_col].dataType
    origin = seen.where("kind = 'response'").select(F.col("id").alias("refers_to"), F.col("page").cast(kind).alias("_origin"))
    columns = (F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"))
    # responses refer to nothing: they stay out of the join, whose null key would hold them all
    first = seen.where("kind = 'response'").select(*columns, F.lit(None).cast(kind).alias("refers_to"))
    later = seen.where("kind <> 'response'").join(origin, "refers_to", "left").select(*columns, F.col("_origin").alias("refers_to"))
    return first.union(later)
