"""WARC archives of page captures, and their assembly into nested rows.

Writing: each page becomes a request, a response (or revisit) and a metadata
record that name the response in WARC-Concurrent-To. The records are text, so
Spark's own text sink writes them, gzipped, with CRLF CRLF after each, in one
pass; there is a file for each task.

Reading: a file streams by in parts that end with CRLF CRLF and is parsed by
Content-Length, so payloads may hold anything and files may have any size; a
record at a time is in memory. Records of one capture meet by the identifier
of the response and give one nested row (request, response, metadata).

Of equal payloads of at least ``min_revisit_bytes``, the one with the largest
page_id is a response and the others are revisits of it, without payload.

Defined results: null html counts as empty; null page_id is allowed (smaller
than any other); repeated rows are captures of their own and of equal type; a
null URL is left out of the records; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_REVISIT_BYTES = 1000
#: What ends a record, and the headers of one.
END = b"\r\n\r\n"
#: Bytes of records that are handed on together.
BATCH_BYTES = 8_000_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "capture string, kind string, record_id string, uri string, digest string, page_id long, "
    "refers_to long, payload_length long, payload_sha1 string, payload binary"
)


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), record_id, F.lit(">"))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _captures(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("digest")
    )
    groups = (
        rows.filter(F.col("bytes") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "original")
    )
    # Written, so that the join has two plain sides: rows of a page with very many copies can be split then.
    groups = materialize(groups, "digests")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(groups, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("original")))


def warc_text(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(value): the three records of each page as one text, without the last CRLF CRLF."""
    rows = _captures(pages, min_revisit_bytes).withColumns({k: F.uuid() for k in ("id", "request_id", "metadata_id")})
    # A line break would end a header early; percent-encoding is what a URL has for it.
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    parts = F.regexp_extract(url, r"^[^:]*://([^/?#]*)([^#]*)", 1), F.regexp_extract(url, r"^[^:]*://([^/?#]*)([^#]*)", 2)
    target = F.when(parts[1].startswith("/"), parts[1]).otherwise(F.concat(F.lit("/"), F.coalesce(parts[1], F.lit(""))))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
        F.when(is_revisit, F.lit("")).otherwise(F.col("payload")),
    )
    page = F.concat(F.lit("page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    about = F.concat(
        page,
        F.lit("payload-length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n"),
        F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    with_uri = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)]
    concurrent = [("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), F.col("id"), F.lit(">")))]
    response = _record(
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.col("id"),
        [
            *with_uri,
            ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        http,
    )
    request = _record(
        F.lit("request"),
        F.col("request_id"),
        [*with_uri, *concurrent, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(parts[0], F.lit("")), F.lit("\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"), F.col("metadata_id"), [*with_uri, *concurrent, ("Content-Type", F.lit("application/warc-fields"))], about
    )
    return rows.select(F.concat_ws("\r\n\r\n", response, request, metadata).alias("value"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the archives into the folder ``path``."""
    text = warc_text(pages, min_revisit_bytes)
    text.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class RecordStream:
    """Takes the bytes of an archive part by part, and gives its records."""

    def __init__(self) -> None:
        self.rest, self.headers = bytearray(), None

    def feed(self, part: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of each record that is complete now."""
        self.rest += part
        at = 0
        while True:
            if self.headers is None:
                while self.rest[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                end = self.rest.find(END, at)
                if at < len(self.rest) and not self.rest.startswith(b"WARC/"[: len(self.rest) - at], at):
                    raise ValueError(f"not a WARC record: {bytes(self.rest[at : at + 40])!r}")
                if end < 0:
                    break
                lines = bytes(self.rest[at:end]).split(b"\r\n")[1:]
                pairs = [line.partition(b":") for line in lines]
                self.headers = {name.decode().lower(): value.strip().decode() for name, _, value in pairs}
                at = end + len(END)
            size = int(self.headers["content-length"])
            if len(self.rest) - at < size:
                break
            headers, self.headers = self.headers, None
            yield headers, bytes(self.rest[at : at + size])
            at += size
        del self.rest[:at]

    def close(self) -> None:
        if self.headers is not None or self.rest.strip():
            raise ValueError("the archive ends within a record")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzipped or not."""
    stream = RecordStream()
    yield from stream.feed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    stream.close()


def _fields(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    own = headers["warc-record-id"]
    page = refers = length = sha1 = payload = None
    if kind == "metadata":
        about = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
        page, refers, length = (int(about[k]) if about.get(k) else None for k in ("page", "refers-to-page", "payload-length"))
    elif kind in ("response", "request"):
        payload = block.partition(b"\r\n\r\n")[2]
        if kind == "response":
            length, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
    return (
        headers.get("warc-concurrent-to", own), kind, own, headers.get("warc-target-uri"),
        headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, page, refers, length, sha1, payload,
    )


def read_records(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    kinds = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, rows, size = None, RecordStream(), [], 0
        for batch in batches:
            for part, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    stream.close()
                    now, stream = name, RecordStream()
                for headers, block in stream.feed(part.as_py() + END):
                    rows.append(_fields(headers, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        stream.close()
        if rows:
            yield batch_of(rows)

    # Gzipped files are not split, so a task gets the parts of a file in order.
    parts = spark.read.option("lineSep", END.decode()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    return parts.select(F.col("value").cast("binary"), "_metadata.file_path").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: its records meet by the identifier that
    request and metadata are concurrent to. Without ``payload`` only what was
    measured of it while reading (length and SHA-1) travels to the others."""

    def one(kinds: list[str], *fields: str) -> Column:
        return F.first(F.when(F.col("kind").isin(kinds), F.struct(*fields)), ignorenulls=True)

    response = ["record_id", "kind", "uri", "digest", "payload_length", "payload_sha1", *["payload"] * payload]
    return records.groupBy("capture").agg(
        one(["request"], "record_id", "uri").alias("request"),
        one(["response", "revisit"], *response).alias("response"),
        one(["metadata"], "record_id", "page_id", "refers_to", "payload_length").alias("metadata"),
    )
