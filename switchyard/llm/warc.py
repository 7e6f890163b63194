"""WARC archives with revisit records for repeated payloads.

Headers (page id, digest, size) are grouped by payload digest; the smallest page
id of a digest is its original response, other pages with that digest become
revisit records without a payload.  Records are text lines of Spark's writer: a
record ends with CR LF CR LF, and the last LF is the writer's line separator.
Task commits therefore make the archives safe against lost executors, and any
file system that Spark can write to will do.

Reading walks each archive by Content-Length and joins the revisit records to
their original responses, which give the payload size.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.session import materialise

#: Payloads below this many bytes are always stored.
LEAST = 100
DATE = "2026-01-01T00:00:00Z"
_CRLF = "\r\n"
# Fixed value: the profile of the WARC 1.1 standard for equal payload digests.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload.  Repeated rows of the original page are
    responses too.  A page without an id is never an original; it revisits one if
    there is one."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
    )
    headers = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    originals = (
        headers.agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select("payload_digest", "original")
    )
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (
        rows.join(originals, "payload_digest", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("original")))
        .drop("original")
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """One column ``value``: a record without its last LF."""
    revisit = F.col("record_type") == "revisit"
    # Line ends in a URL would start a new header.
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_CRLF * 2),
    )
    block = F.concat(F.col("http"), F.when(revisit, "").otherwise(F.col("payload")))
    optional = F.when(
        revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(f"{_CRLF}WARC-Profile: {PROFILE}{_CRLF}"))
    ).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "),
        F.col("record_type"),
        F.lit(f"{_CRLF}WARC-Record-ID: "),
        _urn(F.col("page_id")),
        F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}WARC-Target-URI: "),
        uri,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.lit(_CRLF),
        optional,
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(_CRLF * 2),
    )
    return (
        resolved.withColumn("http", http)
        .withColumn("block", block)
        .select(F.concat(head, F.col("block"), F.lit("\r\n\r")).alias("value"))
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Deduplicated gzip archives below ``path``, one per partition."""
    records(resolve(pages, least)).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        yield head, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives -> a row of ``SCHEMA`` per record.  The digest of a response is taken
    from its payload, that of a revisit from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    kind = head["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head["warc-payload-digest"].partition(":")[2]
                    size = None
                    if kind == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    page, first = _number(head["warc-record-id"]), _number(head.get("warc-refers-to"))
                    rows.append((page, head["warc-target-uri"], kind, first, digest, size))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    found = materialise(files.select("content").mapInArrow(run, SCHEMA), "records")  # headers only
    originals = (
        found.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("original_bytes"))
    )
    revisits = found.where("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    return found.where("record_type != 'revisit'").select(*columns, "payload_bytes").union(
        revisits.select(*columns, F.col("original_bytes").alias("payload_bytes"))
    )
