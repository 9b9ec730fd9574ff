"""WARC archives of pages: written with revisits for equal payloads, read back, and joined to one row per capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_folder
from .shared import splittable

_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC 1.1 format


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base 32 of a 40-digit hexadecimal column: four digits from each five."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("uid"), F.col("page_id"), F.col("digest")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *sum(([F.substring(h, a, n), F.lit(end)] for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))), []))


def _record(kind: Column | str, headers: list[Column], content_type: str, block: Column, length: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1" + _CRLF + "WARC-Type: "), kind), *headers, F.lit("Content-Type: " + content_type), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 4000) -> None:
    """A request, a response (or revisit) and a metadata record for each row of pages (page_id, url, html), as .txt.gz files in folder.

    The payload is the html's UTF-8, empty for null. Of equal payloads of at least min_bytes the rows of the smallest
    page_id are responses and the others revisit it; null page_ids are never the smallest. Spark's text writer makes
    the files (the end of a record is its line separator), so any file system serves and a lost executor's files are
    not committed. Control characters and blanks in urls are percent-encoded; a null url becomes urn:page.
    """
    p = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "coalesce(html, '') as html")
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    firsts = p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    p = p.join(splittable(firsts.drop("n")), "digest", "left").withColumn("uid", F.monotonically_increasing_id())
    again = F.coalesce((F.col("page_id") > F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    p = p.withColumn("again", again).withColumn("uri", url)
    common = [F.concat(F.lit("WARC-Date: "), F.lit(date)), F.concat(F.lit("WARC-Target-URI: "), F.col("uri"))]
    identity = lambda kind: F.concat(F.lit("WARC-Record-ID: "), _record_id(kind))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), _record_id("response"))
    host = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    asked = F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1" + _CRLF + "Host: "), host, F.lit(_CRLF * 2))
    request = _record("request", [identity("request"), beside, *common], "application/http; msgtype=request", asked, F.octet_length(asked))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(head, F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    length = F.octet_length(head) + F.when(F.col("again"), F.lit(0)).otherwise(F.col("bytes"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")))
    profile = F.when(F.col("again"), F.lit("WARC-Profile: " + _PROFILE))  # concat_ws leaves null out
    response = _record(F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")), [identity("response"), *common, digest, profile], "application/http; msgtype=response", block, length)
    fields = F.concat_ws(_CRLF, F.concat(F.lit("page-id: "), F.col("page_id")), F.concat(F.lit("payload-length: "), F.col("bytes")), F.when(F.col("again"), F.concat(F.lit("refers-to-page: "), F.col("first"))), F.lit(""))
    metadata = _record("metadata", [identity("metadata"), beside, *common], "application/warc-fields", fields, F.octet_length(fields))
    out = p.select(F.concat_ws(_CRLF * 2, request, response, metadata).alias("value"))
    out.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def parse(content: bytes):
    """The records of one archive (plain or any gzip members): pairs of header dictionary (lower-case names) and block.

    Blocks are cut by Content-Length only, so payloads may hold anything. Broken framing raises ValueError.
    """
    source = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if content[:2] == b"\x1f\x8b" else source
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of the archives in folder, one file in memory at a time in each task.

    Rows (record_type, record_id, concurrent_to, uri, date, payload_digest, payload_bytes, payload, fields): digest and
    length are computed from a response's payload; a revisit states its digest and has null bytes; payload stays null
    without payload=True; fields are the block of a metadata record.
    """
    shape = "record_type string, record_id string, concurrent_to string, uri string, date string, payload_digest string, payload_bytes long, payload binary, fields string"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    kind, digest, n, body, fields = h.get("warc-type"), h.get("warc-payload-digest"), None, None, None
                    digest = digest.rpartition(":")[2] if digest else None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        n, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if digest not in (None, found):
                            raise ValueError(f"payload of {h.get('warc-record-id')} doesn't have its digest")
                        digest = found
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    body = body if payload else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, n, body, fields))
                    size += len(body or b"") + 300
                    if size > 8 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(run, shape)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata), each a struct of the record or null.

    Requests and metadata name the response or revisit they belong to in WARC-Concurrent-To; all three meet under that
    identifier. A record whose partners are missing still gives its row.
    """
    record = F.struct("record_type", "record_id", "uri", "date", "payload_digest", "payload_bytes", "payload", "fields")
    pick = lambda *kinds: F.max(F.when(F.col("record_type").isin(*kinds), record))
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    return keyed.groupBy("capture_id").agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))


def field(block: Column, name: str) -> Column:
    """A numeric field of a metadata block, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(block, rf"(?m)^{name}: (-?[0-9]+)\r?$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written as archives to the shared folder and read back: rows (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Repeated rows give a capture each; those of the smallest page_id of a payload are all responses. An empty table
    gives no rows. Other columns are not read.
    """
    folder = f"{work_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes)
    c = captures(read_records(pages.sparkSession, folder, payload=False))
    block = F.col("metadata.fields")
    return c.select(
        field(block, "page-id").alias("page_id"), F.coalesce("response.payload_bytes", field(block, "payload-length")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), field(block, "refers-to-page").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
