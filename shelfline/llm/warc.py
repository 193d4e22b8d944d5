"""WARC archives: write captures as request, response and metadata records; read archives; join transactions.

Archives are written by Spark's text writer, a record for each row, with the blank line that ends a WARC
record as line separator and gzip around each file.  They are read with Spark's binary-file reader and parsed
record by record by Content-Length, so payloads may hold anything.  Any file system Spark reaches will do.
A task starts a new file after FILE_BYTES of payload, so no reader holds much more than that and one record.

Captures with equal payloads of at least `least_bytes` bytes are stored once: the one with the smallest
page_id is a response, the others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm.common import removed, stored, table, work_path

LEAST_BYTES = 100
#: Payload in one archive file, about; the last record may exceed it.
FILE_BYTES = 48 << 20
#: The capture time written when the input has none.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "type", "date", "target_uri", "concurrent_to", "refers_to", "stated_digest", "content_type")]
    + [
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)
ARROW_RECORD = pa.schema(
    [(c, pa.string()) for c in ("record_id", "type", "date", "target_uri", "concurrent_to", "refers_to", "stated_digest", "content_type")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
#: WARC header names of the string columns above.
HEADERS = {
    "record_id": "warc-record-id",
    "type": "warc-type",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "concurrent_to": "warc-concurrent-to",
    "refers_to": "warc-refers-to",
    "stated_digest": "warc-payload-digest",
    "content_type": "content-type",
}
BATCH_BYTES = 4 << 20


def _urn(hex32: F.Column) -> F.Column:
    parts = [F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, size, digest, record_id, refers_to) for every page; refers_to is set for revisits.

    The first page of each large payload is found by a plain aggregate over digests; only members of groups
    of two or more take part in the join, without their html.  A null page_id comes after all others.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = (
        pages.select("page_id", "url", payload.alias("html"))
        .withColumn("size", F.octet_length("html").cast("long"))
        .withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        .withColumn(
            "record_id",
            _urn(F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("")), "digest"))),
        )
    )
    narrow = base.filter(F.col("size") >= least_bytes).select("page_id", "digest", "record_id")
    rank = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    first = (
        narrow.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("digest", F.col("first.record_id").alias("refers_to"))
    )
    revisits = narrow.join(first, "digest").filter("record_id <> refers_to").select("record_id", "refers_to").distinct()
    return base.join(revisits, "record_id", "left")


def _record(kind: str, record_id: F.Column, headers: list[F.Column], block: F.Column) -> F.Column:
    """One record; headers are columns of whole header lines, null where a record has none."""
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        *[F.coalesce(F.concat(h, F.lit("\r\n")), F.lit("")) for h in headers],
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def records_of(captures: DataFrame) -> DataFrame:
    """A row (value) for each WARC record: request, response or revisit, and metadata of every capture."""
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target = F.concat(F.lit("WARC-Target-URI: "), safe_url)
    own = F.col("record_id")
    linked = F.concat(F.lit("WARC-Concurrent-To: "), own)
    host = F.regexp_extract(safe_url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(safe_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    answer = F.lit("Content-Type: application/http; msgtype=response")
    revisit = F.col("refers_to").isNotNull()
    main = F.when(
        revisit,
        _record("revisit", own, [target, digest, F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")), F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), answer], http),
    ).otherwise(_record("response", own, [target, digest, answer], F.concat(http, F.col("html"))))
    request = _record(
        "request",
        _urn(F.md5(F.concat(own, F.lit("request")))),
        [target, linked, F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")),
    )
    fields = F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record(
        "metadata", _urn(F.md5(F.concat(own, F.lit("metadata")))), [target, linked, F.lit("Content-Type: application/warc-fields")], fields
    )
    kept = [c for c in captures.columns if c == "chunk"]
    return captures.select(*kept, F.explode(F.array(request, main, metadata)).alias("value"))


def with_chunks(captures: DataFrame) -> DataFrame:
    """`captures` with chunk: which of its task's files a capture goes to, by the payload before it."""

    def cut(batches):
        before = 0
        for batch in batches:
            sizes = pc.if_else(pc.is_valid(batch.column("refers_to")), 0, batch.column("size")).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(sizes)
            before = int(ends[-1]) if len(ends) else before
            yield batch.append_column("chunk", pa.array((ends - sizes) // FILE_BYTES))

    return captures.mapInArrow(cut, T.StructType([*captures.schema.fields, T.StructField("chunk", T.LongType())]))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write `pages` (page_id, url, html) as gzipped WARC files below `path`.

    A null html is an empty payload; a null url leaves the target out; rows that repeat page_id, url and html
    exactly are captures of their own with equal record ids; other columns are left aside; an empty table
    writes no records; a payload of any length is one record.
    """
    writer = records_of(with_chunks(with_roles(pages, least_bytes))).write.partitionBy("chunk")
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _unzipped(content: bytes) -> bytes:
    """The archive's bytes; gzip members, one or one for each record, are taken in turn."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parsed(content: bytes, file: str):
    """Every record of one archive as a dict with the columns of RECORD.

    Bytes that are no record end the file with one row of type `malformed`, whose payload they are.
    """
    data, at = _unzipped(content), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n") if end >= 0 else []
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        length = headers.get("content-length", "")
        if not lines or not lines[0].startswith(b"WARC/") or not length.isdigit() or end + 4 + int(length) > len(data):
            yield {"type": "malformed", "payload": data[at:], "file": file, "offset": at}
            return
        block = data[end + 4 : end + 4 + int(length)]
        row = {c: headers.get(h) for c, h in HEADERS.items()} | {"fields": None, "file": file, "offset": at}
        if (kind := row["content_type"] or "").startswith("application/http"):
            row["payload"] = block.partition(b"\r\n\r\n")[2]
        else:
            row["payload"] = block
            if kind.startswith("application/warc-fields"):
                pairs = [x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x]
                row["fields"] = [(name.strip(), value.strip()) for name, _, value in pairs]
        yield row
        at = end + 4 + int(length)


def _parse(batches):
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):
            rows, size = [], 0
            for row in parsed(content.as_py(), file.as_py()):
                rows.append(row)
                size += len(row["payload"]) + 500
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_RECORD)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW_RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below `path`, with the columns of RECORD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and metadata concurrent to it.

    Columns: capture_id, target_uri, response (struct with size and digest of the payload as read, and intact: whether
    that is the digest the record states, null where it states none in SHA-256 hex or holds no payload), request
    and metadata (structs, null where the archive has none; of several, the one with the smallest record id).
    """
    detail = records.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    stated = F.regexp_extract(F.lower("stated_digest"), "^sha256:([0-9a-f]{64})$", 1)
    detail = detail.withColumn("intact", F.when((F.col("type") != "revisit") & (stated != ""), stated == F.col("digest")))
    part = F.struct("record_id", "type", "date", "refers_to", "stated_digest", "size", "digest", "intact", "fields", "payload")
    main = detail.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "target_uri", part.alias("response"))

    def linked(kind: str) -> DataFrame:
        own = detail.filter(F.col("type") == kind).filter("concurrent_to is not null")
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(part, "record_id").alias(kind))

    return main.join(linked("request"), "capture_id", "left").join(linked("metadata"), "capture_id", "left")


def unlinked(records: DataFrame) -> DataFrame:
    """Request and metadata records whose response is in none of the archives."""
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to")).distinct()
    return records.filter(F.col("type").isin("request", "metadata")).join(main, "concurrent_to", "left_anti")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back, and joined to one row for each capture.

    A payload that is not what its record's digest says ends the query with an error.
    """
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = stored(
        assembled(read_archives(spark, path)).select(
            "capture_id",
            F.col("metadata.fields")["pageId"].cast("long").alias("page_id"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("refers"),
            F.col("response.size").alias("size"),
            F.when(F.coalesce("response.intact", F.lit(True)), F.col("response.digest"))
            .otherwise(F.raise_error(F.lit("a payload differs from its stated digest"))).alias("digest"),
        ),
        "captures",
    )
    removed(spark, path)
    # Both sides of the join below are stored tables, so Spark may split the revisits of one page over tasks.
    first = captures.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("refers")).agg(
        F.min("page_id").alias("refers_to"), F.min("size").alias("first_size"), F.min("digest").alias("first_digest")
    )
    first = stored(first, "responses")
    revisit = F.col("record_type") == "revisit"
    return captures.join(first, "refers", "left").select(
        "page_id",
        F.when(revisit, F.col("first_size")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.col("first_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= {LEAST_BYTES}
"""
