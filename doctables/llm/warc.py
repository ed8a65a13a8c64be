"""Content-addressed WARC archive.

An archive is two tables in a shared folder: ``payloads`` holds each different payload once, compressed, under its
SHA-256; ``headers`` holds for every record its exact header block and the digest of its
payload. Reading joins the two, checks each payload against its digest, and gives back the original
records byte by byte. Only digests are grouped, never payloads of equal records, so that a page with very many
copies costs one stored payload and one small row a copy; what is shuffled of a payload is its compressed form.

``write_warc`` writes an archive's records as WARC 1.1 files, ``read_warc`` reads such files."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import shared_folder, table
from .registry import query

CRLF = "\r\n"
#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
LEVEL = 3
#: Rows compressed or restored at a time.
ROWS = 64


def base32_of_hex(hex40: Column) -> Column:
    """RFC 4648 base32 of 40 hexadecimal digits: 10 of them are 8 digits to the base 32."""
    parts = [F.lpad(F.conv(F.substring(hex40, start, 10), 16, 32), 8, "0") for start in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uuid(column: Column) -> Column:
    """A name for a record, always the same for the same id."""
    h = F.md5(column.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (s, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if k else []) + [F.substring(h, s, n)]], F.lit(">"))


def numbered_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    clean = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]+", "%0A")
    return pages.select(F.col(page_id).alias("page_id"), clean.alias("url"), payload.alias("payload")).withColumn("payload_key", F.sha2("payload", 256))


def compressed(payloads: DataFrame) -> DataFrame:
    """payload_key, page_id and the payload, compressed before it is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("payload_key"), rows.column("page_id"), pa.array([pack.compress(x.as_py()) for x in rows.column("payload")], pa.binary())],
                    names=["payload_key", "page_id", "payload"])

    rows = payloads.select("payload_key", "page_id", "payload")
    return rows.mapInArrow(work, rows.schema)


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
            date: str = DATE) -> str:
    """Write the archive of ``pages`` to ``folder`` and return that.

    Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is the response and
    the others revisit it; records with smaller payloads are all responses. Null html and null url count
    as empty. Rows that repeat a page id with the same payload are records of their own, of which one is
    the response; a null id comes before all others. An empty table makes an empty archive."""
    records = numbered_pages(pages, page_id, url, html)
    facts = records.select(
        "page_id", "url", "payload_key", F.length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    # Equal rows of one page get numbers; the response is number 1 of the page with the largest id.
    facts = facts.withColumn("copy", F.row_number().over(W.partitionBy("page_id", "payload_key").orderBy(F.col("url").desc())))
    largest = facts.groupBy("payload_key").agg(F.max("page_id").alias("first_id"))
    facts = facts.join(largest, "payload_key")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    revisit = (F.col("payload_bytes") >= min_bytes) & ~is_first
    name = record_uuid(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_key", "copy"))
    first_name = record_uuid(F.concat_ws("/", F.coalesce(F.col("first_id").cast("string"), F.lit("null")), "payload_key", F.lit(1)))

    def line(key: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{key}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))

    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", name), line("WARC-Date", date),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", first_name), line("WARC-Profile", PROFILE))).otherwise(F.lit("")),
        line("Content-Type", "text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit(CRLF))
    facts.select(
        "page_id", name.alias("record_id"), "payload_key", header.cast("binary").alias("header"),
    ).write.mode("overwrite").parquet(f"{folder}/headers")
    # One row per different payload: copies go before anything is dealt out, in each task and then by digest.
    once = compressed(records).withColumn("_n", F.row_number().over(W.partitionBy("payload_key").orderBy(F.col("page_id").desc()))).where("_n = 1")
    once.select("payload_key", "payload").write.mode("overwrite").parquet(f"{folder}/payloads")
    return folder


def field(name: str, header: Column | str = "header") -> Column:
    """A header field of a record, or null."""
    text = (F.col(header) if isinstance(header, str) else header).cast("string")
    found = F.regexp_extract(text, f"(?i)(?:^|\\n){re.escape(name)}: *([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def restored(stored: bytes, key: str) -> bytes:
    """A payload from its compressed form; fails where its bytes don't have their SHA-256."""
    try:
        data = zstandard.ZstdDecompressor().decompress(stored, allow_extra_data=False)
    except zstandard.ZstdError:
        data = None
    if data is None or hashlib.sha256(data).hexdigest() != key:
        raise ValueError(f"stored payload does not match its digest {key}")
    return data


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: page_id, record_id, payload_key, header, payload (for a revisit: of the record it refers to) and
    that payload's payload_bytes and payload_digest. Headers meet their payloads by digest; damaged payloads fail."""
    headers = spark.read.parquet(f"{folder}/headers")
    kept = headers.columns
    schema = T.StructType([
        *headers.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                data = [restored(x.as_py(), key.as_py()) for x, key in zip(rows.column("payload"), rows.column("payload_key"), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in kept], pa.array(data, pa.binary()), pa.array([len(x) for x in data], pa.int64()),
                    pa.array([sha1_base32(x) for x in data], pa.string())], names=schema.names)

    return headers.join(spark.read.parquet(f"{folder}/payloads"), "payload_key").select(*kept, "payload").mapInArrow(work, schema)


def record_text() -> Column:
    """A record as it stands in a file: header block and payload, none for a revisit."""
    body = F.when(field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    return F.concat(F.col("header").cast("string"), body)


def write_warc(spark: SparkSession, folder: str, target: str, compression: str = "none") -> None:
    """The archive's records as WARC files: header block, payload (none for a revisit), two line ends each.

    Spark's text writer puts the two line ends behind each record; the files can have any codec it knows."""
    records(spark, folder).select(record_text().alias("value")).write.mode("overwrite").option(
        "lineSep", CRLF + CRLF).option("compression", compression).text(target)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and payload of every record of WARC files, each file in one task and record by record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                data, at = value.as_py(), 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    header = data[at:end + 4]
                    length = int(re.search(rb"(?i)\nContent-Length: *(\d+)", header)[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([header], pa.binary()), pa.array([data[end + 4:end + 4 + length]], pa.binary())], names=["header", "payload"])
                    at = end + 4 + length + 4

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "header binary, payload binary")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@query("op3_content_archive", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, payload,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           ((('0x' || substr(hex, 1 + CAST(floor(i / 4) AS BIGINT) * 5, 5))::BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM w""")
def op3_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column is read off the rebuilt records: type, length and digest off their bytes, a revisit's off the payload that
    the join brings, both checked against what the header declares."""
    folder = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_folder(spark), min_bytes=0)
    # A record's text is cut again where its header says it ends.
    read = records(spark, folder).select("page_id", "record_id", "payload", record_text().alias("record"))
    head_end = F.locate(CRLF + CRLF, F.col("record")) + 3
    header = F.substring(F.col("record"), F.lit(1), head_end)
    body = F.substring(F.col("record"), head_end + 1, F.length("record")).cast("binary")
    read = read.select(
        "page_id", "record_id", field("WARC-Type", header).alias("record_type"), field("WARC-Refers-To", header).alias("refers"),
        field("WARC-Payload-Digest", header).alias("declared"), field("Content-Length", header).cast("long").alias("length"),
        body.alias("body"), "payload")
    whole = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    read = read.select(
        "page_id", "record_id", "record_type", "refers", "declared", (F.length("body") == F.col("length")).alias("same_length"),
        F.length(whole).cast("long").alias("payload_bytes"), base32_of_hex(F.sha1(whole)).alias("payload_digest"))
    good = F.col("same_length") & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("declared"))
    bad = F.raise_error(F.concat(F.lit("record differs from its header: "), "record_id")).cast("string")
    read = read.withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(bad))
    # A response that is referred to by its record id gives the id of its page.
    names = spark.read.parquet(f"{folder}/headers").where(field("WARC-Type") == "response").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return read.join(names, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
