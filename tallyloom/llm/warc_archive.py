"""A content-addressed web archive: payloads once by digest, exact record headers beside them.

``archive_pages`` writes two tables. ``payloads`` holds each distinct payload
once under its SHA-256; equal digests are verified to stand for equal bytes, as
rows are folded by digest and bytes together and a digest left with two rows is
an error. ``records`` holds one row per page with the exact header block of its
WARC/1.1 record and the digest of its payload. ``read_records`` joins the two
and gives every record back byte by byte, the digest checked once more against
the bytes that were read. All of it is DataFrame functions.

Which of several equal payloads is the response is decided on rows of digests
and ids only. Copies fold before the shuffle, so a payload that a third of all
pages share moves once per task. Where the join meets such a digest, adaptive
execution splits the side of the headers, which are short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_folder, stored

# The record format (WARC/1.1) and the alphabet of base32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 160 bits are 32 digits, eight from each ten hex digits."""
    digits = []
    for part in range(4):
        number = F.conv(F.substring(F.sha1(payload), 10 * part + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31).cast("int") + 1, F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*digits)


def _record_id(page: Column, row: Column) -> Column:
    """A name for the record of a row; percent signs keep any id inside a URI."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is missing. Line breaks in a value are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _header(date: str) -> Column:
    """The header block of a record: WARC fields, an empty line, HTTP fields, an empty line."""
    first = F.col("row") == F.col("first_row")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(first, F.col("size")).otherwise(0)
    return F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.when(first, "response").otherwise("revisit")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(~first, _record_id(F.col("first_page"), F.col("first_row")))),
        _field("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", digest=sha256) -> str:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the archive's folder.

    The payload is the html in UTF-8; null counts as empty. Of payloads equal
    and of at least ``least_bytes`` bytes, the row with the smallest page_id
    becomes a response (missing ids count as largest; of repeated rows one) and
    the others revisit it; shorter ones are all responses. A missing url leaves
    its field out. An empty table gives an empty archive; further columns are
    ignored. ``digest`` maps a payload to the binary key it is stored under;
    if two payloads share a key, nothing is lost in silence: ValueError.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))

    payloads = base.select(digest(F.col("payload")).alias("digest"), "payload").distinct()
    payloads.write.parquet(f"{path}/payloads")
    stands_for = spark.read.parquet(f"{path}/payloads").groupBy("digest").count().where("count > 1")
    if not stands_for.isEmpty():
        raise ValueError("one digest stands for two payloads")

    # The number of a row tells repeated rows apart. It is written before anything is derived from it.
    facts = stored(
        base.select(
            "page_id", "url", F.monotonically_increasing_id().alias("row"), F.octet_length("payload").cast("long").alias("size"),
            digest(F.col("payload")).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"),
        ),
        "warc-facts",
    )
    place = F.struct(F.col("page_id").isNull().alias("missing"), F.col("page_id").alias("page"), "row")
    first = facts.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("of_digest")).agg(F.min(place).alias("first"))
    records = facts.join(first, (F.col("digest") == F.col("of_digest")) & (F.col("size") >= least_bytes), "left")
    records = records.withColumns({"first_page": F.when(F.col("first").isNotNull(), F.col("first.page")).otherwise(F.col("page_id")), "first_row": F.coalesce("first.row", "row")})
    records.select("page_id", "digest", _header(date).alias("header"), F.when(F.col("row") != F.col("first_row"), F.col("first_page")).alias("refers_page")).write.parquet(f"{path}/records")
    return path


def header_field(name: str, header: str = "header") -> Column:
    """The value of a WARC field, or null."""
    found = F.regexp_extract(F.col(header), rf"(?s)\A(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str, digest=sha256) -> DataFrame:
    """Every record of an archive with its payload.

    page_id, header, payload (of a revisit: that of the response it refers to),
    record_type, refers_to, and record: the record's bytes, which for a revisit
    end after its HTTP fields. Fails where a payload is missing or doesn't have
    the digest it is stored under.
    """
    headers = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").withColumnRenamed("digest", "stored_as")
    checked = payloads.where(F.when(digest(F.col("payload")) == F.col("stored_as"), True).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")).cast("boolean")))
    both = headers.join(checked, F.col("digest") == F.col("stored_as"), "left")
    kind = header_field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select(
        "page_id", "header",
        F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary")).alias("payload"),
        kind.alias("record_type"), F.col("refers_page").alias("refers_to"),
        F.concat(F.col("header").cast("binary"), body, F.lit((CRLF + CRLF).encode())).alias("record"),
    )


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Writes the records of an archive as WARC files: one a task, records one after another."""
    text = read_records(spark, path).select(F.decode("record", "UTF-8").alias("record"))
    text.select(F.expr("substring(record, 1, length(record) - 4)")).write.option("lineSep", CRLF + CRLF).text(to)


def page_records(pages: DataFrame) -> DataFrame:
    """Archives ``pages``, reads the archive back and gives each page's record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read_records(pages.sparkSession, archive_pages(pages))
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
