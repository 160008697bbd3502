"""A content-addressed WARC archive.

``write`` stores the bytes of each payload once, under their SHA-256, and the exact header of every
record (WARC fields and HTTP header) in a table of its own. Of the records of equal payloads, the one
with the largest page id is the response and the others are revisits of it. ``read`` joins headers and
payloads on the digest, checks every payload against its digest, and gives back whole records.

All of it is DataFrame expressions. Only digests are grouped; a payload that a third of all records
share is stored once, and the join that reads it can be split on the side of the headers.

Defined results: a null payload is empty; a null page id sorts below all others; equal rows are
records of their own, of which one is the response; control characters in a URL are left out of the
header; an empty table gives an archive without records; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas.llm.common import with_row

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(hex_digits: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits: five of them are four letters."""
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(hex_digits, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _field(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(*of: Column) -> Column:
    """A record id made from what names the record, so that writing again gives the same."""
    h = F.md5(F.concat_ws("/", *of).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url",
          payload: str = "html", date: str = "2024-01-01T00:00:00Z", mime: str = "text/html; charset=utf-8") -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (digest, header)."""
    spark = pages.sparkSession
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    base = with_row(pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                                 body.alias("payload")), "row")
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload")).withColumn(
        "bytes", F.octet_length("payload").cast("long"))
    base.drop("payload").write.parquet(f"{path}/rows")
    rows = spark.read.schema(base.drop("payload").schema).parquet(f"{path}/rows")
    # One copy of each payload comes from each task; equal digests of different bytes end the job.
    check = F.when(F.min("sha1") == F.max("sha1"), F.first("payload")).otherwise(
        F.raise_error(F.concat(F.lit("digest of different payloads: "), F.first("digest"))).cast("binary"))
    (base.groupBy("digest").agg(check.alias("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    last = (rows.where(F.col("bytes") >= min_bytes).groupBy("digest")
            .agg(F.max(F.struct("page", "row", "url")).alias("last")).withColumnRenamed("digest", "l_digest"))
    found = rows.join(last, F.col("digest") == F.col("l_digest"), "left").drop("l_digest")
    revisit = F.col("last").isNotNull() & (F.col("last.row") != F.col("row"))
    record = _urn(F.lit("record"), F.col("page").cast("string"), F.col("row").cast("string"), F.col("digest"))
    original = F.when(revisit, _urn(F.lit("record"), F.col("last.page").cast("string"), F.col("last.row").cast("string"), F.col("digest")))
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", record), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", clean(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _field("WARC-Profile", F.when(revisit, PROFILE)), _field("WARC-Refers-To", original),
        _field("WARC-Refers-To-Target-URI", F.when(revisit, clean(F.col("last.url")))),
        _field("X-Page-Id", F.col("page").cast("string")), _field("X-Refers-To-Page-Id", F.when(revisit, F.col("last.page").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _field("Content-Length", block.cast("string")),
        F.lit("\r\n"), http)
    (found.select("digest", F.encode(header, "UTF-8").alias("header"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (of a revisit, that of the record it refers to) and record (the exact bytes)."""
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("p_digest string, digest string, payload binary").parquet(f"{path}/payloads").select(
        F.col("digest").alias("p_digest"), "payload")
    joined = headers.join(payloads, F.col("digest") == F.col("p_digest"), "left")
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload is missing or changed: "), F.col("digest"))).cast("binary"))
    checked = joined.select("header", whole.alias("payload"))
    response = F.col("header").cast("string").startswith("WARC/1.1\r\nWARC-Type: response\r\n")
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    return checked.withColumn("record", F.concat("header", body, F.lit(END.encode())))


def field(name: str) -> Column:
    """A WARC field of ``header``; null where it is missing."""
    found = F.regexp_extract(F.split_part(F.col("header").cast("string"), F.lit(END), F.lit(1)), rf"\r\n{name}: ([^\r]*)", 1)
    return F.nullif(found, F.lit(""))
