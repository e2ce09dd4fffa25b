"""Content-addressed archive (operator 10): payload bytes once per digest, exact record headers apart, records rebuilt by joins.

`write` makes one WARC record per page. Two tables are written to the shared folder:

- `headers`: one row per record with its exact header bytes and the digest of its payload;
- `payloads`: one row per SHA-256 digest with the bytes, bucketed by digest, so that reading back does not shuffle them again.

Of records with equal payloads of at least 100 bytes those with the smallest page id are responses and the others revisit
them; shorter payloads are always responses. A revisit's header names the record it refers to and its block is empty; its
payload is still known by digest, so `read` gives every record's full payload back. `read` trusts nothing it has not checked:
the digest is taken anew from the stored bytes and `verified` says whether it agrees; type, page and reference are parsed
from the header bytes. `records` gives the bytes of whole records, headers and block.

Null html is the empty payload, null urls leave their header out. A null page id gives a record without a number: it never
is the smallest, so it revisits if any page id is known, else it is a response. Repeated rows with the smallest id are
all responses. Line breaks inside a url are percent-encoded. Other columns are not read. Only joins, grouping and built-in
functions are used; a payload that a third of all pages share is reduced to one copy before the shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import partitions

SHARED_BYTES = 100
BREAK = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables are; `table` is the catalog name of the bucketed payloads."""

    folder: str
    table: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)


def _field(name: str, value: Column) -> Column:
    """One header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def header(page: Column, url: Column, kind: Column, refers: Column, digest: Column, size: Column) -> Column:
    """The header bytes of a record, with the empty line that ends them."""
    revisit = kind == "revisit"
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", _record_id(page)),
        _field("WARC-Target-URI", safe),
        _field("WARC-Refers-To", F.when(revisit, _record_id(refers))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit(BREAK),
    ).cast("binary")


def write(pages: DataFrame) -> Archive:
    """Archive all pages; returns where."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))

    slim = keyed.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"))
    first = slim.where(F.col("size") >= SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_page"))
    shares = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    kind = F.when(shares, "revisit").otherwise("response")
    refers = F.when(shares, F.col("first_page"))
    headers = slim.join(first, "digest", "left").select(
        "digest", header(F.col("page_id"), F.col("url"), kind, refers, F.col("digest"), F.col("size")).alias("header")
    )
    archive = Archive(scratch(spark, "warc"), f"warc_{uuid.uuid4().hex}")
    headers.write.parquet(f"{archive.folder}/headers")
    once = keyed.groupBy("digest").agg(F.first("payload").alias("payload"))
    (
        once.write.bucketBy(partitions(spark), "digest")
        .option("path", f"{archive.folder}/payloads").option("compression", "zstd").saveAsTable(archive.table)
    )
    return archive


def _value(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract(_value(name), "^<urn:page:(.*)>$", 1), F.lit("")).cast("bigint")


def read(archive: Archive, spark: SparkSession) -> DataFrame:
    """Every record: `page_id`, `record_type`, `refers_to`, `url`, `header`, `payload`, its new `digest`, `verified`."""
    stored = archive.payloads(spark).select(
        F.col("digest").alias("key"), "payload", F.sha2("payload", 256).alias("digest")
    )
    headers = archive.headers(spark).withColumnRenamed("digest", "key")
    return headers.join(stored, "key").select(
        _page("WARC-Record-ID").alias("page_id"),
        _value("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        _value("WARC-Target-URI").alias("url"),
        "header",
        "payload",
        "digest",
        ((F.col("digest") == F.col("key")) & (_value("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), "digest"))).alias("verified"),
    )


def records(archive: Archive, spark: SparkSession) -> DataFrame:
    """The bytes of each whole record: headers, block (empty in a revisit), and the two line breaks after it."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read(archive, spark).select(
        "page_id", F.concat(F.col("header"), block, F.lit(f"{BREAK}{BREAK}".encode())).alias("record")
    )
