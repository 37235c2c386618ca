"""Content-addressed WARC archive.

Two tables: `payloads` holds every distinct payload once, under its SHA-256; `headers` holds the exact
header bytes of every record and the key of its payload. A record is rebuilt by joining both. Payloads
are checked against their key whenever they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgauge.llm.common import shared_folder

#: Equal payloads of fewer bytes are not turned into revisits.
LEAST_REVISIT_BYTES = 1000
#: Date in the headers, where the pages have none.
DATE = "1970-01-01T00:00:00Z"
# Profile of revisits to an identical payload, and the names of fields.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    folder: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/payloads")


def _line(name: str, value: Column) -> Column:
    """A header line; null values give none. Line breaks cannot leave their value."""
    clean = F.regexp_replace(value, "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE_URN}"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, date: str = DATE) -> Archive:
    """Write a record per row of pages (page_id, url, html) and return the archive.

    Null html is an empty payload; a null url has no target line; a null page_id has no record id line and
    counts as the smallest. Of records with equal payloads of LEAST_REVISIT_BYTES or more, those with the
    largest page_id are responses (all rows that repeat it), the others revisits; smaller ones are all
    responses. Empty tables give an empty archive. Extra columns are left out.
    """
    html = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload")
    ).withColumns({
        "payload_key": F.sha2("payload", 256), "digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long"),
    })
    facts = rows.drop("payload")
    latest = (
        facts.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
        .groupBy("payload_key")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    joined = facts.join(latest, "payload_key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = joined.withColumn("revisit", revisit)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block_bytes = F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("response")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
        http,
    )
    headers = joined.select("page_id", F.encode(header, "utf-8").alias("header"), "payload_key")
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
    once = rows.select("payload_key", "payload").groupBy("payload_key").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return Archive(pages.sparkSession, folder)


def verified_payloads(archive: Archive) -> DataFrame:
    """payload_key, payload, payload_bytes, payload_digest; a payload that doesn't match its key is an error."""
    wrong = F.sha2("payload", 256) != F.col("payload_key")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key"))))
    return archive.payloads.select(
        "payload_key",
        "payload",
        F.coalesce(checked.cast("long"), F.length("payload").cast("long")).alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract(_field(name), rf"^<{PAGE_URN}(-?\d+)>$", 1), F.lit("")).cast("long")


def read_archive(archive: Archive) -> DataFrame:
    """Every record again: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record.

    All but the payload's columns come from the header bytes. `payload` is the full payload, of revisits
    too; `record` is the exact record: header, the payload of responses, and the closing line breaks.
    """
    headers = archive.headers.withColumn("head", F.decode("header", "utf-8"))
    parsed = headers.select(
        "payload_key",
        "header",
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1).alias("declared"),
    )
    records = parsed.join(verified_payloads(archive), "payload_key")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    wrong = F.col("declared") != F.col("payload_digest")
    return records.select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload_bytes",
        F.when(wrong, F.raise_error(F.lit("digest of header and payload differ")).cast("string"))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "payload",
        F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages into an archive below spark.checkpoint.dir and read it back."""
    return read_archive(write_archive(pages, shared_folder(pages.sparkSession, "warc")))
