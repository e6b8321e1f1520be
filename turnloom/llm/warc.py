"""Content-addressed WARC archive: payload bytes once per strong digest, exact record headers apart.

`write_archive` stores two tables in the shared folder: payloads (sha256, payload bytes), each
payload once however many records carry it, and headers (one row per record with its header block
as bytes). `records` joins them back into whole records, and `report` reads those. Equal SHA-256
digests are verified when the payload is stored: all rows of a digest must agree in length and SHA-1.
Payloads that a bounded bitmap shows to be alone are written where they are read, without a shuffle.

A null html is an empty payload. Payloads under `REVISIT_BYTES` are always written as responses. Of
larger equal payloads the record with the largest page_id is the response (a null id is the
smallest) and the others revisit it; repeated rows with that same id are the same record, so all are
responses. A url stands in the header as it is, but for line breaks, which no header line can hold: they
are escaped there, and the url itself is kept beside the header. Text ids may hold any text: line breaks,
percent and closing signs in record ids are escaped. A null url has no header line, a null id a record
id of its own kind. An empty table gives empty tables. Further columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored, with_perhaps

REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"  # the pages carry no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


BREAKS = "\r\n"
ESCAPED = "%\r\n>"  # in record ids; the percent sign first


class Archive(NamedTuple):
    payloads: DataFrame
    headers: DataFrame


def _escaped(text: Column, signs: str = ESCAPED) -> Column:
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return text


def _unescaped(text: Column) -> Column:
    for sign in ESCAPED[::-1]:
        text = F.replace(text, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return text


def _record_id(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), _escaped(page_id.cast("string")), F.lit(">")), F.lit("<urn:page-without-id>"))


def _header() -> Column:
    """The header block of a record, ended by an empty line; lines without a value are left out."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("url"), BREAKS)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Stores the archive of a table of pages."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "address": F.sha2("payload", 256)})
    agree = (F.min("payload_digest") == F.max("payload_digest")) & (F.min("payload_bytes") == F.max("payload_bytes"))
    slim = rows.drop("payload")
    several = slim.groupBy("address").agg(F.count("*").alias("c")).filter("c > 1").select("address")
    marked = with_perhaps(rows.select("address", "payload", "payload_bytes", "payload_digest"), "address", several, "_perhaps")
    alone = marked.filter("not _perhaps").select("address", "payload")
    once = marked.filter("_perhaps").groupBy("address").agg(F.first("payload").alias("payload"), agree.alias("agree"))
    checked = F.when(F.col("agree"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("address"))).cast("binary"))
    payloads = stored(alone.unionByName(once.select("address", checked.alias("payload"))), "warc-payloads")
    owners = slim.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("address").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    joined = slim.join(owners, "address", "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("owner")))
    headers = stored(records.select("page_id", "address", "url", _header().alias("header")), "warc-headers")
    return Archive(payloads, headers)


def field(name: str) -> Column:
    """The value of a header line, null where there is none."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _page_of(record_id: Column) -> Column:
    found = F.regexp_extract(record_id, "<urn:page:([^>]*)>", 1)
    return F.when(record_id.startswith("<urn:page:"), _unescaped(found))


def records(archive: Archive) -> DataFrame:
    """Original records: page_id, address, url, payload and the record's bytes as a WARC file holds them."""
    whole = archive.headers.join(archive.payloads, "address")
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("page_id", "address", "url", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def report(archive: Archive) -> DataFrame:
    """One row per record, read from the rebuilt records.

    A response must hold as many bytes as its header says, and its payload, or that of the record it
    refers to, must have the digests under which it is stored and which the header states.
    """
    kind = archive.headers.schema["page_id"].dataType
    head = F.substring_index(F.decode("record", "ISO-8859-1"), "\r\n\r\n", 1)
    parsed = records(archive).select("address", "payload", "record", F.encode(F.concat(head, F.lit("\r\n\r\n")), "ISO-8859-1").alias("header"))
    read = parsed.select(
        "address",
        "payload",
        F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)").alias("block"),
        field("Content-Length").cast("long").alias("block_bytes"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("stated"),
        _page_of(field("WARC-Record-ID")).cast(kind).alias("page_id"),
        _page_of(field("WARC-Refers-To")).cast(kind).alias("refers_to"),
    )
    body = F.when(F.col("record_type") == "response", F.col("block")).otherwise(F.col("payload"))
    found = read.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body), "strong": F.sha2(body, 256)})
    intact = (F.octet_length("block") == F.col("block_bytes")) & (F.col("stated") == F.col("payload_digest")) & (F.col("strong") == F.col("address"))
    broken = F.raise_error(F.concat(F.lit("the archive is damaged at "), F.col("address"))).cast("string")
    return found.select("page_id", "payload_bytes", F.when(intact, F.col("payload_digest")).otherwise(broken).alias("payload_digest"), "record_type", "refers_to")



ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         coalesce(html, '') AS body FROM pages
), o AS (SELECT body, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY body)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN o.owner IS NULL OR o.owner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.owner = p.page_id THEN NULL ELSE o.owner END AS refers_to
FROM p LEFT JOIN o ON p.body = o.body
"""
