"""A content-addressed WARC archive of two tables: payloads once, and every record's header.

``write`` stores each distinct payload once under its SHA-256 digest, and for every page the
exact bytes of its WARC header with that digest and a digest of the whole record (of its header and its block's digest). Of pages with equal payloads the one with
the smallest id is a response; the others are revisits that refer to it and have no block of
their own. ``read`` joins both tables again, verifies each stored payload against its digest
and length (a mismatch raises), and gives the records' bytes back. ``parse`` takes rebuilt records apart by their own
bytes: it raises if the block is not as long as the header says, does not have the header's
payload digest, or if the record is not what was written. Texts move once when they
are stored and once when they are read; headers and digests are all else that is shuffled.
A payload that very many pages share is one row of the store, and its headers form a large
partition that adaptive execution splits.

Defined results
* null html is an empty payload, equal to the empty text; a null url is empty.
* line breaks in a url are percent-encoded in the header, so they cannot end it.
* repeated rows: each has its record; those with the smallest id are all responses.
* null ids come last and are written as ``none``; they are responses only if no row with an
  id has their payload.
* extra columns are not archived. An empty table gives two empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five bytes are eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@dataclass
class Archive:
    payloads: DataFrame  # key binary, size long, owner long, payload binary
    headers: DataFrame  # page_id long, key binary, header binary, digest binary


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(page: Column, url: Column, size: Column, sha1: Column, owner: Column, min_bytes: int) -> Column:
    revisit = (size >= min_bytes) & owner.isNotNull() & ~page.eqNullSafe(owner)
    clean = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    return F.concat(
        F.lit("WARC/1.1" + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(page)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(owner)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit(BREAK),
    ).cast("binary")


def write(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> Archive:
    """Payloads of ``min_bytes`` and more are referred to; smaller ones are all responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    stored = (
        pages.select("page_id", payload.alias("payload"))
        .withColumn("key", F.unhex(F.sha2("payload", 256)))
        .groupBy("key")
        .agg(F.min("page_id").alias("owner"), F.first("payload").alias("payload"))
        .select("key", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"), "owner", "payload")
    )
    stored = scratch.keep(stored)
    light = pages.select("page_id", "url", F.unhex(F.sha2(payload, 256)).alias("key"))
    named = light.join(stored.select("key", "size", "sha1", "owner"), "key")
    header = _header(F.col("page_id"), F.col("url"), F.col("size"), F.col("sha1"), F.col("owner"), min_bytes)
    named = named.select("page_id", "key", header.alias("header"))
    empty = F.unhex(F.sha2(F.lit(b""), 256))
    block = F.when(_field(F.col("header"), "WARC-Type") == "revisit", empty).otherwise(F.col("key"))
    return Archive(stored, scratch.keep(named.withColumn("digest", _digest(F.col("header"), block))))


def _digest(header: Column, block: Column) -> Column:
    """A record's digest, from its header and the digest of its block."""
    return F.unhex(F.sha2(F.concat(header, block), 256))


def read(archive: Archive) -> DataFrame:
    """page_id, digest at writing, payload (of the record referred to, for revisits) and the record's bytes."""
    ok = (F.unhex(F.sha2("payload", 256)) == F.col("key")) & (F.octet_length("payload") == F.col("size"))
    checked = archive.payloads.select(
        "key", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload")
    )
    full = archive.headers.join(checked, "key")
    block = F.when(_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return full.select("page_id", "digest", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def _field(header: Column, name: str) -> Column:
    """A header field's value."""
    return F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parse(records: DataFrame) -> DataFrame:
    """page_id, header, block and payload of rebuilt records, from their bytes; what is not as it was written raises."""
    end = F.octet_length(F.substring_index(F.col("record").cast("string"), BREAK * 2, 1)) + 4
    parts = records.withColumn("_end", end).select(
        "page_id", "digest", "payload", F.substring(F.col("record"), F.lit(1), F.col("_end")).alias("header"),
        F.substring(F.col("record"), F.col("_end") + 1, F.octet_length("record") - F.col("_end") - 4).alias("block"),
    )
    # What a header says of a payload holds for the record's own block, or that of the record referred to.
    own = F.when(_field(F.col("header"), "WARC-Type") == "revisit", F.col("payload")).otherwise(F.col("block"))
    ok = {
        "length": _field(F.col("header"), "Content-Length") == F.octet_length("block").cast("string"),
        "payload digest": _field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), base32_sha1(own)),
        "record digest": F.col("digest") == _digest(F.col("header"), F.unhex(F.sha2("block", 256))),
    }
    checked = own
    for name, right in reversed(ok.items()):
        wrong = F.raise_error(F.concat(F.lit(f"a rebuilt record does not have its {name}: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("binary")
        checked = F.when(right, checked).otherwise(wrong)
    return parts.select("page_id", "header", "block", checked.alias("payload"))


def page_digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The contract's columns, from the bytes of records that were written, read back and taken apart."""
    records = parse(read(write(pages, Scratch(pages.sparkSession, "warc"), min_bytes)))
    header = F.col("header")
    refers = F.regexp_extract(_field(header, "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring(_field(header, "WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        _field(header, "WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT b, min(page_id) AS owner FROM p GROUP BY b),
h AS (SELECT p.page_id, p.b, k.owner, sha1(p.b) AS d FROM p JOIN k ON p.b = k.b)
SELECT page_id, octet_length(b) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST((('0x' || substr(d, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1), '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM h
"""
