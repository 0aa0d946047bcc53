"""WARC archive addressed by content: payload bytes once, exact record headers apart, records rebuilt by joins.

``write_archive`` makes two Parquet tables under one folder that executors share:

* ``payloads``: one row for each stored payload: its SHA-256 and the bytes. Of records with equal payloads of at least
  ``least_bytes``, only that of the largest page id is a response; small ones are all responses, but their bytes are
  stored once as well.
* ``headers``: one row for each record: its WARC header block, byte for byte, and the SHA-256 of its payload.

``warc_records`` rebuilds whole WARC/1.1 records: responses are joined with their bytes, revisits have none.
``read_archive`` parses the header blocks, joins them with the digests of the stored bytes, which it computes anew, and
says whether header and bytes agree (``valid``). Only rows of a few hundred bytes are grouped and joined by digest, and
neither side of these joins is an aggregate, so Spark splits a digest that a third of all pages share; the bytes move
once, by page.

Null html is an empty payload. A null page id is a record like any other, ordered before all numbers. Rows that share
a page id and a payload are one record (with the smallest URL); of rows with one page id and several payloads each is a
record. Null URLs are written as an empty target, line ends in URLs as spaces. An empty table makes an empty archive.
Payloads of any length are stored whole. Other columns aren't archived, whatever their names.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.llm.common import shared_dir, stored, table

CRLF = "\r\n"
#: Fixed value: the profile of revisits that equal an earlier payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Payloads with their page, and the small rows of all records with type, holder and digests."""
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    full = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    small = full.drop("payload").groupBy("page_id", "digest", "sha1", "payload_bytes").agg(F.min("url").alias("url"))
    holder = (
        small.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    typed = small.join(stored(holder, "holders"), "digest", "left").withColumn(
        "record_type", F.when(F.col("holder").isNull() | F.col("page_id").eqNullSafe(F.col("holder")), "response").otherwise("revisit")
    )
    return full, typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("holder"))).drop("holder")


def header_block(date: str) -> Column:
    """The header of a record, up to and including the empty line."""

    def record_id(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), "digest", F.lit(">"))

    revisit = F.concat(F.lit(f"{CRLF}WARC-Profile: {SAME_PAYLOAD}{CRLF}WARC-Refers-To: "), record_id(F.col("refers_to")))
    is_revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(is_revisit, revisit).otherwise(""),
        F.lit(f"{CRLF}Content-Length: "), F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(CRLF * 2),
    ).cast("binary")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date: str | None = None
) -> str:
    """Write ``headers`` and ``payloads`` under ``path``, a folder that all executors share. ``date``: now by default."""
    spark = pages.sparkSession
    full, typed = records(pages, id_col, url_col, html_col, least_bytes)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    typed.select("digest", header_block(date).alias("header")).write.parquet(f"{path}/headers")
    # the bytes of a digest come from its response with the largest page id; a null id is below all numbers
    place = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest").alias("place")
    heads = parsed(spark.read.parquet(f"{path}/headers")).where("record_type = 'response'")
    keepers = heads.groupBy("digest").agg(F.max("page_id").alias("page_id")).select(place)
    kept = full.select(place, "digest", "payload").join(keepers, "place", "left_semi").dropDuplicates(["place"])
    kept.drop("place").write.parquet(f"{path}/payloads")
    return path


def parsed(headers: DataFrame) -> DataFrame:
    """digest, header and what the header says: page_id, url, record_type, refers_to, sha1, length."""
    text = F.col("header").cast("string")

    def value(name: str, pattern: str) -> Column:
        return F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1)

    found = headers.select(
        "digest", "header", value("WARC-Record-ID", "<urn:page:([^:\r\n]*):[0-9a-f]*>").alias("id"), value("WARC-Refers-To", "<urn:page:([^:\r\n]*):[0-9a-f]*>").alias("ref"),
        value("WARC-Target-URI", "([^\r\n]*)").alias("url"), value("WARC-Type", "([a-z]+)").alias("record_type"),
        value("WARC-Payload-Digest", "sha1:([0-9a-f]*)").alias("sha1"), value("Content-Length", "([0-9]+)").cast("long").alias("length"),
    )
    ids = {"page_id": F.col("id").try_cast("long"), "refers_to": F.col("ref").try_cast("long")}  # null where it isn't a number
    return found.withColumns(ids).drop("id", "ref")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: what its header says, the length and digest of its stored bytes, and ``valid``: both agree."""
    payloads = spark.read.parquet(f"{path}/payloads")
    bodies = payloads.select(
        "digest", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), (F.sha2("payload", 256) == F.col("digest")).alias("whole")
    )
    length = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    valid = F.col("whole") & (F.col("sha1") == F.col("payload_digest")) & (F.col("length") == length)
    return (
        parsed(spark.read.parquet(f"{path}/headers")).drop("header").join(bodies, "digest", "left")
        .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce(valid, F.lit(False)).alias("valid"))
    )


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the record's bytes: header, payload (none for revisits) and two line ends."""
    heads = parsed(spark.read.parquet(f"{path}/headers"))
    end = F.lit((CRLF * 2).encode())
    full = heads.where("record_type = 'response'").join(spark.read.parquet(f"{path}/payloads"), "digest")
    empty = heads.where("record_type = 'revisit'").select("page_id", F.concat("header", end).alias("record"))
    return full.select("page_id", F.concat("header", "payload", end).alias("record")).union(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


ORACLE_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), h AS (SELECT html, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to, true AS valid
FROM p LEFT JOIN h USING (html)
"""
