"""A content-addressed WARC archive: payload bytes once per digest, exact record headers apart, records rebuilt by a join.

``write_archive`` writes two tables below a folder: ``payloads`` (digest, payload) and ``records`` (page_id, head, digest), head
being the record's WARC and HTTP header bytes. ``read_archive`` joins them again, checks each payload against its digests and
reads the record's fields out of its header. Records of one payload: that of the largest page_id is the response, the others
are revisits of it. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small

CRLF = "\r\n"
#: Date of the records; a parameter, so that an archive can be written twice alike.
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal digest of a multiple of 5 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, digits, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url"), "[\r\n]+", " ").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Writes page_id, url, html (null: an empty payload) of every row.

    Payloads below ``least_bytes`` have no revisits. Repeated rows give a record each; a null page_id or url leaves out the
    header line that would name it, and counts below any other id. An empty table gives an empty archive.
    """
    full = _hashed(pages)
    narrow = full.select("page_id", "url", "digest", base32(F.sha1("payload")).alias("sha1"), "payload_bytes")
    # Only payloads that occur more than once need a join, and these are few as a rule.
    copied = full.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    scratch = Scratch(pages.sparkSession, "archive-copies")
    rows = narrow.join(small(scratch.keep(copied, "copied")), "digest", "left").withColumn("first_id", F.coalesce("first_id", "page_id"))
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("first_id"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    rows.select("page_id", head.cast("binary").alias("head"), "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")
    # Rows of one digest have the same bytes: each task sends on one of them, however frequent the payload.
    once = full.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")
    scratch.drop("copied")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, target, record_type, refers_to, payload_digest, payload_bytes, payload and record (exact bytes).

    Fields come out of the stored header. Each stored payload is read and hashed once, before the join; one that is missing or
    doesn't have both digests fails the query, and so does a record whose header and payload aren't as long as its Content-Length
    says. If neither payload nor record is asked for, the join moves no payload.
    """
    records, payloads = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/payloads")
    head = F.decode("head", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(head, f"\r\n{name}: {value}\r\n", 1), F.lit(""))
    lost = lambda what: F.raise_error(F.concat(F.lit("payload lost or altered: "), what))
    stored = payloads.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.sha2("payload", 256) == F.col("digest"), base32(F.sha1("payload"))).otherwise(lost(F.col("digest"))).alias("sha1"))
    told = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    # A record's block: the HTTP header, and a response's payload. The first empty line ends the WARC header.
    http = F.octet_length("head") - F.octet_length(F.substring_index(head, CRLF * 2, 1)) - len(CRLF * 2)
    block = http + F.when(field("WARC-Type", "([a-z]+)") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    whole = block == field("Content-Length", "([0-9]+)").cast("long")
    rows = records.join(stored, "digest", "left").select(
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        field("WARC-Target-URI", "([^\r]*)").alias("target"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.when((F.col("sha1") == told) & whole, told).otherwise(lost(F.col("digest"))).alias("payload_digest"),
        "payload_bytes", "payload", "head",
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"").cast("binary"))
    return rows.withColumn("record", F.concat("head", body, F.lit((CRLF * 2).encode()).cast("binary"))).drop("head")
