"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; each record keeps its exact header block and
the digest of its payload. Joining the two tables by the digest gives every original record back,
byte for byte. Both tables are Parquet folders below the archive's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.llm.common import stored
from newsrate.operators.lookup import fits_broadcast

#: Payloads from this size on are revisited instead of repeated.
REVISIT_BYTES = 1000
#: Owners of payloads (about 200 bytes each in a broadcast table) that may be broadcast.
BROADCAST_OWNERS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """One header line; none where the value is null. Line ends inside a value are escaped."""
    safe = F.replace(
        F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
    )
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _urn(page: Column) -> Column:
    digest = F.md5(F.coalesce(page.cast("string"), F.lit("")).cast("binary"))
    part = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(
        F.lit("<urn:uuid:"), part[0], F.lit("-"), part[1], F.lit("-4"), part[2], F.lit("-8"),
        part[3], F.lit("-"), part[4], F.lit(">"),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write one record per row. Of rows with equal payloads of at least ``revisit_bytes``, that
    with the largest id is the response and the others revisit it; rows that repeat that id are
    responses too. A null body is an empty payload; a null id can revisit but is never revisited;
    a null address leaves its header line out. An empty table gives an empty archive."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.unhex(F.sha2(payload, 256)).alias("key"),
        F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("n"),
    )
    # What is equal by its digest must agree in length and in a second digest.
    owned = rows.groupBy("key", "page_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("n").alias("n"), F.max("n").alias("n2"), F.min("sha1").alias("s"), F.max("sha1").alias("s2"),
    )
    groups = stored(
        owned.groupBy("key").agg(
            F.max(F.struct("page_id", "copies")).alias("own"),
            ((F.min("n") == F.max("n2")) & (F.min("s") == F.max("s2"))).alias("same"),
        ).select("key", F.col("own.page_id").alias("first_id"), F.col("own.copies").alias("copies"), "same"),
        "payload-owners",
    )
    revisit = (
        (F.col("n") >= revisit_bytes)
        & F.col("first_id").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    checked = F.when(F.col("same"), F.col("key")).otherwise(
        F.raise_error(F.lit("different payloads have one digest"))
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _line("Content-Length", F.col("n")),
        F.lit(CRLF),
    )
    block = F.octet_length(F.col("http")) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    refers = F.when(F.col("revisit"), F.col("first_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(refers.isNotNull(), _urn(refers))),
        _line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page-ID", refers),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", block),
        F.lit(CRLF),
        F.col("http"),
    )
    headers = (
        rows.join(groups, "key")
        .withColumn("key", checked)
        .drop("copies")
        .withColumns({"revisit": revisit, "http": http})
        .select("key", header.cast("binary").alias("header"))
    )
    bodies = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.unhex(F.sha2(payload, 256)).alias("key"),
        payload.alias("payload"),
    )
    store = _stored_once(bodies, groups)
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _stored_once(bodies: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, payload), each key once. While the list of owners is small enough to broadcast, only
    the payloads of repeated owners are shuffled; else all are, combined in each task first."""
    if not fits_broadcast(groups, BROADCAST_OWNERS):
        return bodies.groupBy("key").agg(F.first("payload").alias("payload"))
    owner = groups.select(
        F.col("key").alias("_key"), F.col("first_id").alias("_id"), "copies"
    )
    same = (F.col("key") == F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_id"))
    own = bodies.join(F.broadcast(owner), same).select("key", "payload", "copies")
    again = own.filter("copies > 1").groupBy("key").agg(F.first("payload").alias("payload"))
    return own.filter("copies = 1").select("key", "payload").union(again)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``header`` and ``payload`` as stored, ``record`` as its bytes in a WARC file.
    A payload that does not have its digest stops the read."""
    headers = spark.read.schema("key binary, header binary").parquet(f"{path}/headers")
    store = spark.read.schema("key binary, payload binary").parquet(f"{path}/payloads")
    text = F.col("header").cast("string")
    joined = headers.join(store, "key").withColumn(
        "payload",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("payload")).otherwise(
            F.raise_error(F.lit("a payload does not have its digest"))
        ),
    )
    end = F.lit(CRLF * 2).cast("binary")
    own = F.when(record_field(text, "WARC-Type") == "revisit", F.lit(b"")).otherwise(
        F.col("payload")
    )
    return joined.select("header", "payload", F.concat("header", own, end).alias("record"))


def record_field(header: Column, name: str) -> Column:
    """A header line's value; null where the line is missing."""
    value = F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r]*)\r", 1)
    return F.when(value != "", value)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read from an archive; the
    length and digest are those of the payload's own bytes."""
    text = F.col("header").cast("string")
    return read_archive(spark, path).select(
        record_field(text, "X-Page-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        record_field(text, "WARC-Type").alias("record_type"),
        record_field(text, "X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
