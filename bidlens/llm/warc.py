"""A content-addressed web archive.

Payload bytes are stored once per verified strong digest (SHA-256); record
headers are stored separately and exactly, one per page.  Reading back joins
headers and payloads to whole WARC records and takes every field from the bytes
of the record.

Of pages with equal payloads of at least ``smallest_revisit`` bytes the one with
the largest id is written as ``response``; the others are ``revisit`` records
that refer to it.  Smaller payloads are all responses.

Defined results: NULL html counts as empty; NULL ids sort before every id; of
repeated rows one is the response; empty tables give empty archives; only the
three named columns are read, so other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.session import folder_path, materialize, new_table_path

CRLF = "\r\n"
# The alphabet of RFC 4648 base 32 and Java's digits of base 32.
BASE32, JAVA32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of SHA-1: every five hexadecimal digits are four digits of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), JAVA32, BASE32)


def record_id(page_id: Column, row: Column) -> Column:
    """A stable URN from the page id and its place among rows of that id."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("none")), row.cast("string")))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
             F.substring(h, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  date: str = "2024-01-01T00:00:00Z", smallest_revisit: int = 0) -> None:
    """Writes ``payloads`` (digest, payload) and ``headers`` (record header bytes, digest) below ``path``.

    Rows are numbered once, in a stored table, so all that refers to a row means the same one.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    numbered = materialize(rows.select(
        "page_id", "url", F.monotonically_increasing_id().alias("row"), F.sha2("payload", 256).alias("digest"),
        F.octet_length("payload").alias("length"), base32_sha1(F.col("payload")).alias("sha1")), "pages")
    # Grouping by digest and content both: a digest with two contents gives two rows here.
    stored = rows.select(F.sha2("payload", 256).alias("digest"), "payload").distinct()
    stored.write.parquet(folder_path(path, "payloads"))
    digests = spark.read.parquet(folder_path(path, "payloads")).select("digest")
    if not digests.groupBy("digest").count().where("count > 1").isEmpty():
        raise ValueError("one digest stands for two payloads: the archive can't address them by it")
    winners = numbered.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("winner"))
    entries = numbered.join(winners, "digest")
    revisit = (F.col("length") >= smallest_revisit) & (F.col("winner.row") != F.col("row"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), record_id(F.col("page_id"), F.col("row")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"),
                                 record_id(F.col("winner.page_id"), F.col("winner.row")), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("winner.page_id").cast("string"))),
        F.concat(F.lit("X-Page: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    entries.select("digest", F.encode(header, "utf-8").alias("header")).write.parquet(folder_path(path, "headers"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records again: ``record`` (header, content, closing line ends) and ``payload``, by joins.

    A revisit record has no content of its own; its payload is the one it addresses.
    """
    headers = spark.read.parquet(folder_path(path, "headers"))
    payloads = spark.read.parquet(folder_path(path, "payloads")).select("digest", "payload")
    own = header_field(F.col("header").cast("string"), "WARC-Type") == "response"
    return headers.join(payloads, "digest").select(
        F.concat("header", F.when(own, F.col("payload")).otherwise(F.unhex(F.lit(""))),
                 F.encode(F.lit(CRLF + CRLF), "utf-8")).alias("record"), "payload")


def header_field(header: Column, name: str) -> Column:
    """A field of a record header, NULL where it is absent."""
    value = F.regexp_extract(header, rf"(?m)^{name}: ?([^\r\n]*)", 1)
    return F.when(header.rlike(rf"(?m)^{name}:"), value)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields read from the record bytes; lengths and digests are measured on the bytes, not believed."""
    text = F.col("record").cast("string")
    head = F.concat(F.substring_index(text, CRLF + CRLF, 1), F.lit(CRLF))
    fields = records.select("record", "payload", head.alias("head"))
    content = F.expr("substring(record, octet_length(head) + 3, octet_length(record) - octet_length(head) - 6)")
    typed = fields.select(
        header_field(F.col("head"), "X-Page").try_cast("long").alias("page_id"),
        header_field(F.col("head"), "WARC-Type").alias("record_type"),
        header_field(F.col("head"), "X-Refers-To-Page").try_cast("long").alias("refers_to"),
        header_field(F.col("head"), "WARC-Payload-Digest").alias("stated"),
        header_field(F.col("head"), "Content-Length").try_cast("long").alias("content_length"),
        content.alias("content"), "payload")
    body = F.when(F.col("record_type") == "response", F.col("content")).otherwise(F.col("payload"))
    checked = typed.select("page_id", "record_type", "refers_to", "stated", "content_length",
                           F.octet_length("content").alias("content_bytes"), body.alias("body"))
    measured = checked.select(
        "page_id", F.octet_length("body").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("body")).alias("payload_digest"), "record_type", "refers_to",
        (F.col("content_length") == F.col("content_bytes")).alias("whole"), "stated")
    damaged = ~F.col("whole") | (F.col("stated") != F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return measured.select("page_id", "payload_bytes", F.when(damaged, F.raise_error(F.lit("damaged record")))
                           .otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, smallest_revisit: int = 0) -> DataFrame:
    """Writes the archive below the shared folder and reads every record back."""
    path = new_table_path(pages.sparkSession, "warc")
    write_archive(pages, path, smallest_revisit=smallest_revisit)
    return parse_records(read_records(pages.sparkSession, path))
