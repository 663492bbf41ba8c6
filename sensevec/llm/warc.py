"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALLEST_REVISIT = 100  # bytes; smaller payloads are always written as responses
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _field(name: str, value: Column) -> Column:
    """A header line; a null value gives none."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _http(size: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _field("Content-Length", size), F.lit("\r\n")
    )


def _headers(date: str) -> Column:
    size = F.col("size").cast("string")
    http = _http(size)
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    fields = [
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", urn(F.col("page_id"))),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, _field("WARC-Refers-To", urn(F.col("refers_to")))),
        F.when(revisit, _field("WARC-Profile", F.lit(PROFILE))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
    ]
    return F.concat_ws("", F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), http)


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``(page_id, url, html)`` as ``path/payloads`` and ``path/headers``.

    A payload is the UTF-8 of ``html`` (null: empty) and is stored once under its SHA-256.  Copies are dropped in the map tasks,
    so a payload of many pages is moved once per task, and a digest whose texts differ in length or in a second hash fails the
    job.  Of pages with equal payloads of at least 100 bytes the smallest ``page_id`` is the response, and the others are revisits
    that refer to it; null ids count as largest.  Rows that repeat a page are written again as they stand.  A null url writes no
    target line, line breaks in it are percent-encoded.  Other columns are ignored; no pages give two empty tables.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("bigint").alias("size"),
    )
    second = F.xxhash64("html")
    store = rows.groupBy("digest").agg(
        F.first("html").alias("html"),
        F.min("page_id").alias("owner"),
        F.max("size").alias("size"),
        ((F.min("size") == F.max("size")) & (F.min(second) == F.max(second))).alias("same"),
    )
    checked = F.when(F.col("same"), F.col("html").cast("binary")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads under "), F.col("digest"))).cast("binary")
    )
    store = store.select("digest", "owner", "size", checked.alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = spark.read.parquet(f"{path}/payloads").select("digest", "owner")
    revisits = (F.col("size") >= SMALLEST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    headers = rows.drop("html").join(owners, "digest").withColumn("refers_to", F.when(revisits, F.col("owner")))
    headers = headers.select("digest", _headers(date).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(header, payload, digest)`` of every record: its exact header and the payload it stands for.

    A stored payload whose SHA-256 is not its name fails the job.
    """
    store = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    payload = F.when(good, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    )
    return spark.read.parquet(f"{path}/headers").join(store.select("digest", payload.alias("payload")), "digest")


def records(archive: DataFrame) -> DataFrame:
    """``record``: the bytes of each WARC record; a revisit carries its header only."""
    body = F.when(_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.col("header").cast("binary"), body, F.lit(END).cast("binary")).alias("record"))


def _value(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(name: str, kind) -> Column:
    found = F.regexp_extract(_value(name), "^<urn:page:(.*)>$", 1)
    return F.when(found.isin("", "null"), F.lit(None)).otherwise(found).cast(kind)


def index(archive: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` parsed from headers and measured on payloads."""
    return archive.select(
        _page("WARC-Record-ID", id_type).alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _value("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To", id_type).alias("refers_to"),
    )
