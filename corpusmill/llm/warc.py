"""A content-addressed web archive: payloads once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.skew import join_hot
from corpusmill.plans.storage import Scratch

_CRLF = "\r\n"
#: Pages that read one shelf of a payload that many share.
PER_SHELF = 256
#: The date of records, which every one must have; pages come without.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 (RFC 4648, no padding needed) of the SHA-1 of binary data, in SQL functions alone."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _measured(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The pages with their payloads, lengths, digests, and key: SHA-256 and length, by which payloads are told apart."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    target = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), target.alias("url"), payload.alias("payload"))
    key = F.concat(F.unhex(F.sha2("payload", 256)), F.unhex(F.lpad(F.hex(F.octet_length("payload").cast("long")), 16, "0")))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), key.alias("key"))


def _shelves() -> Column:
    return F.ceil(F.count("*") / PER_SHELF).cast("int")


def _headed(measured: DataFrame, n: int, least: int) -> DataFrame:
    """Each measured page with its type, what it refers to, and the shelf of its payload that it reads.

    A payload that many pages share has a shelf for each PER_SHELF of them, so that no task of the join that rebuilds
    records gets all its pages.
    """
    first = measured.groupBy("key").agg(F.min("page_id").alias("first_id"), _shelves().alias("shelves"))
    rows = join_hot(measured, first, "key", n)
    again = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
        "key", F.pmod(F.xxhash64("page_id", "url"), F.col("shelves")).cast("int").alias("shelf"),
    )


def header(date: str = DATE) -> Column:
    """The exact header block of a record, up to and without the empty line that ends it."""
    lines = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"),
        F.lit(f"{_CRLF}WARC-Date: {date}{_CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit(f"{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"),
    )
    return lines


def record_bytes(header: Column, payload: Column) -> Column:
    """The bytes of one WARC record."""
    return F.concat(F.encode(header, "UTF-8"), F.encode(F.lit(_CRLF * 2), "UTF-8"), payload, F.encode(F.lit(_CRLF * 2), "UTF-8"))


def write_archive(pages: DataFrame, root: str, *, least: int = 0, date: str = DATE, **columns: str) -> None:
    """Write the two tables of an archive under ``root``: headers (a row per record) and payloads (a row per key).

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and the others revisit it.
    The joins for headers carry no payloads, and split hot ones. Payloads are reduced to one a key in each task before
    they are dealt by key, so that a hot payload moves once a task. Pages have no date of their own: ``date``.

    Null html: an empty payload. Null url: an empty target; line ends in a url are escaped. Null page_id: a revisit
    only of a page that has an id. Repeated rows: every row of the smallest page_id is a response. Empty table: empty
    archive. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc-headers")
    own = _measured(pages, **columns)
    measured = scratch.keep(own.drop("payload"), "measured")
    heads = _headed(measured, measured.count(), least)
    heads.select("key", "shelf", header(date).alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")
    own.groupBy("key").agg(F.any_value("payload").alias("payload"), _shelves().alias("shelves")).write.option("compression", "zstd").parquet(f"{root}/payloads")
    scratch.close()


def read_archive(spark, root: str) -> DataFrame:
    """Rebuild every record from its header and the payload of its key, and read the record's bytes.

    Returns the fields parsed from the header, the record, its payload, and what is measured on the latter:
    payload_bytes and payload_digest. Fails on a record whose payload is not of the length and digest in its header.
    """
    heads = spark.read.schema("key binary, shelf int, header string").parquet(f"{root}/headers")
    loads = spark.read.schema("key binary, payload binary, shelves int").parquet(f"{root}/payloads")
    loads = loads.select("key", "payload", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"))
    rows = heads.join(loads, ["key", "shelf"], "left").select("header", record_bytes(F.col("header"), F.col("payload")).alias("record"))

    def field(name: str) -> Column:
        got = F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    head = F.octet_length("header") + 2 * len(_CRLF)
    size = F.octet_length("record") - head - 2 * len(_CRLF)
    rows = rows.withColumn("payload", F.substring(F.col("record"), head + 1, size)).withColumn("payload_bytes", size.cast("long")).withColumn("found", base32_sha1(F.col("payload")))
    right = (F.concat(F.lit("sha1:"), F.col("found")) == field("WARC-Payload-Digest")) & (F.col("payload_bytes").cast("string") == field("Content-Length"))
    digest = F.when(right, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), "header")).cast("string"))
    return rows.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), field("WARC-Date").alias("date"),
        digest.alias("payload_digest"), "payload_bytes", page("WARC-Refers-To").alias("refers_to"), "record", "payload",
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write an archive in the shared folder and read it back: the fields of every record, measured on its bytes.

    Options and cases as for ``write_archive``.
    """
    spark = pages.sparkSession
    root = f"{Scratch(spark, 'warc').root}/archive"
    write_archive(pages, root, **options)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
