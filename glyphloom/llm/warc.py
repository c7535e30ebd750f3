"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup

#: The base-32 digits of RFC 4648 in natural order, and those of number conversion.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
URN = "urn:glyphloom:page:"
#: The field that keeps a url with line ends.
RAW_URL = "X-Target-URI-Base64"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each 40 bits of the hex digest are 8 digits."""
    code = F.sha1(payload)
    eight = [F.lpad(F.conv(F.substring(code, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*eight), DIGITS, BASE32)


def header(record_type: Column, page_id: Column, url: Column, digest: Column, n_bytes: Column, refers_to: Column) -> Column:
    """The exact header block of a record, its blank line included.

    Line ends in a url are percent-encoded; a further field then keeps the url itself in base 64. A null url has no field.
    """
    name = lambda v: F.concat(F.lit(f"<{URN}"), F.coalesce(v.cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    revisit = record_type == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", name(page_id)),
        F.when(url.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", uri)),
        F.when(url.rlike(r"[\r\n]"), line(RAW_URL, F.base64(url.cast("binary")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(refers_to)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html{CRLF}"),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(n_bytes).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Writes the tables that ``headers`` and ``payloads`` read.

    Of records with equal payloads of at least ``min_bytes``, that with the smallest id is the response
    and the others revisit it. Equality is SHA-256 checked byte for byte. Each payload is stored once,
    under its SHA-256 and the id of the row that brought it; only rows that share a digest are shuffled
    with their payload. Null payloads are empty. Other columns are not stored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    known = exact_dedup.dedup(rows, "page_id", "payload", keep="smallest", carry=("url", "payload"))
    n_bytes = F.octet_length("payload").cast("long")
    kind = F.when(F.col("kept") | (n_bytes < min_bytes), F.lit("response")).otherwise(F.lit("revisit"))
    known = known.select("page_id", "url", "payload", "digest", "keep_id", "kept", kind.alias("kind"), n_bytes.alias("n_bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    block = header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n_bytes"), F.col("keep_id"))
    none = F.lit(None).cast("binary")
    rows = F.array(F.struct(F.lit("headers").alias("part"), block.cast("binary").alias("header"), none.alias("payload")), F.when(F.col("kept"), F.struct(F.lit("payloads").alias("part"), none.alias("header"), F.col("payload").cast("binary").alias("payload"))))
    # one job writes both tables, so the rows are judged once
    parts = known.select(F.explode(rows).alias("r"), "digest", "keep_id").where("r IS NOT NULL").select("r.part", "r.header", "r.payload", "digest", F.col("keep_id").cast("long").alias("keep_id"))
    parts.write.partitionBy("part").parquet(f"{path}/parts")


def _part(spark: SparkSession, path: str, name: str, column: str) -> DataFrame:
    rows = spark.read.schema("header binary, payload binary, digest string, keep_id long, part string").parquet(f"{path}/parts")
    return rows.where(F.col("part") == name).select(column, "digest", "keep_id")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, keep_id): the exact header block of each record."""
    return _part(spark, path, "headers", "header")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(payload, digest, keep_id): each different payload once."""
    return _part(spark, path, "payloads", "payload")


def _field(head: Column, key: str) -> Column:
    return F.regexp_extract(head, rf"(?m)^{key}: ?([^\r\n]*)", 1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (whole also for revisits) and record, the exact bytes of each original record."""
    stored = payloads(spark, path).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), "payload")
    found = headers(spark, path)
    whole = found.join(stored, (F.col("digest") == F.col("_digest")) & F.col("keep_id").eqNullSafe(F.col("_keep")), "left")
    kind = _field(F.col("header").cast("string"), "WARC-Type")
    body = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("header", "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def export(spark: SparkSession, path: str, out: str) -> None:
    """Writes the archive's records as WARC 1.1 files, whole records one after the other, into the folder ``out``."""
    text = F.decode("record", "UTF-8")
    # a record ends in two line ends; the writer adds the last character
    records(spark, path).select(F.substring(text, F.lit(1), F.length(text) - 1).alias("value")).write.option("lineSep", "\n").text(out)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, parsed from its rebuilt bytes: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    ``intact``: the stored payload has the digest of the header, and the record's block its length.
    """
    found = records(spark, path)
    at = F.instr(F.decode("header", "UTF-8"), CRLF + CRLF)
    head = F.substring(F.decode("header", "UTF-8"), F.lit(1), at)
    field = lambda key: _field(head, key)
    urn = lambda key: F.nullif(F.regexp_extract(field(key), rf"^<{URN}(.*)>$", 1), F.lit("")).cast("long")
    digest = sha1_base32(F.col("payload"))
    block = F.octet_length("record") - F.octet_length("header") - 4
    raw = field(RAW_URL)
    url = F.when(raw != "", F.decode(F.unbase64(raw), "UTF-8")).when(head.rlike("(?m)^WARC-Target-URI:"), field("WARC-Target-URI"))
    return found.select(
        urn("WARC-Record-ID").alias("page_id"),
        url.alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Type") == "revisit", urn("WARC-Refers-To")).alias("refers_to"),
        ((field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (block == field("Content-Length").cast("long"))).alias("intact"),
    )
