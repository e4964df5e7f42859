"""Content-addressed web archive.

An archive is a folder of two tables. ``records`` has a row for each record: its exact
header bytes and the digest of its payload. ``payloads`` has each distinct payload
once, under its SHA-1 (the digest that archive readers know) and its SHA-256, by
which equality is decided. Of records with equal payloads, that of the largest key is
the response and keeps the payload; the others are revisits that refer to it, unless
the payload is shorter than a bound. Reading joins the two tables: a response with its
payload, which is verified against both digests; a revisit with the payload's size.

Hot payloads: choosing the response and the one copy to store are aggregates with a
partial step in each task; joins are by the key of a single record, or, for revisits,
with rows of a few bytes.

Defined cases: a null payload is an empty one; rows with a null key take no part;
rows that share a key are a record each, and those that repeat a response's key and
payload are responses too; an empty table gives empty archive tables. Other columns are ignored. A payload lies in one row.
A record's block is the page's HTML as it is, under its own content type, without the head of an HTTP message, as pages come without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Digits that conv() writes in base 32, and those of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32(hexed: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: eight base-32 digits for each ten."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _urn(key: Column) -> Column:
    """A record id (a UUID of version 8) that holds the record's key: its 16 hexadecimal digits stand first and last."""
    h = F.lpad(F.hex(key), 16, "0")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-00000000"), F.substring(h, 13, 4))


def _key_of(urn: Column) -> Column:
    """The key in a record id of _urn, null if there is none."""
    h = F.regexp_extract(urn, r"^<urn:uuid:([0-9A-F]{8})-([0-9A-F]{4})-8000-8000-00000000([0-9A-F]{4})>$", 1)
    rest = [F.regexp_extract(urn, r"^<urn:uuid:([0-9A-F]{8})-([0-9A-F]{4})-8000-8000-00000000([0-9A-F]{4})>$", k) for k in (2, 3)]
    return F.when(h != "", F.conv(F.concat(h, *rest), 16, -10).cast("long"))


def build(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the archive of all rows."""
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), body.alias("payload")).where("key IS NOT NULL")
    rows = rows.select("key", "url", "payload", F.sha2("payload", 256).alias("strong"))
    payloads = rows.groupBy("strong").agg(F.first("payload").alias("payload"), F.max("key").alias("response"))
    payloads.select("strong", base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"), "response", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("strong", "digest", "n_bytes", "response")
    told = rows.select("key", "url", "strong").join(stored, "strong").withColumn("revisit", (F.col("n_bytes") >= least_bytes) & (F.col("key") != F.col("response")))
    revisit = F.col("revisit")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _urn(F.col("key")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _urn(F.col("response")), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(END, *lines), F.lit(END + END)).cast("binary")
    told.select("key", "strong", header.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records")


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record, parsed from its header, with its stored payload if it is a response and with the size of the full payload.

    ``verified`` says whether the stored payload, of a revisit the one that it refers to, has the digest that the header gives and the address under which it was stored.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    text = F.col("header").cast("string")
    parsed = records.withColumn("record_type", field(text, "WARC-Type")).withColumn("payload_digest", F.regexp_replace(field(text, "WARC-Payload-Digest"), "^sha1:", "")).withColumn("record_id", field(text, "WARC-Record-ID")).withColumn("refers_to_id", field(text, "WARC-Refers-To")).withColumn("refers_to", _key_of(F.col("refers_to_id"))).withColumn("content_length", field(text, "Content-Length").cast("long"))
    whole = payloads.select("strong", "payload", F.col("n_bytes").alias("payload_bytes"), ((F.sha2("payload", 256) == F.col("strong")) & (base32(F.sha1("payload")) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))).alias("sound"), F.col("digest"))
    responses = parsed.where("record_type = 'response'").join(whole, "strong")
    revisits = parsed.where("record_type = 'revisit'").join(whole.withColumn("payload", F.lit(None).cast("binary")), "strong")
    both = responses.unionByName(revisits)
    return both.withColumn("verified", F.col("sound") & (F.col("payload_digest") == F.col("digest")) & (F.coalesce(F.octet_length("payload"), F.lit(0)) == F.col("content_length"))).drop("sound", "digest", "strong")


def records(spark: SparkSession, path: str) -> DataFrame:
    """key and ``record``: the exact bytes of each WARC record."""
    return read(spark, path).select("key", F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit((END + END).encode())).alias("record"))


def originals(spark: SparkSession, path: str) -> DataFrame:
    """key and the full ``payload`` of every record, revisits included; a hot payload's rows are split by Spark's skew join."""
    return spark.read.parquet(f"{path}/records").select("key", "strong").join(spark.read.parquet(f"{path}/payloads").select("strong", "payload"), "strong").select("key", "payload")


def run(pages: DataFrame) -> DataFrame:
    """Archives all pages, reads the archive back and returns the contract's columns; a record that fails verification ends the job."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    build(pages, path)
    back = read(pages.sparkSession, path)
    sound = F.when(F.col("verified"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("a payload doesn't match its digest: "), F.col("key").cast("string"))).cast("long"))
    return back.select(F.col("key").alias("page_id"), sound.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
