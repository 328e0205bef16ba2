"""Content-addressed web archive.

A payload is stored once, under its SHA-256, in the table `payloads`; the exact header bytes of every record stand
in the table `records`, with the digest as the reference. Reading joins the two, recomputes the digests and gives
back the records as they would stand in a WARC file. Both tables are Parquet in a folder of any store that Spark
can write.

Of records with equal payloads of at least `least_bytes` the one with the largest id is a response and the others
revisit it; smaller payloads are always responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized_join

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a pair whose value is null is left out. Line breaks within a value become spaces."""
    clean = lambda v: F.regexp_replace(v, "[\r\n]+", " ")
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{k}: "), clean(v), F.lit(END)), F.lit("")) for k, v in pairs))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", *, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", scratch: Scratch | None = None) -> str:
    """Writes the tables `records` and `payloads` below `folder`, one record for each row, and returns the folder.

    A null payload is an empty one; a null url gives no WARC-Target-URI. Rows that repeat an id get a record each,
    the one read last counts as the largest. Other columns are ignored; an empty table gives empty tables.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    meta = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), "sha256"))
    # Equal digests are held against each other byte for byte before one copy stands for all.
    same = F.when(F.min("payload") == F.max("payload"), F.min("payload")).otherwise(F.raise_error(F.lit("payloads of one digest differ")).cast("binary"))
    scratch.write(rows.select("sha256", "payload").groupBy("sha256").agg(same.alias("payload")), f"{folder}/payloads", "zstd")
    last = meta.filter(F.col("n") >= least_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "rid")).alias("last"))
    joined = meta.join(scratch.keep(last), "sha256", "left")
    again = F.col("last").isNotNull() & (F.col("last.rid") != F.col("rid"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    length = F.octet_length("http") + F.when(again, F.lit(0)).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _lines(
            ("WARC-Type", kind), ("WARC-Record-ID", _name(F.col("page_id"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Profile", F.when(again, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(again, _name(F.col("last.page_id")))), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length.cast("string")),
        ),
        F.lit(END),
    )
    scratch.write(joined.withColumn("http", http).select(F.encode(head, "utf-8").alias("head"), F.encode("http", "utf-8").alias("http"), "sha256"), f"{folder}/records", "zstd")
    return folder


def read_archive(spark: SparkSession, folder: str, *, records_each: int = 1000, broadcast_rows: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """The records put together again: head, http, payload, verified, record.

    `payload` is the full payload, for a revisit too; `record` has the bytes of the record as in a WARC file, where
    a revisit ends after its HTTP header. `verified`: the stored bytes have the digest they are filed under. No task
    meets more than about `records_each` records of one payload; the list of payloads with more is broadcast if it has
    at most `broadcast_rows` rows of 80 bytes.
    """
    records = spark.read.schema("head binary, http binary, sha256 string").parquet(f"{folder}/records")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    # A payload that many records share is joined in parts: the records are dealt out among so many copies of it.
    many = records.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > records_each).select("sha256", F.ceil(F.col("n") / records_each).cast("int").alias("parts"))
    many = (scratch or Scratch(spark)).keep(many)
    rows = many.count()
    one = F.coalesce("parts", F.lit(1))
    dealt = sized_join(records, many, "sha256", "left", rows, broadcast_rows).withColumn("part", F.pmod(F.xxhash64("head"), one).cast("int")).drop("parts")
    copies = sized_join(payloads, many, "sha256", "left", rows, broadcast_rows).withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    found = dealt.join(copies, ["sha256", "part"], "left")
    block = F.when(F.decode("head", "utf-8").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return found.select("head", "http", "payload", (F.sha2("payload", 256) == F.col("sha256")).alias("verified"), F.concat("head", "http", block, F.lit(b"\r\n\r\n")).alias("record"))


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of each record of read_archive(): page_id, url, payload_bytes, payload_digest, record_type, refers_to, verified.

    Sizes and digests are taken anew from the bytes that were read; `verified` also asks that the SHA-1 in the header
    is theirs and that the stated length is that of the record's block.
    """
    head = F.decode("head", "utf-8")
    number = lambda name: F.regexp_extract(F.coalesce(_header(head, name), F.lit("")), r"<urn:x-page:(.*)>", 1)
    whole = F.lit(4) + F.octet_length("head") + _header(head, "Content-Length").cast("long") == F.octet_length("record")
    digest = F.sha1("payload")
    return records.select(
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID")).cast("long").alias("page_id"),
        _header(head, "WARC-Target-URI").alias("url"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), _header(head, "WARC-Type").alias("record_type"),
        F.when(number("WARC-Refers-To") != "", number("WARC-Refers-To")).cast("long").alias("refers_to"),
        (F.col("verified") & whole & (_header(head, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest))).alias("verified"),
    )


def whole_records(parsed: DataFrame) -> DataFrame:
    """The rows of parse_records(), of which every one must be verified: reading one that is not, or whose record is missing, raises an error."""
    text = F.concat(F.lit("record is not what was archived, page_id "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    # The condition is a part of each row's digest, so no choice of columns that has it can leave the check out.
    checked = F.when(F.coalesce("verified", F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(text).cast("string"))
    return parsed.withColumn("payload_digest", checked)
