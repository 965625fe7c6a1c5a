"""WARC archives with revisit records for repeated payloads.

Headers (identifier, length, SHA-256 of the payload) are shuffled by digest; of payloads of at
least ``min_bytes`` that repeat, the smallest identifier is the response and the others become
revisits of it. Records get fresh headers and are written as WARC/1.1 files by Spark's text
sink, whose line separator is the blank lines that end a record; a file holds about
``file_bytes`` of records of pages of similar length, sixteen times that at most, or one record. Reading is driven by Content-Length, so payloads may hold anything.

Cases: a null page has an empty payload; a null address leaves WARC-Target-URI out; of rows that
repeat an identifier and payload all are responses, since none is larger; payloads under
``min_bytes`` are all responses; pages of any length are written whole, in a file of their own if
they are longer than ``file_bytes``; an empty table gives an empty archive; further columns, whatever their names, are
not archived. Rows that repeat identifier and payload share a record identifier.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import materialise, shared_dir

#: Fixed values of the WARC 1.1 format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, warc_type string, refers_to string, declared_digest string, declared_bytes long, payload binary"


def resolve_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another one."""
    headers = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest")).filter(F.col("bytes") >= min_bytes)
    firsts = headers.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = materialise(firsts, "first-payloads")  # so that the join can split a hot payload
    return headers.join(firsts, "digest").filter(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def _record_id(page_id, digest):
    """One identifier a page and payload, so that a revisit can name the response without meeting it."""
    h = F.sha2(F.concat_ws(":", F.lit("warc-record"), F.coalesce(page_id.cast("string"), F.lit("null")), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(pages: DataFrame, date: str | None = None, min_bytes: int = 100, revisits: DataFrame | None = None) -> DataFrame:
    """One column ``value``: the text of each page's record, without the blank lines after it.

    ``date`` is that of the headers, the time of writing if it is not given; ``revisits`` are those of all pages where
    these are some of them.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisits = (resolve_revisits(pages, min_bytes) if revisits is None else revisits).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.when(again, "").otherwise(F.col("html"))).alias("value"))


#: Bytes of a page up to which it is short, and how much longer pages of the next class can be.
SHORT, STEP = 8 << 10, 16


def write_archives(pages: DataFrame, path: str, file_bytes: int = 16 << 20, **options) -> None:
    """Write the records below ``path`` as gzip files of about ``file_bytes``, at most ``STEP`` times that or one record.

    Pages are written by classes of length, each with as many records a file as its mean length allows; in a
    class no page is more than ``STEP`` times as long as the shortest (the shortest ones count as a header's length).
    """
    bytes_of = F.coalesce(F.octet_length("html"), F.lit(0))
    length = F.when(bytes_of <= SHORT, 0).otherwise(F.ceil(F.log(float(STEP), bytes_of / SHORT))).cast("int")
    classes = pages.groupBy(length.alias("class")).agg(F.avg(bytes_of).alias("mean")).collect()  # a row a class, ten or so
    date = {"date": options.pop("date", None) or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    revisits = materialise(resolve_revisits(pages, **options), "revisits") if len(classes) > 1 else None
    for row in classes or [{"class": 0, "mean": 0.0}]:
        per_file = max(1, math.ceil(file_bytes / (row["mean"] + 600)))
        (
            records(pages.filter(length == row["class"]) if len(classes) > 1 else pages, revisits=revisits, **date, **options)
            .write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file)
            .text(path)
        )


HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def parse_records(raw: bytes):
    """(headers, payload) of the records of one archive file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        if not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.decode(): v.decode("utf-8") for k, v in HEADER.findall(raw, at, end)}
        size = int(head["Content-Length"])
        yield head, raw[end : end + size]
        at = end + size + len(END)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: headers and payload."""
    import gzip

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, payload in parse_records(gzip.decompress(content.as_py())):
                    page = head.get("X-Page-Id")
                    rows.append((None if page is None else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], head.get("WARC-Refers-To"), head["WARC-Payload-Digest"].partition(":")[2], int(head["X-Payload-Length"]), payload))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _payload_digest():
    @F.arrow_udf("struct<bytes: long, digest: string>")
    def digest(payload: pa.Array) -> pa.Array:
        found = payload.to_pylist()
        return pa.StructArray.from_arrays([pa.array([len(p) for p in found], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in found], pa.string())], names=["bytes", "digest"])

    return digest


def op4_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back and give the contract's columns.

    A revisit's length and digest are those of the response it refers to, found by record id.
    """
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path).select("page_id", "warc_type", F.col("refers_to").alias("refers"), "declared_digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    responses = found.filter("warc_type = 'response'")
    revisits = found.filter("warc_type = 'revisit'").select("page_id", "refers", "declared_digest")
    originals = responses.filter(F.col("digest") == F.col("declared_digest")).select(_record_id(F.col("page_id"), F.col("digest")).alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes"), "digest").distinct()
    resolved = revisits.join(originals, "refers").filter(F.col("digest") == F.col("declared_digest"))
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")]
    return responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select(*columns, F.lit("revisit").alias("record_type"), "refers_to")
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
