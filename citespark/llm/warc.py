"""Content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; rows with one digest are compared byte by byte when they are stored. The
exact header block of every record is stored apart, with the digest that leads to the payload. A response record holds an
HTTP head and the payload, a revisit record the HTTP head alone. Reading joins both, gives the records back byte for byte,
and puts the payload beside them. ``split_records`` reads records that lie end to end by their Content-Length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import Scratch

MIN_REVISIT = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column, row: Column) -> Column:
    """An id that no two rows share, also where page ids repeat."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("null")), row.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def http_head(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))


def header(revisit: Column, date: str) -> Column:
    """The header block of one record, with the empty line that ends it, and the HTTP head that follows."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    clean, head = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "), http_head(F.col("size"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page"), F.col("row"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("Content-Type", F.lit("application/http;msgtype=response")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first.page"), F.col("first.row"))),
                                 line("X-Refers-To-Page", F.col("first.page").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", (F.length(head) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")), F.lit(CRLF), head)


def write_archive(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "2026-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """pages -> (headers: page, digest, header bytes; payloads: digest, payload bytes once each), both written.

    A null payload is empty. Of rows with equal payloads of at least MIN_REVISIT bytes, those with the smallest id are
    responses and the others revisits; null ids are larger than all others. A page id may repeat; each row has a record with
    an id of its own. No rows give two empty tables. Other columns of pages do not matter. ``date`` is that of the crawl.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "page", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size"))
    # the payload of one digest is the same in all rows: each map task passes it on once
    same = F.when(F.min("payload") == F.max("payload"), F.max("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest")).cast("binary"))
    payloads = scratch.put("payloads", rows.groupBy("digest").agg(same.alias("payload")))
    light = scratch.put("rows", rows.select("page", "url", "digest", "size", F.monotonically_increasing_id().alias("row")))
    first = light.groupBy("digest").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row")).alias("first"))
    known = light.join(first.hint("shuffle_merge"), "digest")
    revisit = (F.col("size") >= MIN_REVISIT) & ~F.col("first.none") & ~F.col("page").eqNullSafe(F.col("first.page"))
    headers = scratch.put("headers", known.select("page", "digest", revisit.alias("revisit"), header(revisit, date).cast("binary").alias("header")))
    scratch.drop("rows")
    return headers, payloads


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page, record: the bytes of the record, payload: that of the record or of the one it refers to)."""
    body = F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return headers.join(payloads.hint("shuffle_merge"), "digest").select(
        "page", F.concat("header", body, F.lit(CRLF * 2).cast("binary")).alias("record"), "payload")


def split_records(archives: DataFrame, col: str = "archive") -> DataFrame:
    """Rows with records end to end -> (record), by Content-Length. Raises where a record does not end where it should."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for raw in pdf[col]:
                at, out = 0, []
                while raw is not None and at < len(raw):
                    head = raw.index(b"\r\n\r\n", at) + 4
                    length = next(int(x.split(b":", 1)[1]) for x in raw[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    end = head + length + 4
                    if raw[end - 4:end] != b"\r\n\r\n":
                        raise ValueError("a record does not end at its Content-Length")
                    out.append(bytes(raw[at:end]))
                    at = end
                yield pd.DataFrame({"record": out})

    return archives.select(col).mapInPandas(run, "record binary")


def parse(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, record, payload) -> id, payload_bytes, payload_digest (of the payload as read), record_type, refers_to.

    The block is as long as Content-Length says. Raises if that leaves other than the closing empty lines, if a response's
    payload is not the one stored, or if the stated digest is not that of the payload.
    """
    empty = F.expr("position(X'0D0A0D0A', record)")
    split = records.select("page", "record", "payload", empty.alias("at")).select("page", "record", "payload", "at", F.expr("decode(substring(record, 1, at + 1), 'UTF-8')").alias("head"))

    def field(pattern: str) -> Column:
        return F.regexp_extract("head", pattern, 1)

    read = split.select(
        "page", "record", "payload", "at", field(r"(?m)^Content-Length: (\d+)\r").cast("long").alias("length"), field(r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]{64})").alias("stated"),
        field(r"(?m)^WARC-Type: (\w+)").alias("record_type"), F.expr(r"try_cast(regexp_extract(head, '(?m)^X-Refers-To-Page: (-?[0-9]+)', 1) AS bigint)").alias("refers_to"))
    block = F.expr("substring(record, at + 4, cast(length AS int))")
    whole = F.length("record") == F.col("at") + 3 + F.col("length") + 4
    http = F.expr("position(X'0D0A0D0A', block)")
    read = read.withColumn("block", block).withColumn("body", F.expr("substring(block, position(X'0D0A0D0A', block) + 4, length(block))"))
    right = whole & (http > 0) & ((F.col("record_type") == "revisit") | (F.col("body") == F.col("payload")))
    digest = F.sha2("payload", 256)
    checked = F.when(right & (F.col("stated") == digest), digest).otherwise(F.raise_error(F.lit("a record does not match its payload")).cast("string"))
    return read.select(F.col("page").alias(id_col), F.length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of pages, read back from the archive; columns as in parse, edge cases as in write_archive."""
    scratch = Scratch(spark, "warc")
    return parse(read_archive(*write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id <> m.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id <> m.first THEN m.first END AS refers_to
FROM p JOIN m USING (d)
"""
