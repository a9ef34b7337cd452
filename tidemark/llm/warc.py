"""Content-addressed web archive: payloads stored once by digest, exact record headers apart.

``write_archive`` turns rows into WARC/1.1 records. A record's header block is kept byte for byte in
the ``headers`` table; its payload goes to the ``payloads`` table once for each SHA-256 digest.
``read_archive`` verifies every stored payload against its digest and length, parses the header
blocks, and ``records`` joins both and gives the original records back byte for byte. All of it is
DataFrame work. Each payload is shuffled once when it is written, to meet the row that stores it, and
once when records are put together; which records are revisits is settled on digests and ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Payloads shorter than this are never replaced by a revisit.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _header(line: str, value) -> F.Column:
    return F.concat(F.lit(line + ": "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) below ``path`` as ``headers`` and ``payloads``.

    A null html is an empty payload, a null url an empty target. Of equal payloads of at least
    ``REVISIT_BYTES`` bytes the record with the smallest page_id is the response and the others
    revisit it; rows that repeat that page_id are responses too, and a null page_id ranks last. If
    no row of a payload has a page_id, all its rows are responses.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    slim = materialize(rows.drop("payload"), "warc-slim")
    first = slim.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("k")).groupBy("digest")
    first = materialize(first.agg(F.min("page_id").alias("first_id"), F.sum("k").alias("copies"), F.min_by("k", "page_id").alias("lead")), "warc-first")
    # only payloads that several rows share need the join; a digest has one row on the right, so a hot one can be split
    shared = first.where("copies > 1").select("digest", "first_id")
    marked = slim.join(shared, "digest", "left").withColumn(
        "refers_to", F.when((F.col("n") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    )
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _header("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", uri(F.col("page_id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    marked.select(F.encode(head, "UTF-8").alias("header"), "digest").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    _store(rows, first).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _store(rows: DataFrame, first: DataFrame) -> DataFrame:
    """One row for each digest: of each payload's rows all but the first are dropped where ids are joined, spread over (page_id, digest)."""
    owners = first.select(F.col("digest").alias("d"), F.col("first_id").alias("i"))
    lead = rows.join(owners, (rows.digest == owners.d) & rows.page_id.eqNullSafe(owners.i), "left_semi").select("digest", "payload")
    repeated = first.where("coalesce(lead, copies) > 1").limit(1).count()
    return lead.groupBy("digest").agg(F.first("payload").alias("payload")) if repeated else lead


def _field(name: str) -> F.Column:
    return F.regexp_extract("text", rf"(?s)^WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records below ``path``, parsed: page_id, url, record_type, refers_to, payload_digest, payload_bytes, header.

    Raises if a payload is missing or does not have the digest and the length that its records state.
    """
    headers = spark.read.parquet(f"{path}/headers").withColumn("text", F.decode("header", "UTF-8"))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    parsed = headers.select(
        number(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        number(_field("WARC-Refers-To")).alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("stated"),
        F.regexp_extract("text", r"(?s)\r\n\r\nHTTP/1\.1 .*?Content-Length: (\d+)\r\n", 1).cast("long").alias("n"),
        "header",
    )
    # digest and length are computed where a payload lies, so that only they are joined
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("stated"), F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    joined = parsed.join(stored, "stated", "left")
    sound = F.coalesce((F.col("stated") == F.col("payload_digest")) & (F.col("n") == F.col("payload_bytes")), F.lit(False))
    wrong = F.assert_true(sound, F.concat(F.lit("payload missing or damaged: "), F.col("stated")))
    return joined.where(wrong.isNull()).drop("stated", "n")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header_bytes and the exact bytes of each record: header block, payload unless it is a revisit, and the closing line ends."""
    parsed = read_archive(spark, path).select("page_id", "record_type", "payload_digest", "header")
    payloads = spark.read.parquet(f"{path}/payloads")
    body = parsed.where("record_type = 'response'").join(payloads, parsed.payload_digest == payloads.digest)
    end, size = F.encode(F.lit(CRLF * 2), "UTF-8"), F.octet_length("header").cast("long").alias("header_bytes")
    return body.select("page_id", size, F.concat("header", "payload", end).alias("record")).unionByName(
        parsed.where("record_type = 'revisit'").select("page_id", size, F.concat("header", end).alias("record"))
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive as gzipped WARC files below ``out``, one a partition; the record's end serves as the writer's line end."""
    body = records(spark, path).select(F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8").alias("value"))
    body.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(out)


def digests(rebuilt: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, all read from the bytes of ``records``; a revisit's payload is that of the response with its digest."""
    payload = F.expr("substring(record, int(header_bytes) + 1, octet_length(record) - int(header_bytes) - 4)")
    rows = rebuilt.select("page_id", F.decode(F.expr("substring(record, 1, int(header_bytes))"), "UTF-8").alias("text"), payload.alias("payload"))
    rows = rows.select(
        "page_id",
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("stated"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    rows = materialize(rows, "warc-digests")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    full = rows.where("record_type = 'response'")
    # one row for each digest that is revisited
    seen = full.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    again = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated").join(seen, F.col("stated") == F.col("payload_digest"), "left")
    return full.select(*names).unionByName(again.select(*names))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, puts their records together again from the archive and describes these; odd rows as in :func:`write_archive`."""
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return digests(records(spark, path))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT digest, min(page_id) AS first_id FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (digest)
"""
