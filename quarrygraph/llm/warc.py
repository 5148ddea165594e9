"""A content-addressed WARC archive: payload bytes once per digest, exact record headers apart.

The archive is two tables in the shared folder: ``payloads(digest, length, payload)``, one row a digest, and
``headers(page_id, digest, header)``, the exact bytes of every record before its payload: the WARC/1.1 header and the
head of the HTTP response. Reading joins them, checks the digest of every stored payload again and parses the headers; a
record is these bytes, the payload, and two line ends. A revisit's block is the HTTP head alone, as the format has it,
and its payload comes from the same digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: Payloads below this many bytes are stored as responses each.
REVISIT_FROM = 100
#: Date of records whose table names none.
DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"


def record_headers(records: DataFrame, date: str = DATE) -> DataFrame:
    """``(page_id, digest, header)`` of ``records(page_id, url, digest, length, kind, refers_to, first_url)``. Record-IDs
    are unique, also where rows repeat. A url with characters that no header line can hold is also kept in base64."""
    revisit = F.col("kind") == "revisit"
    url, first = F.coalesce("url", F.lit("")), F.coalesce("first_url", F.lit(""))
    control = r"[\x00-\x1f\x7f]"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    encoded = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("length").cast("string"), F.lit(_CRLF * 2))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.format_string("<urn:page:%s:%d>", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.monotonically_increasing_id())),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(url, control, " ")),
        F.when(url.rlike(control), line("X-Target-URI-Base64", encoded(url))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("WARC-Refers-To-Target-URI", F.regexp_replace(first, control, " "))),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(date))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", size.cast("string")),
    ]
    text = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), http)
    return records.select("page_id", "digest", text.cast("binary").alias("header"))


def write_archive(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> tuple[DataFrame, DataFrame]:
    """Writes ``pages(page_id, url, html)`` and returns ``(payloads, headers)``.

    A null html is an empty payload and a null url an empty one. Of records with equal payloads of ``revisit_from``
    bytes or more, the one of the smallest page_id is the response; repeated rows of that page_id are responses each,
    and rows of a null page_id come last. Smaller payloads are all responses. Repeated rows are records each. An empty
    table makes an empty archive; other columns are ignored. Payloads that share a digest but not their length or second hash stop the write.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("length"), F.xxhash64("payload").alias("check"), "payload")
    # one row a digest and map task moves, however often a payload is repeated
    light = rows.drop("payload")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.max("length").alias("length"), F.min("length").alias("least"), F.max("check").alias("check"), F.min("check").alias("check_least"))
    same = (F.col("length") == F.col("least")) & (F.col("check") == F.col("check_least"))
    firsts = firsts.withColumn("first", F.when(same, F.col("first")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("bigint")))
    big = F.col("length") >= revisit_from
    named = light.drop("length", "check").join(firsts.select("digest", "first", "first_url", "length"), "digest")
    answer = ~big | F.col("page_id").eqNullSafe(F.col("first"))
    records = named.withColumn("kind", F.when(answer, "response").otherwise("revisit")).withColumn("refers_to", F.when(~answer, F.col("first")))
    headers = write_shared(record_headers(records), "warc-headers")
    stored = rows.groupBy("digest").agg(F.max("length").alias("length"), F.first("payload").alias("payload"))
    payloads = write_shared(stored, "warc-payloads")
    return payloads, headers


def _field(name: str) -> Column:
    """The value of a field of the WARC header; null where there is none."""
    return F.nullif(F.regexp_extract(F.col("text"), rf"(?s)\r\n{name}: (.*?)\r\n", 1), F.lit(""))


def read_archive(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, header, payload)`` of every record,
    parsed from its header and joined to its payload by digest; urls are those that were written, a null one empty. A
    payload whose digest isn't its key stops the read. Headers of one hot digest are a skewed join to a single payload
    row."""
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))).cast("binary")))
    joined = headers.drop("page_id").join(checked.drop("length"), "digest").withColumn("text", F.concat(F.substring_index(F.decode("header", "UTF-8"), _CRLF * 2, 1), F.lit(_CRLF)))
    exact = F.decode(F.unbase64(_field("X-Target-URI-Base64")), "UTF-8")
    return joined.select(
        _field("X-Page-ID").cast("bigint").alias("page_id"),
        F.coalesce(exact, _field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.substr(_field("WARC-Payload-Digest"), F.lit(len("sha256:") + 1)).alias("payload_digest"),
        "header",
        "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``(page_id, record)``: the exact bytes of each record as a WARC file holds them."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def report(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("url"))


ORACLE = f"""
WITH rows AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), digested AS (
  SELECT page_id, url, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM rows
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM digested GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {REVISIT_FROM} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first THEN first END AS refers_to,
       coalesce(url, '') AS url
FROM digested JOIN firsts USING (payload_digest)
"""
