"""WARC archives and revisit resolution (operator 6).

Archives are written by Spark's text writer: a record ends in two CRLFs, which
is the writer's line separator, so every part file is a WARC file (compressed
as one gzip stream), committed atomically and on any store that Spark reaches.
They are read back by the text reader with the same separator; a file is read
by one task in order, and records are cut by their Content-Length, so payloads
may hold any bytes, the separator included.

Resolution shuffles headers only: the response of each payload digest is the
record that holds the payload and has the largest page_id; every other record
of the digest becomes a revisit that refers to it.  The decisions then meet the
payloads by page_id and digest, and all headers are written anew.  A digest
that a third of all records share costs one partial maximum per task, and the
join that brings it back is one that Spark splits.

Defined results: a null payload is empty; empty payloads are equal payloads; a
revisit whose response isn't among the records keeps its reference; rows that
repeat page_id and payload get the same type; control characters in a url are
percent-encoded; a null url has no header; other columns are ignored; an empty
table gives an archive without records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.session import shared_dir

from .common import pin, table

CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload string")


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four letters for every five digits."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame) -> DataFrame:
    """Every page as a response record."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1(payload.cast("binary"))).alias("payload_digest"), payload.alias("payload"))


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records with new types and references; payloads smaller than
    ``min_bytes`` are always responses, revisits carry no payload."""
    headers = records.select("page_id", "payload_digest", "payload_bytes", "record_type", "refers_to")
    large = F.col("payload_bytes") >= min_bytes
    # written, so that Spark can split a digest of many records in the join
    holders = pin(headers.filter((F.col("record_type") == "response") & large)
                  .groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.lit(True).alias("held")), "holders")
    held = F.coalesce(F.col("held"), F.lit(False)) & large
    first = held & F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("record_type") == "response")
    decided = (headers.join(holders, "payload_digest", "left")
               .select(F.col("page_id").alias("d_page"), F.col("payload_digest").alias("d_digest"),
                       F.col("record_type").alias("d_old"),
                       F.when(held & ~first, F.lit("revisit")).otherwise(F.col("record_type")).alias("d_type"),
                       F.when(first, F.lit(None)).when(held, F.col("holder")).otherwise(F.col("refers_to")).alias("d_refers"))
               .distinct())
    same = (records["page_id"].eqNullSafe(decided["d_page"]) & (records["payload_digest"] == decided["d_digest"])
            & (records["record_type"] == decided["d_old"]))
    return (records.drop("refers_to").join(decided, same)
            .select("page_id", "url", F.col("d_type").alias("record_type"), F.col("d_refers").alias("refers_to"),
                    "payload_bytes", "payload_digest",
                    F.when(F.col("d_type") == "response", F.col("payload")).alias("payload")))


def record_text(date: str) -> Column:
    """A record without its final two CRLFs."""
    def urn(c):
        return F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    url = F.col("url")
    for ch in map(chr, [*range(0x20), 0x7F]):
        url = F.replace(url, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    kept = F.coalesce(F.col("payload"), F.lit(""))
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF),
        F.when(F.col("record_type") == "revisit", revisit).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.octet_length(kept)).cast("string"), F.lit(END), http, kept)


def write_archive(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """WARC files, one for each partition of ``records``, into a new folder."""
    (records.select(record_text(date).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").text(path))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None):
    body = (urn or "").strip("<>").removeprefix(_ID)
    return int(body) if body.lstrip("-").isdigit() else None


def parse_record(head: bytes, block: bytes) -> tuple:
    f = _fields(head)
    http, _, payload = block.partition(END.encode())
    kind = f.get("warc-type", "")
    size = int(_fields(http).get("content-length", len(payload)))
    return (_page(f.get("warc-record-id")), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")), size,
            f.get("warc-payload-digest", "").removeprefix("sha1:"),
            payload.decode("utf-8", "replace") if kind == "response" else None)


def cut_records(segments):
    """Records out of a stream of text between separators.

    A file whose last payload ends in a line break has its last separator one
    line earlier, so blank lines before a record don't count."""
    sep, buffer, head, need = END.encode(), bytearray(), None, 0
    for segment in segments:
        buffer += segment.encode("utf-8") + sep
        while True:
            if head is None:
                del buffer[:len(buffer) - len(buffer.lstrip(b"\r\n"))]
                at = buffer.find(sep)
                if at < 0:
                    break
                head = bytes(buffer[:at])
                del buffer[:at + len(sep)]
                need = int(_fields(head)["content-length"])
            if len(buffer) < need + len(sep):
                break
            yield parse_record(head, bytes(buffer[:need]))
            del buffer[:need + len(sep)]
            head = None
    if head is not None or buffer.strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def read_archive(spark: SparkSession, path: str, batch: int = 256) -> DataFrame:
    """The records of all archives in a folder."""
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    def parse(batches):
        rows = []
        for r in cut_records(s for b in batches for s in b.value):
            rows.append(r)
            if len(rows) >= batch:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    return spark.read.option("lineSep", END).text(path).mapInPandas(parse, RECORD_SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: pages written as deduplicated archives and read back."""
    path = shared_dir(spark, "warc") + "/data"
    write_archive(resolve_revisits(page_records(table(spark, sf_dir, "pages"))), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), held AS (
  SELECT hex, max(page_id) AS holder FROM hashed GROUP BY hex
)
SELECT h.page_id, CAST(strlen(h.payload) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h.hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT),
         1) for i in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN h.page_id = d.holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id = d.holder THEN NULL ELSE d.holder END AS refers_to
FROM hashed h JOIN held d USING (hex)
"""
