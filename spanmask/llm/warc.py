"""WARC revisit resolution: deduplicated archives with fresh headers, and their reader.

Only headers (id, digest, length) are shuffled by payload digest; the record
with the smallest id of each digest stays a response, the others become revisit
records that refer to it and carry no payload.  Archives are written by Spark's
text writer (a WARC record of UTF-8 payload is text; CRLF CRLF ends a record)
as gzip files in any folder that Spark can write, and read back the same way:
the reader puts the pieces between CRLF CRLF together by Content-Length, one
record at a time, so neither side needs a whole archive in memory.

Cases: a null payload is empty; a null id never becomes the original of a
record that has an id; a null url gets a ``urn:`` target; CR and LF in a url
are percent-encoded; rows repeating id and payload are written once per row,
with one decision; empty tables give empty archives; other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, materialize

CRLF2 = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 (five hex digits give four base32 characters)."""
    char = lambda n, s: F.substring(F.lit(BASE32), (F.shiftright(n, s).bitwiseAND(F.lit(31))) + 1, F.lit(1))

    def digits(hexa: Column) -> Column:
        five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexa, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
        return F.array_join(F.transform(five, lambda n: F.concat(*[char(n, s) for s in (15, 10, 5, 0)])), "")
    return bind(F.sha1(payload), digits)


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers (page_id, payload_digest, payload_bytes) -> the same plus record_type, refers_to.

    Payloads shorter than ``min_bytes`` are always responses.
    """
    heads = materialize(records.select("page_id", "payload_digest", "payload_bytes").distinct(), "headers")
    first = materialize(heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
                        .agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "originals")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (heads.join(first, ["payload_digest", "payload_bytes"], "left")
            .select("page_id", "payload_digest", "payload_bytes",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first")).alias("refers_to")))


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"),
                    part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def record_text() -> Column:
    """One WARC record without its end mark, from page_id, url, html and the resolved header columns."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF2))
    block = F.concat(http, body)
    optional = lambda cond, col: F.when(cond, col).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))),
        optional(F.col("url").isNull(), F.lit("X-No-URI: true\r\n")),
        optional(F.col("page_id").isNotNull(), line("X-Page-ID", F.coalesce("page_id", F.lit(0)))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        optional(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))),
                                   line("X-Refers-To-Page-ID", F.coalesce("refers_to", F.lit(0))))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF2), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 50_000) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as gzip WARC files under ``path``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumn("payload_digest", sha1_base32(payload))
    heads = rows.select("page_id", "payload_digest", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"))
    resolved = materialize(resolve_revisits(heads, min_bytes), "resolved").alias("h")
    same = F.col("r.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("r.payload_digest") == F.col("h.payload_digest"))
    (rows.alias("r").join(resolved, same)
     .select("r.page_id", "url", "html", "h.payload_digest", "payload_bytes", "record_type", "refers_to")
     .select(record_text().alias("value"))
     .write.option("lineSep", CRLF2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(header fields, content block) of each record in a stream of pieces.

    The pieces may come from several files: a payload that ends in CRLF leaves a
    piece of CRLFs at its file's end, so CRLFs before a record are left out.
    """
    end = CRLF2.encode()
    parts, size, need = [], 0, 0
    for piece in pieces:
        parts += (piece, end)
        size += len(piece) + 4
        while size >= max(need, 5):
            buf = b"".join(parts)
            if buf.startswith(b"\r\n"):
                buf = buf.lstrip(b"\r\n")
                parts, size, need = [buf], len(buf), 0
                continue
            if not buf.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {buf[:40]!r}")
            head = buf.find(end)
            fields = dict(x.split(": ", 1) for x in buf[:head].decode().split("\r\n")[1:])
            need = head + 4 + int(fields["Content-Length"]) + 4
            if size < need:
                parts = [buf]
                break
            yield fields, buf[head + 4:need - 4]
            parts, size, need = [buf[need:]], size - need, 0
    if b"".join(parts).strip(b"\r\n"):
        raise ValueError(f"the last WARC record is cut off after {size} bytes")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for f, block in _records(v.encode() for b in batches for v in b["value"]):
        payload = block[block.index(b"\r\n\r\n") + 4:]
        digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
        if f["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {f['WARC-Record-ID']} does not fit its header")
        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
        rows.append((number("X-Page-ID"), None if "X-No-URI" in f else f["WARC-Target-URI"], f["WARC-Type"],
                     number("X-Refers-To-Page-ID"), n, digest, payload))
        held += len(payload)
        if len(rows) >= 2000 or held > 8 << 20:
            yield _frame(rows)
            rows, held = [], 0
    yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")])
    return df.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives written by :func:`write_archives`; payloads are checked against their digests."""
    return spark.read.option("lineSep", CRLF2).text(path).mapInPandas(_parse, READ_SCHEMA)
