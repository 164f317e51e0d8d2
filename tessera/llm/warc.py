"""WARC: archives written per partition and read back by boundary-chain verification.

`write_archives(pages, path)` writes one record per row: of rows with equal payloads that with the smallest page_id is a
`response` (all rows that share this smallest id are), the others are `revisit` records that name it and the digest but
hold no payload. `read_archives(spark, path)` returns one row per record.

Reading: every occurrence of the version line in a file is a candidate; its header names a length, hence the offset of
its successor. Those candidate links form a graph in which pointer jumping from the start of the file (doubling, so as
many rounds as the logarithm of the candidates) keeps only reachable records: version lines inside payloads, even whole
records inside payloads, are rejected. A chain that does not end at the end of its file raises an error.

Defined results: a null html is an empty payload and a null url `about:blank`; a null page_id sorts after all others and
its record carries no id (null refers_to where a group has null ids only); repeated rows stay; an empty table gives an
archive without records and an empty result; columns other than page_id, url and html are not archived.

One file is read by one task, so written files are bounded in bytes: records lie in folders by size, and a file holds 4096 records (`records`)
of up to 64 KB, 256 of up to 1 MB, 16 of up to 16 MB or one larger one: 256 MB at most, or one record. Files of other writers may hold
up to 2 GB, Spark's limit for one binary value.
"""

from __future__ import annotations

import hashlib
import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import looked_up
from .runtime import shared_folder, stored

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
BROADCAST_ROWS = 500_000
#: Bytes of the records of the first class of sizes; each further class is of 16 times as much.
CLASS_BYTES = 1 << 16
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n|$)", re.IGNORECASE)
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, offset long"
# Digits of Spark's base 32 and of RFC 4648.
_DIGITS, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1, eight digits from each ten of its hexadecimal form."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _DIGITS, _RFC)


def record_rows(pages: DataFrame) -> DataFrame:
    """Rows with record_type, refers_to, payload_bytes and payload_digest.

    Ids and digests alone are shuffled as long as the groups of copies number BROADCAST_ROWS at most.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("about:blank")).alias("url"), payload.alias("html"))
    rows = rows.withColumns({"payload_digest": sha1_base32(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")})
    # Only groups with several ids take part in the join, so it is as small as the copies are few.
    firsts = stored(rows.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-firsts")
    # Some 50 bytes a row: broadcast below a checked size; else payloads are shuffled by digest, but for those of large groups.
    rows = looked_up(rows, firsts, "payload_digest", "left", most=BROADCAST_ROWS)
    first = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.withColumns({"record_type": F.when(first, "response").otherwise("revisit"), "refers_to": F.when(~first, F.col("first_id"))}).drop("first_id")


def write_archives(pages: DataFrame, path: str, records: int = 4096) -> None:
    """Uncompressed archives below path, in a folder for each class of sizes, each the output of one task or a part of it."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    revisit = F.col("record_type") == "revisit"
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    written = record_rows(pages).select(F.concat(head, block).alias("value"))
    size = F.octet_length("value")
    kind = F.when(size <= CLASS_BYTES, 0).when(size <= CLASS_BYTES << 4, 1).when(size <= CLASS_BYTES << 8, 2).otherwise(3)
    # An archive without records is a file all the same.
    for k in sorted(r[0] for r in written.select(kind.alias("k")).distinct().collect()) or [0]:
        written.where(kind == k).write.option("lineSep", END).option("maxRecordsPerFile", max(1, records >> 4 * k)).text(f"{path.rstrip('/')}/{k}")


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Offsets of all version lines that a length follows, their successors' offsets, and where their blocks begin."""
    at, after, blocks = [], [], []
    end, m = -1, None
    i = data.find(VERSION)
    while i >= 0:
        # Headers may be of any length: the first blank line and length behind i are sought anew only once i has passed them.
        if end < i:
            end = data.find(b"\r\n\r\n", i)
            if end < 0:
                break
            m = LENGTH.search(data, i, end)
        elif m and m.start() < i:
            m = LENGTH.search(data, i, end)
        if m:
            at.append(i)
            after.append(end + 4 + int(m[1]) + 4)
            blocks.append(end + 4)
        i = data.find(VERSION, i + 1)
    return np.array(at, np.int64), np.array(after, np.int64), blocks


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Indices of candidates on the chain from offset 0, by pointer jumping; the chain has to end at size."""
    n = len(at)
    if not size:
        return np.zeros(0, np.int64)
    # Node n is the file's end, node n + 1 nowhere; both point at themselves.
    found = np.searchsorted(at, after)
    exact = (found < n) & (at[np.minimum(found, n - 1)] == after) if n else np.zeros(0, bool)
    jump = np.concatenate([np.where(exact, found, np.where(after == size, n, n + 1)), [n, n + 1]]).astype(np.int64)
    kept = np.zeros(n + 2, bool)
    kept[0 if n and at[0] == 0 else n + 1] = True
    while True:
        grown = kept.copy()
        grown[jump[kept]] = True
        if (grown == kept).all():
            break
        kept, jump = grown, jump[jump]
    if kept[n + 1] or not kept[n]:
        raise ValueError("the chain of records does not reach the end of the file")
    return np.flatnonzero(kept[:n])


def _identity(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def parse_archive(data: bytes) -> Iterator[dict]:
    at, after, blocks = candidates(data)
    for i in reachable(at, after, len(data)).tolist():
        lines = data[at[i] + len(VERSION) : blocks[i] - 4].decode().split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[blocks[i] : after[i] - 4]
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = head["warc-type"] == "revisit"
        yield {
            "page_id": _identity(head.get("warc-record-id")),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "refers_to": _identity(head.get("warc-refers-to")),
            "payload_bytes": int(head["x-payload-length"]) if revisit else len(payload),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "payload": None if revisit else payload,
            "offset": int(at[i]),
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path; payload is null for revisits, or for all if payloads is False."""
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_archive(content.as_py()):
                    size += r["payload_bytes"] if payloads else 0
                    rows.append(r if payloads else r | {"payload": None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, fields)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's row per page, from the archives read back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows by DuckDB, for tables without repeated page ids.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, min(page_id) AS first_id FROM p GROUP BY x)
SELECT p.page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST(('0x' || substr(p.x, CAST(1 + 10 * (i // 8) AS INTEGER), 10)) AS BIGINT) >> CAST(5 * (7 - i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN first_id END AS refers_to
FROM p JOIN g ON p.x = g.x
"""
