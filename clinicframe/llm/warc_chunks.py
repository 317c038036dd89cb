"""WARC records as a chunked record table.

A record is a sequence of rows (archive, record, chunk, bytes, payload_upto, digest_upto).
Row 0 holds the WARC header and the HTTP header; the others hold the payload in pieces
of at most ``CHUNK_BYTES`` and row for row the length and the SHA-1 of the payload so
far; the last row closes the record. The bytes of an archive's rows, in order of record
and chunk, are a WARC/1.1 file. Writing cuts a payload piece by piece into Arrow
batches of bounded size, and reading goes over the rows with one running digest. The page's text
is in memory as Arrow hands it over; its bytes are encoded and digested in slices, first
for the header, then for the chunks, and are never held whole. The archive is a table:
nothing here writes its bytes to a .warc file or parses one, and a reader finds records by
the rows' numbers.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest
page_id is written as a response, the others as revisits: they keep the HTTP header,
with the payload's length, and its digest, but no payload.

Nulls: a null html is an empty payload; a null page_id sorts before every other, and a
null url is written as an empty target. Rows repeated with one page_id and one payload
are written alike. An empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.operators.skew import join_grouped

CHUNK_BYTES = 1 << 16
REVISIT_BYTES = 1000
#: Payload bytes in one Arrow batch.
BATCH_BYTES = 1 << 22
#: Characters that are encoded at once.
SLICE = 1 << 16
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
TABLE = "archive int, record long, chunk long, bytes binary, payload_upto long, digest_upto binary"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): what to write for each page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # Short payloads refer to none and stay where they are. Equal long ones are summed up to one row each before payloads move.
    size = F.octet_length("html")
    long = base.filter(size >= REVISIT_BYTES).withColumn("digest", F.unhex(F.sha2("html", 256)))
    leaders = long.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).filter("copies > 1")
    rows = join_grouped(long, leaders.select("digest", "leader"), "digest", "left").drop("digest")
    rows = rows.unionByName(base.filter(size < REVISIT_BYTES).withColumn("leader", F.lit(None).cast("long")))
    revisit = F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("page_id"))
    return rows.select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("leader")).alias("refers_to"),
    )


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def headers(page_id: int | None, url: str, kind: str, refers_to: int | None, length: int, digest: bytes) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url if c.isprintable())), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(http) + (length if kind == "response" else 0))))
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]).encode() + http


def encoded(text: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a text, slice by slice."""
    for start in range(0, len(text), SLICE):
        yield text[start : start + SLICE].encode()


def chunked(text: str, size: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(piece, payload length so far, digest so far) of the text's UTF-8 bytes, in pieces of ``size`` bytes."""
    running, held, upto = hashlib.sha1(), bytearray(), 0
    for part in encoded(text):
        held += part
        whole = len(held) - len(held) % size
        for start in range(0, whole, size):
            piece = bytes(held[start : start + size])
            running.update(piece)
            upto += len(piece)
            yield piece, upto, running.digest()
        del held[:whole]
    if held:
        running.update(held)
        yield bytes(held), upto + len(held), running.digest()


def to_chunks(plan: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table of planned pages; an archive is one part of the plan."""
    numbered = plan.select("*", F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("record"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "record", "chunk", "bytes", "payload_upto", "digest_upto"]
        for frame in frames:
            rows, held = [], 0
            ids = (frame[c].astype("Int64") for c in ("page_id", "refers_to"))
            for page, refers, url, html, kind, archive, record in zip(*ids, *(frame[c] for c in ("url", "html", "record_type", "archive", "record"))):
                running, length = hashlib.sha1(), 0
                for part in encoded(html):
                    running.update(part)
                    length += len(part)
                digest = running.digest()
                head = headers(None if pd.isna(page) else int(page), url, kind, None if pd.isna(refers) else int(refers), length, digest)
                rows.append((archive, record, 0, head, 0, b""))
                last = 1
                for last, (piece, upto, so_far) in enumerate(chunked(html, chunk_bytes) if kind == "response" else (), 1):
                    rows.append((archive, record, last, piece, upto, so_far))
                    held += len(piece)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                rows.append((archive, record, last + 1, b"\r\n\r\n", length if kind == "response" else 0, digest))
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return numbered.mapInPandas(write, TABLE)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the pages as a chunked record table in Parquet, which compresses it."""
    to_chunks(planned(pages), chunk_bytes).write.parquet(path, compression="zstd")


def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the record table with their bytes compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for frame in frames:
        yield frame.assign(bytes=[squeeze(data) for data in frame["bytes"]])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is digested again piece by piece; a piece whose running
    length or digest differs from the stored one, or a record without its end, is an error.
    """
    # A record's rows are in one file, but a large file is read in splits, so they are dealt by record again.
    chunks = spark.read.parquet(path).select("record", "chunk", "bytes", "payload_upto", "digest_upto")
    # Pieces are compressed on the way.
    chunks = chunks.mapInPandas(packed, chunks.schema).repartition("record").sortWithinPartitions("record", "chunk")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fields, running, length, closed = None, {}, None, 0, True
        expand = zstandard.ZstdDecompressor().decompress

        def result() -> tuple:
            stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
            if not closed or fields["WARC-Type"] == "response" and (running.digest() != stated or length != int(fields["length"])):
                raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
            refers = fields.get("WARC-Refers-To")
            return page_of(fields["WARC-Record-ID"]), int(fields["length"]), stated.hex(), fields["WARC-Type"], page_of(refers) if refers else None

        for frame in frames:
            out = []
            for record, chunk, squeezed, upto, digest in zip(*(frame[c] for c in frame.columns)):
                data = expand(squeezed)
                if record != current:
                    if current is not None:
                        out.append(result())
                    current, fields, running, length, closed = record, parse_headers(data), hashlib.sha1(), 0, False
                elif data == b"\r\n\r\n" and upto == length and (fields["WARC-Type"] == "revisit" or length == int(fields["length"])):
                    closed = True
                else:
                    running.update(data)
                    length += len(data)
                    if length != upto or running.digest() != bytes(digest):
                        raise ValueError(f"chunk {chunk} of {fields['WARC-Record-ID']} is damaged")
            yield finished(out)
        if current is not None:
            yield finished([result()])

    return chunks.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def finished(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
    return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def parse_headers(head: bytes) -> dict[str, str]:
    """The WARC fields, and under ``length`` the payload length that the HTTP header states."""
    warc, http, _ = head.split(b"\r\n\r\n")
    lines = warc.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    fields["length"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]
    return fields
