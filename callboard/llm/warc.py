"""WARC archives as tables of chunks.

Writing, each page becomes one record, and a payload of more than CHUNK bytes becomes a first
segment and continuation records (the segmentation of the WARC standard), so that no row is longer
than a chunk and its headers. Records go through Spark's text writer into the shared folder; every
record starts with a header that only this archive has, and reading splits the files there, so a
reader gets chunk after chunk: (record_id, chunk, ...). Digests run along: each segment names its
own digest and the last one that of the whole payload, and both are taken again when reading,
chunk by chunk in order, without putting a payload together.

Pages with equal payloads are written once: the one with the least page_id is the response, the
others are revisit records without a body that name it.

Defined results: a null payload is empty; a page without page_id is always a response; rows that
repeat a page_id are records of their own, and with the same payload as their page's response they
are responses too; line ends in a url are percent-encoded. A payload is one value of a row, so the longest has to
fit a task; beyond it memory is bounded by a chunk. Other columns of the input are not read, whatever their names. An
empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import tidy, written

CHUNK = 1 << 18
LEAST_BYTES = 0
# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n"
BLANK = END + END
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{BLANK}"
BOUNDARY = "WARC-Archive-Boundary"

CHUNKS = (
    "record_id string, chunk int, chunks int, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, data binary"
)
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _opening(boundary: str) -> str:
    return f"{VERSION}{END}{BOUNDARY}: {boundary}{END}"


def _pieces(payload: bytes) -> Iterator[bytes]:
    """Stretches of at most CHUNK bytes that end between characters; at least one."""
    first = 0
    while True:
        last = min(first + CHUNK, len(payload))
        while last < len(payload) and payload[last] & 0xC0 == 0x80:
            last -= 1
        yield payload[first:last]
        first = last
        if first >= len(payload):
            return


def record_rows(boundary: str, date: str, page_id: int | None, url: str | None, refers_to: int | None, payload: bytes) -> Iterator[str]:
    """The records of one page, each without its last line feed."""
    record = uuid.uuid4()
    running = hashlib.sha1()
    pieces = _pieces(payload)
    chunk, here = 0, next(pieces)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    while here is not None:
        running.update(here)
        then = next(pieces, None)
        body = b"" if refers_to is not None else HTTP.encode() * (chunk == 0) + here
        kind = "revisit" if refers_to is not None else "continuation" if chunk else "response"
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": f"<urn:uuid:{record if not chunk else uuid.uuid4()}>",
            "WARC-Date": date,
            "WARC-Target-URI": target,
            "WARC-Page-ID": "" if page_id is None else str(page_id),
            "WARC-Block-Digest": f"sha1:{sha1_base32(hashlib.sha1(body).digest())}",
            "Content-Type": "application/http; msgtype=response",
            "Content-Length": str(len(body)),
        }
        segmented = refers_to is None and (chunk or then is not None)
        if segmented:
            headers |= {"WARC-Segment-Number": str(chunk + 1), "WARC-Segment-Origin-ID": f"<urn:uuid:{record}>"}
        if refers_to is not None:
            headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Page-ID": str(refers_to)}
        if then is None:
            headers |= {"WARC-Payload-Digest": f"sha1:{sha1_base32(running.digest())}", "WARC-Payload-Length": str(len(payload))}
            if segmented:
                headers |= {"WARC-Segment-Total-Length": str(len(payload) + len(HTTP))}
        if refers_to is None or then is None:
            lines = "".join(f"{name}: {value}{END}" for name, value in headers.items())
            yield f"{_opening(boundary)}{lines}{END}{body.decode()}{END}\r"
        chunk, here = chunk + 1, then


def first_of_equals(pages: DataFrame, payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, _payload, refers_to) of the pages that repeat the payload of another."""
    prints = pages.select("page_id", _print(payload).alias("_payload"), F.octet_length(F.coalesce(payload, F.lit(""))).alias("size"))
    known = prints.where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes))
    least = known.groupBy("_payload").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most"))
    # Written before it is joined, so that both sides are plain shuffles and a payload of very many pages is divided.
    repeated = written(least.where("refers_to < most").drop("most"), "repeated-payloads").hint("merge")
    return known.join(repeated, "_payload").where("page_id > refers_to").select("page_id", "_payload", "refers_to").distinct()


def _print(payload: str):
    return F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256)


class Archive:
    """Where an archive is and the boundary its records begin with."""

    def __init__(self, folder: str, boundary: str):
        self.folder, self.boundary = folder, boundary


def write(
    pages: DataFrame,
    payload: str = "html",
    least_bytes: int = LEAST_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> Archive:
    """Write an archive of ``pages`` (page_id, url, payload) to the shared folder.

    With ``compression`` "none" the files are plain and can be read in splits; "gzip" makes one
    stream of each file.
    """
    spark = pages.sparkSession
    archive = Archive(new_folder(spark, "warc"), uuid.uuid4().hex)
    boundary = archive.boundary
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(payload).alias("payload"))
    rows = rows.withColumn("_payload", _print("payload"))
    again = first_of_equals(rows, "payload", least_bytes)
    rows = rows.join(again, ["page_id", "_payload"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(name) for name in ("page_id", "url", "refers_to", "payload"))
            for page_id, url, refers_to, body in zip(*columns, strict=True):
                for row in record_rows(boundary, date, page_id.as_py(), url.as_py(), refers_to.as_py(), (body.as_py() or "").encode()):
                    yield pa.RecordBatch.from_arrays([pa.array([row])], names=["value"])

    records = rows.select("page_id", "url", "refers_to", "payload").mapInArrow(work, "value string")
    with tidy(spark):
        records.write.text(archive.folder, compression=compression, lineSep="\n")
    return archive


def _parse(row: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = row.partition(BLANK.encode())
    headers = dict(line.split(": ", 1) for line in head.decode().split(END) if ": " in line)
    size = int(headers["Content-Length"])
    body = rest[:size]
    if len(body) != size or rest[size:] not in (b"", BLANK.encode()):
        raise ValueError(f"record of another length than it says: {headers}")
    if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(hashlib.sha1(body).digest())}":
        raise ValueError(f"record with another digest than it says: {headers}")
    return headers, body


def read(spark: SparkSession, archive: Archive, whole: bool = True) -> DataFrame:
    """The archive as a table of chunks.

    ``data`` is the chunk's part of the payload; without ``whole`` it is left out where a record
    has a single chunk, whose length and digest are then checked at once.
    """
    rows = spark.read.text(archive.folder, lineSep=f"{BLANK}{_opening(archive.boundary)}")
    opening = _opening(archive.boundary).encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                row = value.as_py().encode().removeprefix(opening)
                if not row.strip():
                    continue
                headers, body = _parse(row)
                get = headers.get
                chunk = int(get("WARC-Segment-Number", 1)) - 1
                kind, page, refers = get("WARC-Type"), get("WARC-Page-ID"), get("WARC-Refers-To-Page-ID")
                body = body if chunk or kind == "revisit" else body[len(HTTP) :]
                single = "WARC-Segment-Number" not in headers
                digest, size = get("WARC-Payload-Digest"), get("WARC-Payload-Length")
                if single and kind == "response":
                    check(headers, len(body), hashlib.sha1(body).digest())
                made = {
                    "record_id": get("WARC-Segment-Origin-ID") or get("WARC-Record-ID"),
                    "chunk": chunk,
                    "chunks": chunk + 1 if digest else None,
                    "page_id": int(page) if page else None,
                    "record_type": kind,
                    "refers_to": int(refers) if refers else None,
                    "payload_bytes": int(size) if size else None,
                    "payload_digest": digest.removeprefix("sha1:") if digest else None,
                    "data": body if whole or not single else None,
                }
                yield pa.RecordBatch.from_pylist([made], schema=_CHUNK_SCHEMA)

    return rows.mapInArrow(work, CHUNKS)


_CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("chunk", pa.int32()),
        ("chunks", pa.int32()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("data", pa.binary()),
    ]
)


def check(says: dict[str, str], size: int, digest: bytes) -> None:
    if (says["WARC-Payload-Length"], says["WARC-Payload-Digest"]) != (str(size), f"sha1:{sha1_base32(digest)}"):
        raise ValueError(f"payload of {size} bytes and digest {sha1_base32(digest)}, but its record says {says}")


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, with the length and digest of its payload as read.

    Chunks of a record meet in order in one task, which holds one of them at a time. Records of a
    single chunk come without their data, so only long payloads are moved.
    """
    chunks = read(spark, archive, whole=False).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, running, size = None, hashlib.sha1(), 0
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if not row["chunk"]:
                    first, running, size = row, hashlib.sha1(), 0
                if row["data"] is not None:
                    running.update(row["data"])
                    size += len(row["data"])
                if row["chunks"] is None:
                    continue
                if row["chunk"]:
                    says = {"WARC-Payload-Length": str(row["payload_bytes"]), "WARC-Payload-Digest": f"sha1:{row['payload_digest']}"}
                    check(says, size, running.digest())
                out.append({**{name: first[name] for name in names}, "payload_bytes": row["payload_bytes"], "payload_digest": row["payload_digest"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([_CHUNK_SCHEMA.field(name) for name in names]))

    return chunks.mapInArrow(work, RECORDS)
