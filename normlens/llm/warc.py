"""Content-addressed WARC archive: payloads once, exact record headers apart, records rebuilt by joins.

An archive is two Parquet tables in a folder:

    payloads  digest, payload_digest, size, response_id, payload
    headers   record_id, digest, block_start, head

``digest`` is the SHA-256 of the payload, the content address; ``payload`` is
stored once for each. ``head`` holds the exact bytes of a record up to its
payload: the WARC header lines, and the block's HTTP header lines. A record is
its head, its payload if it is a response, and two line ends, so the join of
both tables on ``digest`` rebuilds every record byte for byte.

Of the records with one payload, that with the largest id is the response and
the others are revisits of it, which have no payload in their block. Payloads
of fewer than ``least_bytes`` bytes are stored once like any other, but all of
their records are responses.

The address is verified: a digest that stands for payloads of two lengths stops
the writing, and on reading every payload's SHA-256 and the header's SHA-1 are
computed again, so a damaged payload raises.

A payload shared by a third of all rows is one row for each task before the
shuffle by digest. The two joins carry narrow rows on the many side; their
sides are exchanges, so Spark splits a partition that one digest fills.

Edge cases: null html is the empty payload, null url an empty target; rows with
a null id are records with an empty id, and revisits unless all ids are null;
repeated rows are records of their own, and records that tie on the largest id
are all responses; payloads of any length stay whole; an empty table gives
empty tables. Only the id, url and html columns are read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm.frames import map_batches, ready
from normlens.plans.relational import shared_folder

# --- Fixed values: the record format --------------------------------------------
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http; msgtype=response"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
END = b"\r\n\r\n"
# --------------------------------------------------------------------------------

#: Date of all records; tables of pages carry none.
DATE = "2024-01-01T00:00:00Z"
PAYLOADS = "digest binary, payload_digest string, size long, response_id long, payload binary"
HEADERS = "record_id long, digest binary, block_start int, head binary"
RECORDS = "record_id long, record binary, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record_urn(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def urn_id(urn: str) -> int | None:
    digits = urn[len("<urn:page:"):-1]
    return int(digits) if digits else None


def head(record_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, size: int,
         date: str = DATE) -> tuple[bytes, int]:
    """The bytes of a record before its payload, and where its block begins in them.

    Line ends and other white space in a target would end its header line, so
    they are percent-encoded.
    """
    target = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url)
    http = HTTP_HEAD.format(size=size).encode()
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(record_id)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    length = len(http) + (size if kind == "response" else 0)
    lines += [f"Content-Type: {CONTENT_TYPE}", f"Content-Length: {length}"]
    named = "\r\n".join(lines).encode() + END
    return named + http, len(named)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = stop + len(END)
        end = begin + int(fields["content-length"])
        if data[end:end + len(END)] != END:
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, data[begin:end]
        at = end + len(END)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def write(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url",
          html: str = "html", date: str = DATE) -> None:
    """Write the archive of ``pages`` to ``folder``."""
    spark = ready(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("record_id"), F.coalesce(url, F.lit("")).alias("url"),
                        F.coalesce(html, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))

    def address(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {c: batch.column(c) for c in batch.schema.names}
        made = pa.array([payload_digest(p) for p in columns["payload"].to_pylist()], pa.string())
        return pa.record_batch([columns["digest"], made, *(columns[c] for c in ("size", "response_id", "payload"))],
                               names=["digest", "payload_digest", "size", "response_id", "payload"])
    length = F.length("payload")
    once = rows.groupBy("digest").agg(
        F.max("record_id").alias("response_id"), F.min(length).alias("least"), F.max(length).alias("most"),
        F.first("payload").alias("payload")).select(
        "digest", F.when(F.col("least") == F.col("most"), F.col("most").cast("long")).otherwise(
            F.raise_error(F.lit("one digest stands for payloads of two lengths"))).alias("size"), "response_id", "payload")
    map_batches(once, address, PAYLOADS).write.parquet(f"{folder}/payloads")

    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").drop("payload")
    is_response = (F.col("size") < least_bytes) | F.col("record_id").eqNullSafe(F.col("response_id"))

    def heads(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ("record_id", "url", "response", "response_id", "payload_digest", "size")
        made = [head(i, u, "response" if r else "revisit", to, d, n, date)
                for i, u, r, to, d, n in zip(*(batch.column(c).to_pylist() for c in names))]
        return pa.record_batch([batch.column("record_id"), batch.column("digest"), pa.array([m[1] for m in made], pa.int32()),
                                pa.array([m[0] for m in made], pa.binary())], names=["record_id", "digest", "block_start", "head"])
    placed = rows.drop("payload").join(stored, "digest").withColumn("response", is_response)
    map_batches(placed, heads, HEADERS).write.parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record, payload): every record's exact bytes, and the payload of it or of what it revisits."""
    ready(spark)
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "payload")

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, verified = [], set()
        starts, begun, digests = (batch.column(c).to_pylist() for c in ("head", "block_start", "digest"))
        for data, begin, digest, payload in zip(starts, begun, digests, batch.column("payload").to_pylist()):
            if digest not in verified:
                if sha256(payload).digest() != digest:
                    raise ValueError(f"payload {digest.hex()} is damaged")
                verified.add(digest)
            whole = b"\r\nWARC-Type: response\r\n" in data[:begin]
            made.append(b"".join((data, payload, END)) if whole else data + END)
        return pa.record_batch([batch.column("record_id"), pa.array(made, pa.binary()), batch.column("payload")],
                               names=["record_id", "record", "payload"])
    return map_batches(headers.join(payloads, "digest"), rebuild, RECORDS)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, target, payload_bytes, payload_digest, record_type, refers_to), read from the rebuilt records."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, payload in zip(batch.column("record").to_pylist(), batch.column("payload").to_pylist()):
            for fields, block in parse(data):
                kind, digest = fields["warc-type"], payload_digest(payload)
                inside = block[block.index(END) + len(END):]
                if fields["warc-payload-digest"] != f"sha1:{digest}" or inside != (payload if kind == "response" else b""):
                    raise ValueError(f"record {fields['warc-record-id']} does not match its payload")
                to = fields.get("warc-refers-to")
                out.append((urn_id(fields["warc-record-id"]), fields["warc-target-uri"], len(payload), digest, kind,
                            None if to is None else urn_id(to)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[
            "page_id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return map_batches(records(spark, folder), run, "page_id long, target string, payload_bytes long, payload_digest string, "
                                                    "record_type string, refers_to long")
