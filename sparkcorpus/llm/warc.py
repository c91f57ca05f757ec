"""WARC archives: written by tasks, indexed first, read by coalesced byte ranges.

Writing returns an index with one row per record (archive, offset, length, URL, digest).
Readers select index rows, sort them by archive and offset, join neighbours into one read, and
parse the records.  Archives lie in the shared folder and are reached through Arrow's file
systems, so they may be in any store that has a URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.llm.scratch import Scratch

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Neighbouring records are read at once if no more than GAP bytes lie between them, up to READ bytes.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of archives that a task reads, about.
TASK = 32 << 20
INDEX = "archive string, offset long, length long, url string, digest string, record_key long, record_type string"
RECORD = "record_key long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'record {key}')}>"


def header_safe(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, without compression.  A revisit has the response's HTTP head and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    if key is not None:
        head.append(f"WARC-Source-Key: {key}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Source-Key: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record; a damaged one raises ValueError."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if len(body) < int(fields["content-length"]):
        raise ValueError("a WARC record is cut off")
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    revisit = fields["warc-type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["warc-payload-digest"].partition(":")[2]
    if not revisit and digest_of(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return {"record_key": number("warc-source-key"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number("warc-refers-to-source-key"), "digest": digest, "payload_bytes": sizes[0] if revisit else len(payload), "payload": None if revisit else payload}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")


def deduplicated(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(key, url, payload, digest, size, refers_to): of equal payloads the largest key is the
    response, the others refer to it.  A null payload is empty; rows with a null key are responses."""
    data = F.coalesce(F.encode(df[payload], "UTF-8"), F.lit(b""))
    rows = df.select(df[key].cast("long").alias("key"), df[url].alias("url"), data.alias("payload"), F.sha1(data).alias("sha1"), F.length(data).cast("long").alias("size"))
    # counted first and joined back: copies in any number meet as one row each task
    response = rows.groupBy("sha1").agg(F.max("key").alias("response"))
    met = rows.join(response, "sha1")
    return met.select("key", "url", F.when(F.col("key") < F.col("response"), F.lit(None)).otherwise(F.col("payload")).alias("payload"), "sha1", "size", F.when(F.col("key") < F.col("response"), F.col("response")).alias("refers_to"))


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", level: int = 1) -> DataFrame:
    """Write archives under `folder` and return the index (lazy: materialise it once).

    Each task writes one archive under a name of its own attempt and renames it when it is
    whole; index rows name the file of the attempt that Spark took.  Records are gzip members.

    Every row is a record.  A null payload is empty and a null URL left out; rows with a null key are responses.
    Repeated rows with one key and payload are all responses, and copies refer to the key.  A payload of any length is
    one record, held in memory by its task.  No rows give no archive; other columns are ignored.  Keys are cast to long.
    """
    rows = deduplicated(df, key, url, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        fs = path = None
        for batch in batches:
            index: list[tuple] = []
            for k, u, data, sha1, size, refers in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if out is None:
                    fs, path = store(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{path}.part", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(record(k, u, data or b"", digest, size, refers)) + packer.flush()
                out.write(packed)
                index.append((name, at, len(packed), u, digest, k, "response" if refers is None else "revisit"))
                at += len(packed)
            if index:  # if the task fails later, its rows go with it
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["archive", "offset", "length", "url", "digest", "record_key", "record_type"])
        if out is not None:
            out.close()
            fs.move(f"{path}.part", path)

    return rows.mapInArrow(run, INDEX)


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """Reads (offset, length, records) that cover sorted records, neighbours together."""
    out: list[list] = []
    for i, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2].append(i)
        else:
            out.append([at, n, [i]])
    return [tuple(x) for x in out]


def read(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records that the index rows name.  Rows are sorted by archive and offset, so that a task
    reads few archives, forwards, in ranges; there are as many tasks as the records' bytes ask for.  Repeated index
    rows give repeated records; an empty index gives no rows."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    wanted = index.select("archive", "offset", "length").repartitionByRange(size // TASK + 1, "archive", "offset").sortWithinPartitions("archive", "offset")

    def fetch(name: str, offsets: list[int], lengths: list[int]) -> Iterator[dict]:
        fs, path = store(name)
        with fs.open_input_file(path) as file:
            for at, n, members in ranges(offsets, lengths):
                data = file.read_at(n, at)
                for i in members:
                    begin = offsets[i] - at
                    yield parse(zlib.decompress(data[begin : begin + lengths[i]], 31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("record_key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))
        for batch in batches:
            names, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            begin, found, size = 0, [], 0
            while begin < len(names):
                end = begin
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                for x in fetch(names[begin], offsets[begin:end], lengths[begin:end]):
                    size += len(x["payload"] or b"")
                    if not keep_payload:
                        x["payload"] = None
                    found.append(x)
                    if keep_payload and size > READ:
                        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in kinds], [k for k, _ in kinds])
                        found, size = [], 0
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in kinds], [k for k, _ in kinds])

    return wanted.mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = scratch.keep(write(pages, scratch.path("archives")), "index")
    records = read(index, keep_payload=False)
    return records.select(F.col("record_key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM h
"""
