"""WARC archives: a writer with revisit records and a sequential reader.

Each record is one gzip member. The writer gives every task's archive to the shared folder under
a name that a repeated attempt overwrites by renaming, so a lost executor leaves no partial file.
The reader decompresses incrementally, cuts records by Content-Length, never holds more than one
record, and checks each payload against its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnworks.llm.batches import map_arrow
from cairnworks.scratch import scratch_path, shuffle_partitions

CRLF = b"\r\n"
#: Bytes read or decompressed at a time.
CHUNK = 1 << 20
#: Fixed, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; a plain path or file: URI is a shared local folder.

    The names that Hadoop's connectors have for S3 mean S3.
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def record_id(page_id: int | None) -> str:
    """A record's URI, from which the page's id can be read again."""
    number = (1 << 64) if page_id is None else page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(urn: str) -> int | None:
    number = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    return None if number >> 64 else number - (1 << 64) if number >> 63 else number


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One gzip member. A revisit has no payload; its headers tell the digest and size of the full one."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "urn:none").split())),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to[0])), ("WARC-Profile", REVISIT_PROFILE)]
        payload = b""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + CRLF + payload + CRLF + CRLF, 6, mtime=0)


class BadRecord(ValueError):
    """A record that is cut short or doesn't agree with its own headers."""


def _members(stream) -> Iterator[bytes]:
    """Decompressed chunks; an empty one ends each gzip member."""
    raw = b""
    inflate = None
    while True:
        if not raw:
            raw = stream.read(CHUNK)
            if not raw:
                break
        if inflate is None:
            inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
        data = inflate.decompress(raw, CHUNK)
        if data:
            yield data
        if inflate.eof:
            raw, inflate = inflate.unused_data, None
            yield b""
        else:
            raw = inflate.unconsumed_tail
    if inflate is not None:
        raise BadRecord("the archive ends inside a gzip member")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record, read in order; headers' names are lower case."""
    held, headers, length, start = bytearray(), None, 0, 0
    for data in _members(stream):
        held += data
        if headers is None and (end := held.find(CRLF + CRLF)) >= 0:
            first, *lines = bytes(held[:end]).decode().split("\r\n")
            if not first.startswith("WARC/1."):
                raise BadRecord(f"not a WARC record: {first[:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length, start = int(headers["content-length"]), end + 4
        if not data:
            if headers is None or bytes(held[start + length :]) != CRLF + CRLF:
                raise BadRecord("a record is not as long as its Content-Length")
            payload = bytes(held[start : start + length])
            if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
                raise BadRecord(f"payload digest of {headers['warc-record-id']} doesn't match")
            yield headers, payload
            held, headers = bytearray(), None


def payload_of(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, revisit, refers_to).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    id is the response, the others revisit it. Payloads are equal by SHA-256 and length. Groups
    are combined before the shuffle, and the way back is salted by page, so a payload that a
    third of all pages share is spread over all partitions. Of rows with the same smallest id
    the one with the smallest url is the response, and of repeated ones any. Nulls are smallest.
    """
    salts = shuffle_partitions(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload_of(html_col).alias("payload"))
    key = F.struct(F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("n"))
    rows = rows.withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    shared = rows.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = shared.where(F.col("key.n") >= least_bytes).select("key", "first")
    spread = rows.select("key", "salt").distinct().join(shared, "key")
    nth = F.row_number().over(Window.partitionBy("key", "salt", "page_id", "url").orderBy(F.lit(1)))  # tells repeated rows apart
    both = rows.join(spread, ["key", "salt"], "left").withColumn("nth", nth)
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("nth") == 1)
    revisit = F.col("first").isNotNull() & ~is_first
    return both.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a task; rows (path, n_records). Runs when the result is read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = file_system(folder)
        name, n, out = f"{base}/part-{task.partitionId():06d}.warc.gz", 0, None
        part = f"{base}/.attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                page, url, payload, revisit, refers = (batch.column(k) for k in range(5))
                for i in range(batch.num_rows):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(part)
                    target = (refers[i].as_py(),) if revisit[i].as_py() else None
                    out.write(encode_record(page[i].as_py(), url[i].as_py(), payload[i].as_py(), target))
                    n += 1
            if out is not None:
                out.close()
                store.move(part, name)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(part)
            raise
        if n:
            path = name if folder.startswith("/") else f"{folder}/{os.path.basename(name)}"
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return map_arrow(records, write, "path string, n_records long")


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives named in ``path``; each archive is read by one task."""

    def rows(path: str) -> Iterator[dict]:
        store, where = file_system(path)
        with store.open_input_stream(where, compression=None) as stream:
            for head, payload in read_records(stream):
                yield {
                    "page_id": page_of(head["warc-record-id"]),
                    "url": head["warc-target-uri"],
                    "record_type": head["warc-type"],
                    "payload_bytes": int(head["warc-payload-length"]),
                    "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
                    "refers_to": page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None,
                    "payload": payload if payloads else None,
                }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return map_arrow(paths.select("path"), read, READ_SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = False) -> DataFrame:
    """Writes all pages as archives to the shared folder and reads the archives back.

    One row for each page, nulls and repeats included: null html is the empty payload, a null
    url is ``urn:none``; other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    written = write_archives(plan_records(pages, least_bytes, id_col, url_col, html_col), folder).collect()  # a row for each archive
    paths = spark.createDataFrame([(r["path"],) for r in written], "path string").repartition(max(1, len(written)))
    return read_archives(spark, paths, payloads)
