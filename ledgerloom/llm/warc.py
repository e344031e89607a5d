"""Operator 5: WARC archives, written by tasks and read back by byte ranges.

Each record is a gzip member of its own, so a reader can start anywhere: it scans its range for gzip
magic, takes a candidate for a member if what it decodes begins as a WARC header, and owns the records
that start inside its range, reading past the end to finish the last.

A task writes files of new names to the shared folder and reports them in its result rows; only files
that a finished task reported are read, so retried and lost tasks leave nothing behind that counts.

Defined results: null html is the empty payload; rows with equal payloads of at least `min_bytes` bytes
revisit the one with the largest page_id (rows that share that page_id are responses each; rows without
a page_id revisit it, or are responses where no row has one); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_dir, written

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
BLOCK = 1 << 18
SPLIT_BYTES = 8 << 20
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP header alone; its payload's length is in a header field."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body += b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="/:?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the table of their files: path, size, records."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.sha1(F.encode("html", "UTF-8")))
    last = rows.groupBy("key").agg(F.max("page_id").alias("last"))
    marked = rows.join(last, "key").select("page_id", "url", "html", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count, made = None, "", 0, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                made.append((name, size, count))

        for batch in batches:
            for page, url, html, last_page in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= FILE_BYTES:
                    close()
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                revisit = len(payload) >= min_bytes and last_page is not None and page != last_page
                data = record(page, url, payload, last_page, revisit)
                out.write(data)
                size, count = size + len(data), count + 1
        close()
        columns = list(zip(*made)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["name", "size", "records"])

    files = written(marked.mapInArrow(write, "name string, size long, records long"), "warc-files")
    return files.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "size", "records")


class Source:
    """Bytes of a file from a place on, kept from the place last asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""

    def upto(self, n: int) -> bytes:
        """At least n bytes from the present place, fewer at the file's end."""
        while len(self.data) < n:
            more = self.file.read_at(max(BLOCK, n - len(self.data)), self.at + len(self.data))
            if not more:
                break
            self.data += more
        return self.data

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def member(source: Source) -> tuple[bytes, int] | None:
    """The decoded member at the present place and its length there; None if there is no WARC record."""
    unpack, fed, out = zlib.decompressobj(31), 0, b""
    parts: list[bytes] = []
    try:
        while not unpack.eof:
            data = source.upto(fed + BLOCK)[fed : fed + BLOCK]
            if not data:
                return None
            parts.append(unpack.decompress(data))
            fed += len(data)
            if len(out) < len(HEAD):
                out = b"".join(parts)[: len(HEAD)]
                if not HEAD.startswith(out[: len(HEAD)]) and not out.startswith(HEAD):
                    return None
    except zlib.error:
        return None
    return (b"".join(parts), fed - len(unpack.unused_data)) if out.startswith(HEAD) else None


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded records that start in [start, end)."""
    source = Source(file, start)
    while source.at < end:
        data = source.upto(BLOCK)
        if len(data) < len(MAGIC):
            return
        found = data.find(MAGIC)
        if found < 0:
            source.skip(len(data) - len(MAGIC) + 1)
            continue
        source.skip(found)
        if source.at >= end:
            return
        got = member(source)
        if got is None:
            source.skip(1)
            continue
        yield got[0]
        source.skip(got[1])


def parsed(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]

    def page(field: str) -> int | None:
        text = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    if fields["WARC-Type"] == "revisit":
        size, digest, payload = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    else:
        size, digest = len(payload), payload_digest(payload)
        if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return page("WARC-Record-ID"), unquote(fields.get("WARC-Target-URI", "")), fields["WARC-Type"], page("WARC-Refers-To"), size, digest, payload


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records (RECORDS) of a table of files (path, size), read by ranges of split_bytes."""
    ranges = files.filter("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    tasks = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, own = fs.FileSystem.from_uri(path)
                with store.open_input_file(own) as file:
                    rows, held = [], 0
                    for data in records_in(file, start, end):
                        rows.append(parsed(data))
                        held += len(data)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    return ranges.repartition(int(tasks), "path", "start").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read from freshly written archives."""
    records = read_archives(write_archives(pages, min_bytes))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with pages_ as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, strlen(html)::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 5 * (k // 4)::int + 1, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
    case when page_id = last or last is null then 'response' else 'revisit' end as record_type,
    case when page_id <> last then last end as refers_to
from pages_
"""
