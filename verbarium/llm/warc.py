"""WARC archives: a writer with revisit records and a splittable reader, both Spark data sources.

Every record is a gzip member of its own. A read task owns the records that
start in its byte range: it scans the range for the gzip magic, accepts a place only
if the member there decodes to a WARC version line, and reads the last record to
its end beyond the range. After a damaged record the scan goes on from the next magic.

Of pages whose payloads are equal (and of at least ``min_payload`` bytes) that with the
smallest id is a response; the others are revisits that refer to it and hold its
digest and, in the HTTP header, the length, but no payload. Null payloads are
empty. Rows with a null id are always responses; rows that agree in id and
payload are alike. An empty table gives an archive without records.

A write task writes to a file name of its own; files get their final names only when
all tasks have succeeded, and those of failed attempts are removed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import Scratch, small_side, spread_join

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
LEVEL = 3
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pafs.LocalFileSystem(), path)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member; a revisit if it refers to a page."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(raw: bytes) -> dict:
    """A decompressed record's fields; a response's digest is computed from its payload, and ValueError raised if the header's differs."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload digest differs")
    length = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


class _Window:
    """Bytes of a file from a place on, read in steps and let go once passed."""

    def __init__(self, file, at: int, step: int):
        self.file, self.step, self.base, self.data, self.done = file, step, at, bytearray(), False
        file.seek(at)

    def more(self) -> bool:
        new = b"" if self.done else self.file.read(self.step)
        self.done = not new
        self.data += new
        return bool(new)

    def forget(self, at: int) -> None:
        if at - self.base > self.step:
            del self.data[: at - self.base]
            self.base = at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at a place and where it ends; None if no whole WARC record is there."""
    unpack, out, i = zlib.decompressobj(31), [], at - window.base
    sure = False
    try:
        while not unpack.eof:
            if i >= len(window.data) and not window.more():
                return None
            part = window.data[i : i + (1 << 16)]
            i += len(part)
            out.append(unpack.decompress(part))
            if not sure:
                start = b"".join(out)[:7]
                if not b"WARC/1.".startswith(start):
                    return None
                sure = len(start) == 7
    except zlib.error:
        return None
    return b"".join(out), window.base + i - len(unpack.unused_data)


def records_of(file, start: int, end: int, step: int = 4 << 20) -> Iterator[dict]:
    """The records of an open archive that start in [start, end)."""
    window, at = _Window(file, start, step), start
    while at < end:
        i = window.data.find(MAGIC, at - window.base)
        while i < 0:
            at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            window.forget(at)
            if at >= end or not window.more():
                return
            i = window.data.find(MAGIC, at - window.base)
        at = window.base + i
        if at >= end:
            return
        if (found := _member(window, at)) is None:
            at += 1
            continue
        raw, after = found
        try:
            yield decode_record(raw)
        except (ValueError, KeyError, TypeError):
            after = at + 1  # damaged: whatever begins inside may be a record
        at = after
        window.forget(at)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _open(self.path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        fs.create_dir(f"{base}/_pending", recursive=True)
        with fs.open_output_stream(f"{base}/_pending/{name}", compression=None) as out:
            for batch in iterator:
                for at in range(0, batch.num_rows, 500):
                    ids, urls, html, digests, refers = (c.to_pylist() for c in batch.slice(at, 500).columns)
                    for i, u, h, d, r in zip(ids, urls, html, digests, refers):
                        out.write(encode_record(i, u, h, base64.b32encode(d).decode(), r, self.level))
        return _Written(name)

    def commit(self, messages) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        for m in filter(None, messages):
            fs.move(f"{base}/_pending/{m.name}", f"{base}/{m.name}")
        if fs.get_file_info(f"{base}/_pending").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_pending")

    def abort(self, messages) -> None:
        fs, base = _open(self.path)
        if fs.get_file_info(f"{base}/_pending").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_pending")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, payload: bool):
        self.path, self.split, self.payload = path, split, payload

    def partitions(self):
        fs, base = _open(self.path)
        files = sorted((f for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".warc.gz")), key=lambda f: f.path)
        return [_Range(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as file:
            rows, held = [], 0
            for r in records_of(file, partition.start, partition.end):
                if not self.payload:
                    r["payload"] = None
                rows.append(r)
                held += len(r["payload"] or b"")
                if len(rows) >= 5000 or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcSource(DataSource):
    """``format("verbarium_warc")``; options: level (writing), split_bytes, payload (reading)."""

    @classmethod
    def name(cls) -> str:
        return "verbarium_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("level", LEVEL)))


def write_pages(pages: DataFrame, path: str | None = None, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write an archive of pages and return its path (a scratch folder, if none is given).

    Only digests and ids are grouped; payloads move just to be joined with the table of
    revisits, and not at all if that is small.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archive")
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    page = page.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    seen = scratch.save(page.select("id", "digest", F.octet_length("html").alias("bytes")), "digests")
    first = seen.where(F.col("bytes") >= min_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = scratch.save(first, "firsts")
    again = spread_join(seen, first.drop("n"), ["digest"], scratch, "hot", first.select("digest", "n"))
    again = scratch.save(again.where("id <> first").select("id", "digest", "first").distinct(), "revisits")
    joined = page.join(small_side(again, 64), ["id", "digest"], "left")
    joined.select("id", "url", F.col("html").cast("binary").alias("html"), "digest", "first").write.format("verbarium_warc").mode("append").save(path)
    return path


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """The records of an archive, columns as in SCHEMA; without ``payload`` that column is null."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("verbarium_warc").option("split_bytes", split_bytes).option("payload", str(payload).lower()).load(path)
