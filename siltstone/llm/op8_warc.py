"""WARC records in ZIP archives: a writer, and a reader that range-reads records in place.

Writer: each task writes archives of its own into the shared folder, rolled at
``roll`` bytes: a stored member ``archive/data.warc.gz`` (one gzip member per
record) and a stored member ``indexes/index.cdxj`` with each record's offset and
length. A file gets its final name when it is complete, with the attempt in the
name; only the archives that the committed attempts return are in the manifest, and
what repeated or lost tasks left behind is deleted when it is written.

Reader: finds the end record (with its ZIP64 locator and record where there are),
parses the central directory, checks that the members are stored, reads the index
and then each record by its byte range. Nothing is extracted or read whole.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is
written whole and the others are revisits of it. Digests are compared in an aggregate with map-side
combining. The list of revisits goes to the pages as a broadcast if it has at most ``BROADCAST_REVISITS`` rows, and then payloads don't move; a
longer one is met by a merge join, which moves them once (a hot digest's rows are split by the adaptive join).

Files are written and read by tasks with pyarrow's file systems: local or mounted paths, and the stores that it knows (``s3a:`` is read as ``s3:``).

Defined results: null html is an empty payload; a null url has no target; rows that repeat a page_id and payload
are responses alike if they have the smallest page_id; null page_ids are written, and never referred to
while another has the payload; very long payloads are a record each, written and read one at a time; ties (rows of one page_id and payload) don't matter;
columns other than page_id, url and html are not read and not returned; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, slices, utf8

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF
#: About 60 bytes each, 30 MB.
BROADCAST_REVISITS = 500_000


def _filesystem(folder: str):
    """pyarrow's file system and the path in it; plain paths and ``file:`` are local or mounted."""
    from pyarrow import fs

    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    if parts.scheme in ("s3a", "s3n"):
        folder = f"s3{folder[3:]}"
    return fs.FileSystem.from_uri(folder)


class ZipWriter:
    """Stored members only, written in order; sizes of 4 GB and more, and many members, go to ZIP64 fields."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member of unknown size: its sizes follow it in a data descriptor, with 64 bits each."""
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 8, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def data(self, data: bytes) -> None:
        m = self.members[-1]
        m[2] = zlib.crc32(data, m[2])
        m[3] += len(data)
        self.write(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.write(struct.pack("<4sI2Q", b"PK\x07\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            wide = struct.pack("<2H3Q", 1, 24, size, size, at) if size >= MAX32 or at >= MAX32 else b""
            small = (MAX32, MAX32) if wide else (size, size)
            self.write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 8, 0, 0, 0x21, crc, *small, len(raw), len(wide), 0, 0, 0, 0, MAX32 if wide else at) + raw + wide)
        n, size = len(self.members), self.at - start
        if n >= MAX16 or size >= MAX32 or start >= MAX32:
            end = self.at
            self.write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, min(n, MAX16), min(n, MAX16), min(size, MAX32), min(start, MAX32), 0))


@dataclass(frozen=True)
class Member:
    name: str
    start: int  #: of its data
    size: int
    crc: int


class ZipReader:
    """The central directory of a seekable file; members are read by ranges."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.read_bytes = file, size, 0
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, size: int) -> bytes:
        if start < 0 or size < 0 or start + size > self.size:
            raise ValueError("a range outside the archive")
        self.file.seek(start)
        self.read_bytes += size
        return self.file.read(size)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - MAX16 - 22)
        tail = self.range(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, n, size, start, _ = struct.unpack_from("<4H2IH", tail, at + 4)
        if n == MAX16 or size == MAX32 or start == MAX32:
            mark, _, where, _ = struct.unpack("<4sIQI", self.range(tail_at + at - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, *_, n, size, start = struct.unpack("<4sQ2H2I4Q", self.range(where, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        directory, at = self.range(start, size), 0
        for _ in range(n):
            mark, _, _, _, method, _, _, crc, packed, full, names, extras, comments, _, _, _, header = struct.unpack_from("<4s6H3I5H2I", directory, at)
            if mark != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            name = directory[at + 46 : at + 46 + names].decode()
            extra = directory[at + 46 + names : at + 46 + names + extras]
            packed, full, header = _wide(extra, packed, full, header)
            at += 46 + names + extras + comments
            if method != 0 or packed != full:
                continue  # not stored: no range of it is a record
            local = self.range(header, 30)
            n_name, n_extra = struct.unpack_from("<2H", local, 26)
            yield Member(name, header + 30 + n_name + n_extra, full, crc)


def _wide(extra: bytes, packed: int, full: int, header: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            full = next(values) if full == MAX32 else full
            packed = next(values) if packed == MAX32 else packed
            header = next(values) if header == MAX32 else header
        at += 4 + size
    return packed, full, header


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's length and digest stand in its header."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return head, block


class _Archive:
    """A file in the making."""

    def __init__(self, filesystem, folder: str, name: str) -> None:
        self.fs, self.path, self.part = filesystem, f"{folder}/{name}", f"{folder}/.{name}.part"
        self.stream = filesystem.open_output_stream(self.part)
        self.zip, self.index, self.offset = ZipWriter(self.stream), [], 0
        self.zip.begin(DATA)

    def add(self, page_id: int | None, record: bytes) -> None:
        member = gzip.compress(record, 4, mtime=0)
        self.zip.data(member)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.offset, "length": len(member)}, separators=(",", ":")))
        self.offset += len(member)

    def close(self) -> tuple[str, int, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.data("".join(f"{x}\n" for x in self.index).encode())
        self.zip.end()
        self.zip.close()
        self.stream.close()
        self.fs.move(self.part, self.path)
        return os.path.basename(self.path), len(self.index), self.zip.at


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll: int = 128 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) to ``folder`` and returns the manifest: archive, records, bytes."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    long = pages.where(F.octet_length("payload") >= least)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    firsts = materialise(firsts.select(F.col("digest").alias("of"), "first"), "first-copies")
    again = long.select("page_id", "digest").join(firsts, F.col("digest") == F.col("of")).where("page_id is null or page_id <> first")
    again = materialise(again.select(F.col("page_id").alias("id"), "digest", "first").distinct(), "revisits")
    again = again.hint("broadcast" if again.count() <= BROADCAST_REVISITS else "merge")
    same = (pages.page_id.eqNullSafe(again.id)) & (pages.digest == again.digest)
    rows = pages.join(again, same, "left").select("page_id", "url", "payload", pages.digest.alias("digest"), "first")

    mark = uuid.uuid4().hex[:12]  # of this write's files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        task, archive, done = TaskContext.get(), None, []
        for batch in slices(batches, "payload"):
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    archive = _Archive(filesystem, root, f"part-{mark}-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip")
                number = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{archive.path}:{archive.offset}"))
                archive.add(page_id, record_bytes("response" if first is None else "revisit", page_id, url, payload, digest, first, number))
                if archive.offset >= roll:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    manifest = materialise(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")
    _delete_orphans(folder, mark, manifest)
    return manifest


def _delete_orphans(folder: str, mark: str, manifest: DataFrame) -> None:
    """Files of this write that no committed attempt returned."""
    spark = manifest.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*part-{mark}-*")) or []
    if len(own) > manifest.count():
        known = {r.archive for r in manifest.select("archive").toLocalIterator()}  # a name for each ``roll`` bytes
        for status in own:
            if status.getPath().getName() not in known:
                files.delete(status.getPath(), False)


def read_archive(filesystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record that the archive's index names."""
    size = filesystem.get_file_info(path).size
    with filesystem.open_input_file(path) as file:
        archive = ZipReader(file, size)
        data, index = archive.members[DATA], archive.members[INDEX]
        for line in io.BytesIO(archive.range(index.start, index.size)):
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > data.size:
                raise ValueError("the index points outside its member")
            yield parse_record(gzip.decompress(archive.range(data.start + entry["offset"], entry["length"])))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest.

    A response's digest and length are taken from what was read, and must be what its header says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                for head, block in read_archive(filesystem, f"{root}/{name}"):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["Payload-Length"])
                    response = head["WARC-Type"] == "response"
                    if response:
                        if hashlib.sha256(block).hexdigest() != digest or len(block) != size:
                            raise ValueError("a payload differs from its digest")
                    page, first, url = head.get("Page-ID"), head.get("Refers-To-Page-ID"), head.get("WARC-Target-URI")
                    rows.append((page and int(page), url if url is None else unquote(url), head["WARC-Type"], first and int(first), block if response else None, size, digest))
                    held += len(block)
                    if held >= 4 << 20 or len(rows) >= 2000:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    some = manifest.select("archive").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return some.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))
