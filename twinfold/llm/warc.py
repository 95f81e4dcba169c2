"""WARC archives with revisit records, read back as a table of chunks.

Writing: payload digests are computed in the JVM and summed to one row for each different payload; the record with the
smallest page_id of a payload is a response, the others are revisits that refer to it. Payloads reach the writer as
chunk rows, so that a task streams a record of any size into a compressed archive (one gzip member for each record)
without holding it. A task writes one file under a name of its own and renames it when it is complete, so that a
repeated task leaves one file.

Reading: an archive is streamed, and each record comes out as rows (record, chunk number) with the chunk, the bytes so
far and the SHA-1 so far; the last chunk's row has those of the whole payload.

Files are opened through pyarrow's file systems (file, hdfs, s3, gs), by the address of the shared folder.

Defined results: a null html is an empty payload; a row without page_id is a response and has page_id null; rows equal
in page_id and payload are records of the same kind; a null url leaves out the target; an empty table gives no files
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Payloads below this many bytes are never revisits; bytes in a chunk row to be written, and in one that the reader gives.
MIN_BYTES, WRITE_BYTES, CHUNK_BYTES = 0, 1 << 18, 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_id string, record_type string, refers_to long, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean, intact boolean"


def file_system(address: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for an address such as Hadoop writes it (file:/x and file:///x alike)."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if address.startswith("/"):
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_rows(pages: DataFrame, min_bytes: int = MIN_BYTES, chunk_bytes: int = WRITE_BYTES) -> DataFrame:
    """page_id, url, size, sha1, refers_to, chunk_no, last, data: a record's chunks follow one another."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html").cast("long"))
    marks = cut(rows.select("page_id", "sha1", "size"))
    first = marks.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = marks.join(first, ["sha1", "size"]).where(F.col("page_id") > F.col("refers_to")).select("page_id", "sha1", "refers_to").distinct()
    known = rows.join(revisits, ["page_id", "sha1"], "left")
    body = F.when(F.col("refers_to").isNull(), F.col("html").cast("binary")).otherwise(F.lit(b""))
    count = F.greatest(F.ceil(F.octet_length("body") / chunk_bytes), F.lit(1)).cast("int")
    # Cut within the row: only the pieces are exploded, so a payload is not copied once for each of its chunks.
    piece = lambda i: F.struct(i.alias("chunk_no"), (i == F.size(F.col("numbers")) - 1).alias("last"), F.substring(F.col("body"), i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    each = known.withColumn("body", body).drop("html").withColumn("numbers", F.sequence(F.lit(0), count - 1))
    return each.select("page_id", "url", "size", "sha1", "refers_to", F.explode(F.transform("numbers", piece)).alias("c")).select("page_id", "url", "size", "sha1", "refers_to", "c.chunk_no", "c.last", "c.data")


def record_head(page: int | None, serial: str, url: str | None, size: int, digest: str, refers: int | None) -> bytes:
    """Headers of a record up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{serial if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each task; returns the manifest (path, records), which is computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        fs, root = file_system(folder)
        path, draft = f"{root}/{name}.warc.gz", f"{root}/.{name}.{task.taskAttemptId()}.draft"
        out, records, packer, started = None, 0, None, False
        for batch in batches:
            for page, url, size, sha1, refers, no, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(draft)
                if no == 0:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(record_head(page, f"{name}.{records}", url, size, base32(sha1), refers)))
                out.write(packer.compress(data))
                if last:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
        if out is not None:
            out.close()
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)
            fs.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([records], pa.int64())], names=["path", "records"])

    return cut(chunks.mapInArrow(run, "path string, records long"))


class Archive:
    """A stream of gzip members, read line by line or in pieces of bounded size."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece, self.held, self.gzip = stream, piece, bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        data = self.gzip.unconsumed_tail or self.gzip.unused_data
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        data = data or self.stream.read(self.piece)
        if data:
            self.held += self.gzip.decompress(bytes(data), 1 << 20)
        return bool(data)

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n")) < 0:
            if not self.fill():
                return None
        got = bytes(self.held[:end])
        del self.held[: end + 2]
        return got

    def read(self, most: int) -> bytes:
        while len(self.held) < most and self.fill():
            pass
        got = bytes(self.held[:most])
        del self.held[:most]
        return got


def fields(archive: Archive) -> dict[str, str]:
    """Header lines up to the empty one."""
    found = {}
    while line := archive.line():
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_archives(manifest: DataFrame, payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all archives; without payload, data is null and the digests are computed all the same."""

    def page(uri: str | None) -> int | None:
        number = (uri or "").strip("<>").rpartition(":")[2]
        return int(number) if number.lstrip("-").isdigit() else None

    def records(path: str) -> Iterator[tuple]:
        fs, name = file_system(path)
        with fs.open_input_stream(name, compression=None) as stream:
            archive = Archive(stream)
            while (version := archive.line()) is not None:
                if not version:
                    continue
                head = fields(archive)
                left = int(head["content-length"])
                archive.line()  # the status line
                http = fields(archive)
                kind, told = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                common = (page(head["warc-record-id"]), head["warc-record-id"], kind, page(head.get("warc-refers-to")))
                size = int(http["content-length"])
                if kind == "revisit":
                    yield (*common, 0, None, size, told, True, True)
                    continue
                digest, done, no = hashlib.sha1(), 0, 0
                while True:
                    data = archive.read(min(chunk_bytes, size - done))
                    digest.update(data)
                    done += len(data)
                    if done < size and not data:
                        raise ValueError(f"{path}: record {head['warc-record-id']} ends after {done} of {size} bytes")
                    so_far = base32(digest.digest())
                    yield (*common, no, data if payload else None, done, so_far, done == size, done < size or (so_far == told and size <= left))
                    no += 1
                    if done == size:
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        names = ["page_id", "record_id", "record_type", "refers_to", "chunk_no", "data", "payload_bytes", "payload_digest", "last", "intact"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(path):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared one."""
    return f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
