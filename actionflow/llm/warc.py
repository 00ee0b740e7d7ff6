"""WARC archives: written from a table, read back as a chunked record table.

Writing: each task streams its rows into an archive of gzip members in a shared
folder (any file system that ``pyarrow.fs`` opens by its URI), under a name of its
own for each attempt, and reports it as a row. Those rows are written as a table,
the manifest, and only archives in it are read: what a lost or repeated attempt
left behind is never seen.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes are stored once:
the one with the largest id is the response, others are revisits that refer to it.
Which is which comes from a grouped maximum over digests, partial on the map side,
so a payload that a third of all rows share is one row for each task.

Reading: an archive is decompressed as a stream. A payload is never held whole:
each ``chunk_bytes`` of it are a row of record id and chunk number, with the SHA-1
of the payload up to there, so the last row of a record carries its digest. Records
of other types, such as the one about the archive that each begins with, are passed over. An
archive that ends inside a record, or holds other than the number of records that the
manifest has for it, is an error: nothing is read as complete that isn't.

Defined results: a null payload is empty; a null id is the least of all ids and is
written as such; rows equal in id and payload are records alike (all responses if
theirs is the largest id); an empty table gives no archive and no records.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionflow.llm.scratch import new_path, picked, small_broadcast, written

REVISIT_BYTES = 1000
CHUNK_BYTES = 256 << 10
ARCHIVE_BYTES = 1 << 30
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("record_no", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk_start", T.LongType()), T.StructField("chunk_length", T.LongType()),
    T.StructField("is_last", T.BooleanType()), T.StructField("payload_bytes", T.LongType()), T.StructField("digest_so_far", T.StringType()), T.StructField("declared_digest", T.StringType()), T.StructField("chunk", T.BinaryType()),
])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(record: int | None) -> str:
    return f"<urn:record:{'none' if record is None else record}>"


def _id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name and name != "none" else None


def _field(text: str) -> str:
    """A header value holds no line breaks; they, and the sign itself, are escaped."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex(labelled: str) -> str:
    return base64.b32decode(labelled.partition(":")[2]).hex()


class _Archive:
    """An archive being written; one gzip member for each record."""

    def __init__(self, folder: str, block: int, date: str) -> None:
        self.uri = f"{folder}/{block:06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.records, self.bytes = system.open_output_stream(path, compression=None), 0, 0
        name = f"urn:uuid:{uuid.uuid4()}"
        self._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Filename", self.uri.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], INFO, memoryview(b""))

    def add(self, head: list[tuple[str, str]], start: bytes, payload: memoryview) -> None:
        self._record(head, start, payload)
        self.records += 1

    def _record(self, head: list[tuple[str, str]], start: bytes, payload: memoryview) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(start) + len(payload)))]) + "\r\n"
        parts = [lines.encode(), start, *(payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)), b"\r\n\r\n"]
        for part in parts:
            self._put(packer.compress(part))
        self._put(packer.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.bytes


def _binary(column: pa.Array) -> Iterator[memoryview | None]:
    for x in column:
        yield None if not x.is_valid else memoryview(x.as_buffer())


def write(pages: DataFrame, folder: str, record_id: str = "page_id", uri: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes every row as a WARC record into ``folder``; returns the manifest, a written table.

    date: of all records, by default the time of the call. Record ids are made of
    ``record_id``: they are unique if that is.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    read = picked(pages, id=record_id, uri=uri, body=payload)
    rows = read.select(F.col("id").cast("bigint").alias("id"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body")).withColumn("digest", F.sha1("body"))
    slim = written(rows.where(F.octet_length("body") >= REVISIT_BYTES).select("id", "digest"), "digests")
    largest = slim.groupBy("digest").agg(F.max("id").alias("largest"), F.min("id").alias("least"), F.count("id").alias("ids"), F.count("*").alias("all"))
    revisits = slim.join(largest.where("least < largest OR (ids > 0 AND ids < all)"), "digest").where("NOT id <=> largest")
    revisits = written(revisits.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "largest").distinct(), "revisits")
    met = rows.join(small_broadcast(revisits), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    ready = met.select("id", "uri", "body", "digest", "largest")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, done = None, []
        for batch in batches:
            ids, uris, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for i, body in enumerate(_binary(batch.column(2))):
                archive = archive or _Archive(folder, TaskContext.get().partitionId(), date)
                head = [
                    ("WARC-Type", "response" if refers[i] is None else "revisit"),
                    ("WARC-Record-ID", _urn(ids[i])),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _field(uris[i] or "")),
                    ("WARC-Payload-Digest", _base32(digests[i])),
                ]
                if refers[i] is None:
                    archive.add([*head, ("Content-Type", "application/http;msgtype=response")], HTTP_HEAD, body)
                else:
                    head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers[i])), ("X-Payload-Length", str(len(body)))]
                    archive.add([*head, ("Content-Type", "application/http;msgtype=response")], HTTP_HEAD, memoryview(b""))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return written(ready.mapInArrow(save, MANIFEST), "manifest")


class _Stream:
    """The decompressed bytes of an archive, a piece at a time."""

    def __init__(self, source, piece: int = 64 << 10) -> None:
        self.source, self.piece, self.unzip = source, piece, zlib.decompressobj(31)
        self.held, self.rest, self.inside = bytearray(), b"", False

    def _more(self) -> bool:
        data = self.rest or self.source.read(self.piece)
        self.rest = b""
        if not data:
            if self.inside:
                raise ValueError("the archive ends inside a gzip member")
            return False
        self.held += self.unzip.decompress(data, self.piece)
        self.inside = not self.unzip.eof
        if self.unzip.eof:
            self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        else:
            self.rest = self.unzip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while len(self.held) < most and self._more():
            pass
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def records(source, chunk_bytes: int = CHUNK_BYTES, keep_chunks: bool = True) -> Iterator[dict]:
    """Rows of CHUNKS of an open archive, at least one for each record."""
    stream, number = _Stream(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {version[:40]!r}")
        field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        left = int(field["content-length"])
        if field["warc-type"] not in ("response", "revisit"):  # about the archive, not of it
            while left:
                part = stream.take(min(chunk_bytes, left))
                if not part:
                    raise ValueError("the archive ends inside a record about it")
                left -= len(part)
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError("a record about the archive doesn't end where its length says")
            continue
        http = stream.until(b"\r\n\r\n")
        if http is None:
            raise ValueError("the archive ends behind a header")
        left -= len(http) + 4
        revisit = field["warc-type"] == "revisit"
        own = {
            "record_id": _id(field["warc-record-id"]), "record_no": number, "record_type": field["warc-type"], "target_uri": _unfield(field.get("warc-target-uri", "")),
            "refers_to": _id(field.get("warc-refers-to")), "declared_digest": _hex(field["warc-payload-digest"]),
        }
        number += 1
        sha, start, k = hashlib.sha1(), 0, 0
        while True:
            part = stream.take(min(chunk_bytes, left))
            if left and not part:
                raise ValueError(f"the archive ends inside record {own['record_id']}")
            left -= len(part)
            sha.update(part)
            last = left == 0
            full = None if not last else int(field["x-payload-length"]) if revisit else start + len(part)
            digest = own["declared_digest"] if revisit else sha.copy().hexdigest()
            if last and digest != own["declared_digest"]:
                raise ValueError(f"record {own['record_id']} doesn't have the payload its header declares")
            yield own | {"chunk_no": k, "chunk_start": start, "chunk_length": len(part), "is_last": last, "payload_bytes": full, "digest_so_far": digest, "chunk": part if keep_chunks else None}
            start, k = start + len(part), k + 1
            if last:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {own['record_id']} doesn't end where its length says")


def read(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, keep_chunks: bool = True, rows: int = 512) -> DataFrame:
    """The chunked record table of the archives in the manifest.

    A batch goes out after ``rows`` rows or 4 MB of chunks, whichever comes first.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("record_no", pa.int64()), ("archive", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk_start", pa.int64()), ("chunk_length", pa.int64()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("digest_so_far", pa.string()), ("declared_digest", pa.string()), ("chunk", pa.binary())])
        for batch in batches:
            for uri, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                held, size, met = [], 0, 0
                with system.open_input_stream(path, compression=None) as source:
                    for row in records(source, chunk_bytes, keep_chunks):
                        held.append(row | {"archive": uri})
                        size += row["chunk_length"] if keep_chunks else 0
                        met += row["is_last"]
                        if len(held) >= rows or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if met != many:
                    raise ValueError(f"{uri} has {met} records, the manifest says {many}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    spread = manifest.select("archive", "records").repartition(max(1, min(manifest.count(), 100_000)), "archive")
    return spread.mapInArrow(load, CHUNKS)


def assemble(chunks: DataFrame) -> DataFrame:
    """A row for each record with its payload put together from its chunks (the caller's choice to hold payloads whole)."""
    key = ["archive", "record_no", "record_id", "record_type", "refers_to"]
    parts = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("parts"))
    return parts.select("record_id", "record_type", "refers_to", F.expr("aggregate(parts.chunk, X'', (a, x) -> concat(a, x))").alias("payload"))


def round_trip(pages: DataFrame, record_id: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and gives a row for each record read back."""
    manifest = write(pages, new_path(pages.sparkSession, "warc"), record_id, uri, payload)
    last = read(manifest, keep_chunks=False).where("is_last")
    return last.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))
