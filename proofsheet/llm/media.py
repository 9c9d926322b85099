"""Media columns: a Spark data source over archives of images.

Writing (``format("media_archive")``) gives each task one ZIP archive of 8-bit greyscale PNG members; the commit
lists the archives' names, so files of lost or repeated tasks are never read. A member's payload is its samples: rows of
WIDTH bytes. Reading plans byte-range partitions over the archives' directories: of each archive only the end record is
read, which says where its directory lies; a partition is a range of directory bytes, in proportion to RANGE_BYTES of
members, and owns the entries that start there. It reads that slice of the directory, streams its members' stored bytes
through Arrow in batches of bounded size and retries each member by its offset, on a newly opened file, before it gives up.
Archives that others wrote are read too, stored or deflated; a folder without a list is read whole (``*.zip``).

Files are reached through Arrow's file systems by URI, so an archive folder may lie in any store that they know.

Defined cases: a null text is empty; an empty text's payload is 64 zero bytes; null ids and repeated rows are
members of their own; a very long text is one member and one row; an empty table gives an archive folder without archives
and no rows; members of foreign archives have no doc_id, and their size as n_bytes; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .arrow_text import frugal
from .common import new_path, small_batches

WIDTH = 64
#: Stored bytes of members in one partition of a read, and in one Arrow batch.
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
#: Archives whose end records are read at a time.
PLANNERS = 16
MANIFEST = "_manifest.json"
SCHEMA = "doc_id long, n_bytes long, media binary"


def payload(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH or (WIDTH if not text else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(samples: bytes, level: int = 1) -> bytes:
    """8-bit greyscale image of WIDTH columns, without row filters."""
    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit greyscale image; ValueError for anything else or damaged bytes."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, body = 8, 0, 0, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not written here")
    return rows[:, 1:]


@dataclass
class Archive(WriterCommitMessage):
    """An archive of one task."""

    name: str
    members: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        store, folder = _open(self.uri)
        store.create_dir(folder, recursive=True)
        name, members, out, archive = f"{uuid.uuid4().hex}.zip", 0, None, None
        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                if archive is None:
                    out = store.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                raw = text.as_py()
                info = zipfile.ZipInfo(f"{members:08d}.png")
                info.comment = json.dumps([doc_id, len(raw)]).encode()
                archive.writestr(info, encode_png(payload(raw)))
                members += 1
        if archive is not None:
            archive.close()
            out.close()
        return Archive(name, members)

    def commit(self, messages: list[Archive | None]) -> None:
        store, folder = _open(self.uri)
        store.create_dir(folder, recursive=True)
        listed = [m.name for m in messages if m is not None and m.members]
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Archive | None]) -> None:
        store, folder = _open(self.uri)
        for m in messages:
            if m is not None and m.members:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class ByteRange(InputPartition):
    """Bytes first to last of an archive's directory, which ends at end."""

    name: str
    first: int
    last: int
    end: int


ENTRY, HEADER = b"PK\x01\x02", 46
#: The end record and the longest comment after it; the bytes read beyond a slice for an entry that reaches over it.
TAIL_BYTES = 22 + 65535
OVER_BYTES = HEADER + 3 * 65535


def directory_of(source, size: int) -> tuple[int, int]:
    """(first byte, end) of the directory of an archive of so many bytes, from its end record."""
    start = max(0, size - TAIL_BYTES - 20)
    source.seek(start)
    tail = source.read(size - start)
    at = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)
    while at >= 0 and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    length, first = struct.unpack("<II", tail[at + 12 : at + 20])
    if tail[at - 20 : at - 16] == b"PK\x06\x07":  # a 64-bit record stands where this says
        source.seek(struct.unpack("<Q", tail[at - 12 : at - 4])[0])
        length, first = struct.unpack("<QQ", source.read(56)[40:56])
    return first, first + length


def _entry(data: bytes, at: int) -> tuple[int, tuple] | None:
    """(where the next entry begins, member) of the entry at this place, or None if there is none."""
    if data[at : at + 4] != ENTRY or at + HEADER > len(data):
        return None
    method, crc, size, length = struct.unpack("<H4xIII", data[at + 10 : at + 28])
    name, extra, comment = struct.unpack("<HHH", data[at + 28 : at + 34])
    offset = struct.unpack("<I", data[at + 42 : at + 46])[0]
    body = at + HEADER + name
    wide, k = [], body
    while k + 4 <= body + extra:
        kind, n = struct.unpack("<HH", data[k : k + 4])
        if kind == 1:
            wide = list(struct.unpack(f"<{n // 8}Q", data[k + 4 : k + 4 + n // 8 * 8]))
        k += 4 + n
    length, size, offset = (wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (length, size, offset))
    end = body + extra + comment
    return (end, (offset, size, crc, method, length, data[body + extra : end])) if end <= len(data) else None


def members_in(source, first: int, last: int, end: int) -> list[tuple]:
    """(offset, stored size, CRC, method, doc_id, n_bytes) of the members whose directory entries start in [first, last), in a
    directory that ends at end.

    A slice may begin inside an entry. The first entry of a slice is the first place from which entries follow each other
    without a gap to the slice's end and to the next entry or the directory's end there.
    """
    source.seek(first)
    data = source.read(min(end, last + OVER_BYTES) - first)
    begin = at = data.find(ENTRY)
    while 0 <= at < last - first:
        found, k = [], at
        while k < last - first and (step := _entry(data, k)):
            k, member = step
            found.append(member)
        if k >= last - first and (first + k == end or data[k : k + 4] == ENTRY):
            return sorted((offset, size, crc, method, *_told(comment, length)) for offset, size, crc, method, length, comment in found)
        at = data.find(ENTRY, at + 1)
    if 0 <= begin < last - first:
        raise ValueError("damaged directory")
    return []


def _told(comment: bytes, length: int) -> tuple[int | None, int]:
    """(doc_id, n_bytes) of a member, from its comment if it was written here."""
    try:
        doc_id, n = json.loads(comment)
    except (ValueError, TypeError):
        return None, length
    return doc_id, n


def read_member(reopen: Callable, source, offset: int, size: int, crc: int, method: int = 0, attempts: int = ATTEMPTS):
    """(file, bytes) of the member at offset; a failed or damaged read is tried again on a new file."""
    if method not in (0, 8):
        raise NotImplementedError(f"members packed by method {method}")
    for attempt in range(1, attempts + 1):
        try:
            source.seek(offset)
            head = source.read(30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member here")
            name, extra = struct.unpack("<HH", head[26:30])
            source.seek(offset + 30 + name + extra)
            data = source.read(size)
            if method == 8:
                data = zlib.decompress(data, -15)
            if zlib.crc32(data) != crc:
                raise ValueError("damaged member")
            return source, data
        except (OSError, ValueError, zlib.error, struct.error):
            if attempt == attempts:
                raise
            time.sleep(0.1 * attempt)
            source = reopen()
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        store, folder = _open(self.uri)
        with ThreadPoolExecutor(PLANNERS) as pool:
            every = pool.map(lambda name: self._ranges(store, folder, name), self._names(store, folder))
            return [r for ranges in every for r in ranges] or [ByteRange("", 0, 0, 0)]

    def _names(self, store: fs.FileSystem, folder: str) -> list[str]:
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_file(f"{folder}/{MANIFEST}") as f:
                return json.loads(f.read())
        return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and i.base_name.endswith(".zip"))

    def _ranges(self, store: fs.FileSystem, folder: str, name: str) -> list[ByteRange]:
        """Slices of the directory of one archive, as many as it has RANGE_BYTES of members."""
        with store.open_input_file(f"{folder}/{name}") as source:
            first, end = directory_of(source, source.size())
        n = max(1, -(-first // RANGE_BYTES))
        cuts = [first + (end - first) * k // n for k in range(n + 1)]
        return [ByteRange(name, a, b, end) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _open(self.uri)
        reopen = lambda: store.open_input_file(f"{folder}/{partition.name}")
        source = reopen()
        rows: list[tuple] = []
        held = 0
        for offset, size, crc, method, doc_id, n in members_in(reopen(), partition.first, partition.last, partition.end):
            source, data = read_member(reopen, source, offset, size, crc, method)
            rows.append((doc_id, n, data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """Options: path, the URI of the archive folder."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store(docs: DataFrame, uri: str) -> None:
    """Write the texts of docs(doc_id, text) as media archives under uri."""
    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).write.format("media_archive").mode("append").save(uri)


def load(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, n_bytes, media) of the archives under uri."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(uri)


def feature(samples: np.ndarray) -> str:
    """Mean, spread and entropy (bits) of the samples, and how many rows have more light than their neighbour above."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = samples.size, np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    light = samples.sum(1, dtype=np.int64)
    return f"mean={mean:.4f};std={spread:.4f};entropy={-(p * np.log2(p)).sum():.4f};rising={int((np.diff(light) > 0).sum())}"


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> digests and features of the samples as they are stored."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media"):
                stored = data.as_py()
                samples = decode_png(stored)
                raw = samples.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "media")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), uri)
    return features(load(spark, uri))
