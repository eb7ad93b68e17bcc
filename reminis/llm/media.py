"""Media columns: a Spark data source over directories of media archives.

Writing. Every task packs its rows into ZIP archives (members are stored as they are), a new one after every
``ARCHIVE_BYTES``, and reports their names; the commit lists them in a manifest of its own, written beside and then
renamed, so what a failed or repeated task left behind is never read and two writers don't meet. Overwriting adds a
manifest first and then deletes those before it with their archives.
Reading. The plan needs file sizes alone: each archive is cut into byte ranges, and a range's task takes the
members that begin in it, which the archive's own directory names (its size is bounded as the archive's is). A range
is read in one stream; a member that
turns out short or corrupt is read again by its offset, by itself, up to ``retries`` times, and is then a row
with its error (the query fails on it). Batches of payloads stream to Spark as Arrow.

A payload (UTF-8 of a text, zeros up to a positive multiple of ``ROW`` bytes) is kept as the samples of a grey
PNG image of 8 bits, ``ROW`` wide; its own length is a text chunk of the image.

Paths are any that pyarrow can open from every executor; the query writes to the session's shared folder.
Defined cases: a null or empty text is ``ROW`` zero bytes; equal texts have equal images wherever they lie;
repeated rows are members of their own; a null id comes back as null; an empty table makes no archives and no rows;
other columns are not read.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import read_table, scratch

ROW = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
MANIFEST = "manifest-"
SCHEMA = "doc_id long, archive string, offset long, media binary, payload binary, n_bytes long, error string"
# The PNG signature.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# --- the image format ------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def encode_image(raw: bytes) -> bytes:
    """A grey 8-bit PNG whose samples are ``raw``, padded."""
    rows = np.frombuffer(padded(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    return b"".join([
        SIGNATURE,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"bytes\0" + str(len(raw)).encode()),
        _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)),
        _chunk(b"IEND", b""),
    ])


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples of an image that ``encode_image`` made and the length before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, data, length = 8, (0, 0), [], -1
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a chunk's checksum is wrong")
        at += 12 + n
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            length = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:].tobytes(), length


def feature_of(payload: bytes) -> str:
    """Height, mean, and an average hash: which of 8 x 8 cells are brighter than the image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int64)
    bands = np.linspace(0, len(rows), 9).astype(np.int64)
    sums = np.concatenate([np.zeros((1, 8), np.int64), rows.reshape(len(rows), 8, ROW // 8).sum(2).cumsum(0)])
    low, high = bands[:-1], np.maximum(bands[1:], np.minimum(bands[:-1] + 1, len(rows)))
    cells = (sums[high] - sums[low]) / np.maximum((high - low) * (ROW // 8), 1)[:, None]
    mean = float(rows.mean())
    return f"{len(rows)}:{mean:.4f}:{np.packbits(cells > mean).tobytes().hex()}"


# --- the data source -------------------------------------------------------------------------------------


@dataclass
class Archives(WriterCommitMessage):
    found: list[tuple[str, int]]  # name, size


@dataclass
class ByteRange(InputPartition):
    name: str
    begin: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict):
        self.path, self.overwrite = path, overwrite
        self.archive_bytes = int(options.get("archivebytes") or options.get("archiveBytes") or ARCHIVE_BYTES)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        members = (
            (ids[i].as_py(), texts[i].as_py() or "")
            for batch in iterator
            for ids, texts in [(batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text")))]
            for i in range(len(batch))
        )
        found: list[tuple[str, int]] = []
        row = next(members, None)
        while row is not None:
            name, n = f"archive-{uuid.uuid4().hex}.zip", 0
            with files.open_output_stream(f"{root}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    while row is not None and archive.start_dir < self.archive_bytes:
                        archive.writestr(zipfile.ZipInfo(f"{row[0]}/{n}.png"), encode_image(row[1].encode()))
                        row, n = next(members, None), n + 1
            found.append((name, files.get_file_info(f"{root}/{name}").size))
        return Archives(found)

    def commit(self, messages: list[Archives | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        before = manifests(files, root) if self.overwrite else []
        name = f"{root}/{MANIFEST}{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{name}.new") as out:
            out.write(json.dumps([x for m in messages if m for x in m.found]).encode())
        files.move(f"{name}.new", name)
        for old in before:
            gone = read_manifest(files, old)
            files.delete_file(old)
            for archive, _ in gone:
                files.delete_file(f"{root}/{archive}")

    def abort(self, messages: list[Archives | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (x for m in messages if m for x in m.found):
            files.delete_file(f"{root}/{name}")


def manifests(files: fs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(root))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def read_manifest(files: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    with files.open_input_stream(path) as manifest:
        return [(name, size) for name, size in json.loads(manifest.read())]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)
        self.retries = int(options.get("retries") or RETRIES)

    def partitions(self) -> list[ByteRange]:
        files, root = fs.FileSystem.from_uri(self.path)
        return [
            ByteRange(name, begin, min(begin + self.range_bytes, size))
            for path in manifests(files, root)
            for name, size in read_manifest(files, path)
            for begin in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    @staticmethod
    def member(raw: bytes, info: zipfile.ZipInfo) -> bytes:
        """The stored bytes of a member from those at its offset."""
        if raw[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack("<HH", raw[26:30])
        media = raw[30 + name + extra : 30 + name + extra + info.compress_size]
        if len(media) != info.compress_size or zlib.crc32(media) != info.CRC:
            raise ValueError("the member is short or corrupt")
        return media

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = fs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.name}"
        with files.open_input_file(path) as source:
            # the directory's search steps back from the end, further than a tiny archive goes
            whole = io.BytesIO(source.read_at(source.size(), 0)) if source.size() < 1 << 16 else source
            with zipfile.ZipFile(whole) as archive:
                members = sorted(archive.infolist(), key=lambda m: m.header_offset)
                ends = [*(m.header_offset for m in members[1:]), archive.start_dir]
            mine = [(m, end) for m, end in zip(members, ends) if partition.begin <= m.header_offset < partition.end]
            if not mine:
                return
            first = mine[0][0].header_offset
            stream = source.read_at(mine[-1][1] - first, first)
        rows: list[tuple] = []
        size = 0
        for info, end in mine:
            raw = stream[info.header_offset - first : end - first]
            for attempt in range(self.retries + 1):
                try:
                    media = self.member(raw, info)
                    payload, length = decode_image(media)
                    error = None
                    break
                except (ValueError, zlib.error, struct.error, OSError) as e:
                    media, payload, length, error = None, None, None, str(e)[:200]
                    if attempt < self.retries:
                        raw = self.again(files, path, info.header_offset, end)
            owner = info.filename.split("/")[0]
            rows.append((None if owner == "None" else int(owner), partition.name, info.header_offset, media, payload, length, error))
            size += len(payload or b"")
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def again(files: fs.FileSystem, path: str, begin: int, end: int) -> bytes:
        try:
            with files.open_input_file(path) as source:
                return source.read_at(end - begin, begin)
        except OSError:
            return b""

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive")``, ``df.write.format("media_archive")``; rows doc_id, text are
    written, rows of ``SCHEMA`` are read."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite, dict(self.options))


def store(docs: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write the texts as images to the archive directory ``path``."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long"), "text").write.format("media_archive").options(**options).mode(mode).save(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


@F.pandas_udf(T.StringType())
def feature(payload: pd.Series) -> pd.Series:
    return payload.map(feature_of, na_action="ignore")


def digests(read: DataFrame) -> DataFrame:
    """The query's columns, of rows that ``load`` read; a member that could not be read is an error."""
    size = F.length("payload").cast("long")
    lost = F.raise_error(F.concat(F.lit("a member cannot be read: "), "archive", F.lit(" at "), "offset", F.lit(": "), "error"))
    return read.select(
        "doc_id",
        F.when(F.col("error").isNull(), F.col("n_bytes")).otherwise(lost.cast("long")).alias("n_bytes"),
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{ROW}, {ROW})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature("payload").alias("feature"),
    )


def op9_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    store(read_table(spark, sf_dir, "documents"), path)
    return digests(load(spark, path))


QUERIES = {"op9_media_archive": op9_media_archive}
