"""A stream of pending facts that admits rows, not files: at most so many a batch, first in first out, resumable.

The source is Spark's Python data source ``pending_facts`` over the parquet files of a fact table. Its offset is a place in
the queue: a file's time and name and the number of rows taken from it, files in the order of their times. A batch goes on from the last offset for ``rows`` rows, over as many files as these take.
The driver reads footers, and of the files of a batch the status column alone; tasks read the rows.

Batches are told by their offsets, so one that is run again has the same rows, and a query that starts from its checkpoint
goes on where it stopped and repeats none. Files may be added while the stream runs; one that changes or goes is an error,
and one put in place with an older time than what was taken is not seen (``MemoryStore.embed_pending`` takes what was left).
Facts that are not pending are passed over and do not count. An empty table is an empty stream.

The files lie where driver and executors can open them through ``pyarrow.fs`` (a shared folder, HDFS, an object store).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "fact_id long, content string"
ROWS = 8


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    local = path[5:] if path.startswith("file:") else path
    return (fs.LocalFileSystem(), "/" + local.lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[str]:
    """The parquet files of a table as their times and paths, in order."""
    files, root = opened(path)
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f"{x.mtime_ns:020d} {x.path}" for x in found if x.type == fs.FileType.File and x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", ".")))


class Part(InputPartition):
    """Rows from ``begin`` up to ``end`` of one file."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.last = options["path"], int(options.get("rows", ROWS)), None

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def _statuses(self, file: str) -> pa.ChunkedArray:
        files, _ = opened(self.path)
        return pq.read_table(file[21:], columns=["embed_status"], filesystem=files).column(0)

    def _onward(self, begin: dict, files: list[str]) -> Iterator[tuple[str, int, int]]:
        """(file, from, to) of what the batch after ``begin`` takes."""
        left = self.rows
        for file in files:
            if file < begin["file"]:
                continue
            first = begin["row"] if file == begin["file"] else 0
            pending = pc.indices_nonzero(pc.fill_null(pc.equal(self._statuses(file), "pending"), False)).to_numpy()
            pending = pending[pending >= first]
            if not len(pending):
                continue
            taken = min(left, len(pending))
            yield file, int(pending[0]), int(pending[taken - 1]) + 1
            left -= taken
            if not left:
                return

    def latestOffset(self) -> dict:
        """Where the next batch ends: after the last one that was asked for. Spark asks once a batch, and tells a query that
        starts from its checkpoint the offset that it had reached, by planning an empty batch there."""
        end = self.last or self.initialOffset()
        for file, _, to in self._onward(end, files_of(self.path)):
            end = {"file": file, "row": to}
        self.last = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last, out = self.last or end, []
        for file in files_of(self.path):
            if start["file"] <= file <= end["file"]:
                begin = start["row"] if file == start["file"] else 0
                out.append(Part(file, begin, end["row"] if file == end["file"] else -1))
        return [p for p in out if p.begin != p.end]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        place = 0
        for batch in pq.ParquetFile(partition.file[21:], filesystem=files).iter_batches(columns=["fact_id", "content", "embed_status"]):
            begin, end = max(partition.begin - place, 0), len(batch) if partition.end < 0 else min(partition.end - place, len(batch))
            place += len(batch)
            if begin < end:
                rows = batch.slice(begin, end - begin)
                rows = rows.filter(pc.fill_null(pc.equal(rows.column("embed_status"), "pending"), False))
                yield pa.RecordBatch.from_arrays([rows.column("fact_id"), rows.column("content")], names=["fact_id", "content"])

    def commit(self, end: dict) -> None:
        pass


class PendingFacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pending_facts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options)


def queued_facts(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The pending facts of a growing parquet table, ``rows`` a batch."""
    spark.dataSource.register(PendingFacts)
    return spark.readStream.format("pending_facts").option("rows", rows).load(path)
