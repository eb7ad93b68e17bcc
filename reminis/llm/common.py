"""What the operators share: tables, the shared folder, and texts as numpy arrays.

Texts reach Python in Arrow batches; ``utf8_of`` views a batch as one byte array with offsets and
``blocks`` cuts it into pieces of about a megabyte, so that the temporaries of a vectorised operator stay
small whatever the batch size. A single text is never cut: memory grows with the longest text.
"""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, as a qualified path. Where it is unset on
    one machine (as in tests) a temporary folder of this session; a cluster without one is an error, since its
    executors would each write to their own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reminis-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", files.makeQualified(path).toString()).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/reminis-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; nothing happens where it, or the session, is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session ended before its scratch files
        pass


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a written table of the shared folder, and its path, which ``remove`` takes once nothing reads it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table of the shared folder: its lineage is cut and lost executors lose nothing."""
    return written(df, tag)[0]


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


def held_out(column: str, divisor: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; a row without an id never is."""
    return F.coalesce(id_remainder(column, divisor) == remainder, F.lit(False))


def bounded_sample(df: DataFrame, by: str | list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones in every run: those with the smallest hashes of ``by``. No task passes on
    more than that."""
    by = [by] if isinstance(by, str) else by
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


def fit_in_task(rows: DataFrame, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """``fit`` of the texts and labels of a bounded sample (doc_id, text, label), run in one task: neither the
    driver's memory nor its time is spent on it, and a lost executor repeats it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))]
        found.sort(key=lambda x: (x[0], x[1] or ""))
        model = fit([x[1] or "" for x in found], np.array([x[2] for x in found], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([], np.zeros(0, np.int64))


# --- texts as arrays -------------------------------------------------------------------------------------


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes; a longer text has a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^breaks]+`` and the row of each; words end at a text's end."""
    inside = ~breaks[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0]
    after[ends - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def joined_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from ``starts`` to ``stops``, each row's joined by one space: bytes of all rows, offsets between them.
    ``row`` ascends."""
    lengths, many = stops - starts, np.bincount(row, minlength=rows)
    sizes = np.bincount(row, lengths, minlength=rows).astype(np.int64) + np.maximum(many - 1, 0)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    out = np.full(int(offsets[-1]), 0x20, np.uint8)
    before = np.cumsum(lengths) - lengths
    new = np.append(True, row[1:] != row[:-1])[: len(row)]
    at = before + np.arange(len(row)) - (np.cumsum(new) - 1)  # a space before each word but a row's first
    place = np.arange(int(lengths.sum()))
    out[np.repeat(at - before, lengths) + place] = data[np.repeat(starts - before, lengths) + place]
    return out, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
LONG = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, its end included, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies: the sum of its eight-byte chunks, each
    mixed with its place (a polynomial's collisions modulo 2 ** 64 would have a pattern), mixed with its length."""
    lengths = stops - starts
    chunks = chunks_of(data)
    out = mix64(chunks[starts] & _MASKS[np.minimum(lengths, 8)])
    more, k = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 1
    while len(more):
        left = lengths[more] - 8 * k
        out[more] += mix64((chunks[starts[more] + 8 * k] & _MASKS[np.minimum(left, 8)]) + np.array([k], np.uint64) * _STEP)
        more, k = more[left > 8], k + 1
    for i in np.flatnonzero(lengths > LONG).tolist():
        at = np.arange(starts[i], stops[i], 8)
        own = chunks[at] & _MASKS[np.minimum(stops[i] - at, 8)]
        out[i] = mix64(own + np.arange(len(at), dtype=np.uint64) * _STEP).sum()
    return mix64(out + lengths.astype(np.uint64) * _STEP)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of ``a`` and ``b`` (both as ``chunks_of`` gives them) of equal lengths hold the same bytes."""
    out = np.ones(len(lengths), bool)
    left, k = np.flatnonzero(lengths > 0), 0
    while len(left):
        mask = _MASKS[np.minimum(lengths[left] - k, 8)]
        out[left] &= (a[a_starts[left] + k] ^ b[b_starts[left] + k]) & mask == 0
        k += 8
        left = left[(lengths[left] > k) & out[left]]
    return out


class HashTable:
    """Open addressing over 64-bit keys with vectorised look-up; values are positions of insertion."""

    def __init__(self, bits: int = 12):
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.bits, self.n = bits, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = None
        while True:
            slot = self.slots[at]
            same = self.keys[at] == (keys if todo is None else keys[todo])
            hit = same & (slot >= 0)
            if todo is None:
                out[hit] = slot[hit]
                todo = np.flatnonzero((slot >= 0) & ~same)
                at = at[todo]
            else:
                out[todo[hit]] = slot[hit]
                more = (slot >= 0) & ~same
                todo, at = todo[more], at[more]
            if not len(todo):
                return out
            at = (at + 1) & mask

    def insert(self, keys: np.ndarray) -> None:
        """Add distinct new keys; they get the positions n, n+1, ..."""
        while (self.n + len(keys)) * 10 > len(self.keys) * 7:
            old, slots = self.keys, self.slots
            self.bits += 1
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            full = slots >= 0
            self._place(old[full], slots[full])
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, slots: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = slots[free]  # of several at one slot the last stays
            self.keys[at[free]] = keys[free]
            left = self.slots[at] != slots
            keys, slots, at = keys[left], slots[left], (at[left] + 1) & mask
