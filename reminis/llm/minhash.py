"""MinHash fingerprints, their likeness, and near-duplicates by signature bands.

A text is the set of its shingles of ``WORDS`` words (A-Z lower-cased). ``PERMUTATIONS`` functions
``a x + b`` modulo 2**64 (``a`` odd) permute the shingles' hashes; a signature holds each one's minimum, a
fingerprint one byte of each minimum. The likeness of two fingerprints is the share of equal bytes, less what
equal bytes of different minima would make by chance.

``near_duplicates`` joins signature bands in Spark and verifies the Jaccard similarity of the shingle sets.
Texts with the same set are one candidate; the others follow by membership, so copies are never paired.

Neighbours by id: ``with_next`` deals documents into bins of consecutive ids. The first document of each bin
also goes to the bin before it, so that every document meets its successor without a global sort of texts.

Defined cases: a null or empty text, or one without words, has a fingerprint of its own that all such texts
share; fewer words than a shingle make one shingle of all of them; repeated rows are each other's successors
(ordered by id, then text; a null id comes first); a single row is its own successor; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, byte_hashes, materialize, mix64, read_table, utf8_of, words_of

WORDS = 5
PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 0.8
BIN = 1024
_LOWEST = -(1 << 63)

_random = np.random.default_rng(20240501)
_A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and where each text's begin; every text has at least one."""
    data = LOWER[data]
    starts, stops, row = words_of(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    hashes = byte_hashes(data, starts, stops)
    count = np.maximum(n - words + 1, 1)
    begin = np.cumsum(count) - count
    word = np.repeat(np.cumsum(n) - n - begin, count) + np.arange(int(count.sum()))
    size = np.minimum(words, np.repeat(n, count))
    out = size.astype(np.uint64)
    for k in range(words):
        there = np.flatnonzero(size > k)
        out[there] = out[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[word[there] + k]
    return mix64(out), begin


def signatures_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima under all permutations: texts x PERMUTATIONS."""
    x, begin = shingles(data, offsets)
    out = np.empty((len(offsets) - 1, PERMUTATIONS), np.uint64)
    value = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _A[k], out=value)
        value += _B[k]
        out[:, k] = np.minimum.reduceat(value, begin)
    return out


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """One byte of each minimum: texts x PERMUTATIONS."""
    data, offsets = utf8_of(pa.array(texts, pa.large_string()))
    found = [signatures_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(data, offsets)]
    return mix64(np.concatenate(found)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row."""
    equal = (a == b).mean(axis=-1)
    return np.maximum(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) of every text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [x.tobytes().hex() for x in fingerprints_of(texts)] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(compute, docs.select("doc_id").schema.add("fingerprint", "string"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, rep) of every row, and the pairs (a, b, jaccard), a < b, of representatives whose
    shingle sets are at least so similar. A representative is the smallest id with its set; a set that only rows without
    an id have gets none (``rep`` is null) and is in no pair, as no id could name it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in blocks(data, offsets):
                part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                x, begin = shingles(part, ends)
                own = [np.unique(s).view(np.int64) for s in np.split(x, begin[1:])]
                bands = mix64(signatures_of(part, ends)).reshape(b - a, BANDS, -1)
                keys = np.zeros((b - a, BANDS), np.uint64)
                for k in range(bands.shape[2]):
                    keys = mix64(keys * np.uint64(31) + bands[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in own]),
                        pa.array([s.tolist() for s in own], pa.list_(pa.int64())), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "digest", "shingles", "bands"],
                )

    longs = T.ArrayType(T.LongType())
    schema = docs.select("doc_id").schema.add("digest", "string").add("shingles", longs).add("bands", longs)
    rows = materialize(docs.select("doc_id", "text").mapInArrow(sets, schema), "sets")
    reps = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")), "representatives")
    one = rows.join(reps, (rows.digest == reps.digest) & (rows.doc_id == reps.rep)).select("rep", "shingles", "bands").dropDuplicates(["rep"])
    banded = one.select("rep", F.posexplode("bands").alias("band", "key"))
    other = banded.select(F.col("rep").alias("b"), "band", "key")
    pairs = banded.withColumnRenamed("rep", "a").join(other, ["band", "key"]).where("a < b").select("a", "b").distinct()
    left, right = one.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), one.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    jaccard = (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")
    found = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard).where(F.col("jaccard") >= similarity)
    return rows.join(reps, "digest").select("doc_id", "rep"), found


def with_next(docs: DataFrame, size: int = BIN) -> DataFrame:
    """bin, tail, doc_id, text: sorted within partitions, each bin whole in one of them. Of a bin, the row after
    a document (a tail row after the last) is its successor; the successor of the last document is the first."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(_LOWEST)).cast("long")
    ids = docs.select(key.alias("id"))
    bins = max(1, -(-ids.count() // size))
    firsts = ids.repartitionByRange(bins, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).collect()
    starts = spark.sparkContext.broadcast(np.unique(np.array([r.id for r in firsts], np.int64)))

    @F.pandas_udf("bin int, first boolean")
    def bin_of(ids: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts.value, ids.to_numpy(), "right") - 1
        return pd.DataFrame({"bin": at.astype(np.int32), "first": starts.value[at] == ids.to_numpy()})

    n = len(starts.value)
    own = F.struct(F.col("at.bin").alias("bin"), F.lit(0).alias("tail"))
    earlier = F.struct(F.pmod(F.col("at.bin") - 1, F.lit(max(1, n))).cast("int").alias("bin"), F.lit(1).alias("tail"))
    dealt = docs.select("doc_id", "text", key.alias("id")).withColumn("at", bin_of("id"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("at.first"), F.array(own, earlier)).otherwise(F.array(own))))
    dealt = dealt.select("to.bin", "to.tail", "id", "doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bin").sortWithinPartitions("bin", "tail", "id", "text").select("bin", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited form, and their likeness to each other and to the next
    document's."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            """All held rows but the last, which waits for its successor."""
            mine = [i for i in range(len(held) - 1) if held[i][1] == 0 and held[i + 1][0] == held[i][0]]
            if mine:
                texts = [x[3] for x in held]
                changed = [edited(texts[i], texts[i + 1]) for i in mine]
                prints, after = fingerprints_of(texts), fingerprints_of(changed)
                at = np.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[i][2] for i in mine], pa.int64()), pa.array([len(texts[i]) for i in mine], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array([prints[i].tobytes().hex() for i in mine]),
                        pa.array([x.tobytes().hex() for x in after]), pa.array(likeness(prints[at], after)), pa.array(likeness(prints[at], prints[at + 1])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            del held[: -1 if not last else None]

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for a in range(0, len(batch), 1024):
                part = [c.slice(a, 1024).to_pylist() for c in columns]
                held.extend((p, t, i, x or "") for p, t, i, x in zip(*part))
                yield from rows(False)
        yield from rows(True)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(compute, schema)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash": op4_minhash}
