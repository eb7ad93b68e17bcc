"""Best-fit packing of token sequences (large-item matching).

Documents become ids with an end id; only those longer than the capacity are cut, so that the first piece may
be shorter and all others are full. Pieces above a third of the capacity go at most two to a bin, matched
greedily (the longest with the longest partner that fits); shorter ones go, longest first, to the smallest
gap that holds them.

Packing looks at lengths alone, and there are at most ``capacity`` of them. So the plan is made on the driver
from a histogram of that bounded size, for whole classes of equal bins at once; its steps, classes and slots
are bounded by the number of lengths, not by that of documents. Pieces find their slot by their rank among
those of their length: a count within the tokenising task plus the counts of the tasks before it. Texts are
never shuffled, and no length, however common, meets in one task.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows and null ids are
packed like any other; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, read_table, utf8_of
from .pieces import PieceEncoder, code_point_offsets

CAPACITY = 1024
END_ID = 2
#: The tokenizer, for its added tokens, and the rank file of the same vocabulary and merges.
TOKENIZER, VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, nth long"


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file: strings that are one id wherever they stand in a text."""
    with open(path, "rb") as file:
        found = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take or need what is next to them are not supported")
    return {t["content"]: t["id"] for t in found}


def encode_with_added(
    encoder: PieceEncoder, added: dict[str, int], text: str, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``PieceEncoder.encode``, with one id for each added token; what stands between them is text of its own."""
    if not any(token in text for token in added):
        return encoder.encode(text, offsets)
    pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    spans = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in pattern.finditer(text, a, b)]
    cuts = np.unique(np.concatenate([offsets, np.array(spans, np.int64).reshape(-1)]))
    starts, ids, sizes = encoder.encode(text, cuts)
    ends, sizes, parts, at = np.append(0, np.cumsum(sizes)), sizes.copy(), [], 0
    for a, b in spans:
        i, j = np.searchsorted(starts, [a, b])
        parts += [ids[at : ends[i]], np.array([added[text[a:b]]], np.uint32)]
        at = ends[j]
        sizes[i:j] = 0
        sizes[i] = 1
    return starts, np.concatenate([*parts, ids[at:]]), sizes


def token_pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, added: dict[str, int] | None = None
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, the task it was made in (bucket) and its
    number among this task's pieces of its length (nth)."""
    if path is None:
        path, added = public_tokenizers.path(VOCABULARY), added_tokens(public_tokenizers.path(TOKENIZER))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, bucket = PieceEncoder(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            keys = batch.column(0)
            rows: list[tuple] = []
            for a, b in blocks(data, offsets):
                part = data[offsets[a] : offsets[b]]
                points = code_point_offsets(part, offsets[a : b + 1] - offsets[a])
                starts, ids, sizes = encode_with_added(encoder, added or {}, part.tobytes().decode(), points)
                ends = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(sizes, out=ends[1:])
                cuts = ends[np.searchsorted(starts, points)].tolist()
                for i in range(b - a):
                    own = np.append(ids[cuts[i] : cuts[i + 1]], np.uint32(end_id)).astype("<u4")
                    at = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for piece, (x, y) in enumerate(zip(at, at[1:])):
                        rows.append((a + i, piece, x, y - x, zlib.crc32(own[x:y].tobytes()), bucket, seen[y - x]))
                        seen[y - x] += 1
            out = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(out[0], pa.int64())), *(pa.array(x, k) for x, k in zip(out[1:], kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "nth"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Classes of equal bins (the lengths in a bin, how many bins) for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    open_bins: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, number]

    def opened(pattern: tuple[int, ...], number: int) -> None:
        if number:
            open_bins[capacity - sum(pattern)].append([pattern, number])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            opened((a,), left.pop(a))
            large.pop()
            continue
        b = large[k]
        number = left[a] // 2 if a == b else min(left[a], left[b])
        opened((a, b), number)
        for n in (a, b):
            left[n] -= number
        if a == b and left[a]:  # one is left over
            k = bisect.bisect_left(large, a) - 1
            if k >= 0:
                opened((a, large[k]), 1)
                left[large[k]] -= 1
            else:
                opened((a,), 1)
            left[a] = 0
        large = [n for n in large if left[n]]
    for n in sorted((n for n, c in left.items() if c and 3 * n <= capacity), reverse=True):
        gaps = sorted(g for g, bins in open_bins.items() if bins and g >= n)
        while left[n]:
            if not gaps:
                whole, rest = divmod(left[n], capacity // n)
                opened((n,) * (capacity // n), whole)
                opened((n,) * rest, rest and 1)
                break
            gap = gaps[0]
            bins = open_bins[gap]
            if not bins:
                gaps.pop(0)
                continue
            pattern, number = bins.pop()
            used = min(number, left[n])
            left[n] -= used
            if number > used:
                bins.append([pattern, number - used])
            opened((*pattern, n), used)
            if gap - n >= n and gap - n not in gaps:
                bisect.insort(gaps, gap - n)
    return [(pattern, number) for bins in open_bins.values() for pattern, number in bins]


def slot_table(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of a length from that rank on lie
    at that offset of that sequence and the ones after it."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, number in plan_bins(counts, capacity):
        offset = 0
        for n in pattern:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += number
            offset += n
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = materialize(token_pieces(docs, path, capacity, end_id), "pieces")
    by_task = pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = docs.sparkSession.sparkContext.broadcast(slot_table(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = slots.value
        keys = table[:, 0] << np.int64(48) | table[:, 1]
        row = np.searchsorted(keys, length.to_numpy() << np.int64(48) | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table[row, 2] + rank.to_numpy() - table[row, 1], "offset": table[row, 3]})

    return (
        pieces.join(base, ["bucket", "length"])
        .withColumn("slot", place("length", F.col("nth") + F.col("base")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
