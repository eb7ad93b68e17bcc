"""Language-model scores from a log-frequency Bloom filter of words, pairs and triples.

Units. ``units_of`` deals the documents into units of about ``UNIT_BYTES`` of text, in one shuffle. A unit's tokens,
pairs and triples are hashed with numpy; its distinct ones go, sorted and with their training counts, to the ranges of
their hashes. There is a range for every ``RANGE_BYTES`` of text, so a range's work has a fixed size at any input.

The filter. A range adds up the exact counts, gives each n-gram a level and enters it into its own block of the filter
once for every level up to that. Levels are the counts themselves up to ``EXACT``, then powers of ``BASE``; a count is
known to one per cent by its level. A reader probes level after level until one is missing. All n-grams enter, those
seen once at level 1. Probes and bits of an n-gram grow with the logarithm of the vocabulary, so that a context has
``STRAY`` expected false successors at most, whatever the size of the vocabulary.

A filter of all n-grams grows with the corpus, and so cannot be broadcast within a proven bound. Its blocks are probed
where they lie, by the n-grams that the units sent there; the levels go back to the units. ``model_of`` gives the
same filter as one object, for a corpus whose filter is under a stated size (an error otherwise): ``score_with``
broadcasts it and scores any documents, with the same scores.

The model (u v are the two tokens before w, q a probed count, c an exact one; BEGIN stands before a text):

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | v) = (q(v w) + MU_PAIR p(w)) / (c(v) + MU_PAIR)
    p(w | u v) = (q(u v w) + MU_TRIPLE p(w | v)) / (q(u v) + MU_TRIPLE)

Sums over the vocabulary are 1 but for the levels' rounding and false successors (a test holds them to 0.01). ``score``
is the sum of log10 p(w | u v) over a text's tokens; the base score uses p(w) alone, and is exact.

Defined cases: a null or empty text is its end token alone; repeated rows are scored and counted as often as they
stand; a null id is in no held-out fold; without training texts p is 1 and every score zero; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` are not read. Words are known by 64-bit hashes, pairs and triples by 48
bits within a range. A text is never cut: a unit is as large as its longest text.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, LOWER, blocks, byte_hashes, held_out, materialize, mix64, read_table, utf8_of, words_of

EXACT, BASE = 50, 1.02
MU_PAIR, MU_TRIPLE = 20.0, 5.0
STRAY = 2.0**-10
FILL = 0.25  # share of a block's bits that are set
RANGE_BYTES = 8 << 20
UNIT_BYTES = 8 << 20
FILTER_BYTES = 256 << 20
BEGIN, END = np.uint64(0x9216D5D98979FB1B), np.uint64(0xD1310BA698DFB5AC)


# --- n-grams -----------------------------------------------------------------------------------------------


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; it rises with the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and end, in order, and the row of each."""
    data = LOWER[data]
    starts, stops, row = words_of(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    out = np.full(len(row) + rows, END, np.uint64)
    out[np.arange(len(row)) + row] = byte_hashes(data, starts, stops)
    return out, np.repeat(np.arange(rows), n + 1)


def tokens_of_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``tokens_of`` by blocks, so that temporaries stay small."""
    data, offsets = utf8_of(column)
    found = [(tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a) for a, b in blocks(data, offsets)]
    none = (np.zeros(0, np.uint64),), (np.zeros(0, np.int64),)
    return np.concatenate([x for (x, _), _ in found] or none[0]), np.concatenate([row + a for (_, row), a in found] or none[1])


def before(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each one; ``BEGIN`` before a text's first."""
    out = np.empty_like(tokens)
    out[:1] = BEGIN
    out[1:] = np.where(row[1:] == row[:-1], tokens[:-1], BEGIN)
    return out


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its first part and its last token's."""
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def ngrams(tokens: np.ndarray, row: np.ndarray) -> dict[int, np.ndarray]:
    """For each token the hashes of itself, of the pair and of the triple that end with it."""
    previous = before(tokens, row)
    pairs = joined(previous, tokens)
    # the pair that ends with the token before: at a text's first token that of BEGIN alone
    context = np.where(row == np.append(-1, row[:-1]), np.append(BEGIN, pairs[:-1]), BEGIN)
    return {1: tokens, 2: pairs, 3: joined(context ^ np.uint64(0x5851F42D4C957F2D), tokens)}


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, and differences. Their low four bytes are noise; what is above is compressed."""
    steps = np.diff(keys).astype("<u8").view("<u4").reshape(-1, 2)
    high = pa.compress(np.ascontiguousarray(np.ascontiguousarray(steps[:, 1]).view(np.uint8).reshape(-1, 4).T).tobytes() if len(steps) else b"", codec="zstd", asbytes=True)
    return keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps[:, 0]).tobytes() + high + struct.pack("<II", len(steps), len(high))


def unpacked(raw: bytes) -> np.ndarray:
    n, size = struct.unpack("<II", raw[-8:])
    steps = np.zeros((n + 1, 2), "<u4")
    steps[0] = np.frombuffer(raw, "<u4", 2)
    steps[1:, 0] = np.frombuffer(raw, "<u4", n, 8)
    if n:
        high = pa.decompress(raw[-8 - size : -8], decompressed_size=4 * n, codec="zstd", asbytes=True)
        steps[1:, 1] = np.ascontiguousarray(np.frombuffer(high, np.uint8).reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def shrunk(array: np.ndarray) -> bytes:
    return pa.compress(array.tobytes(), codec="zstd", asbytes=True)


def grown(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def sorted_distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse. Hashes are dealt into buckets of their upper bits, and sorted there with
    their place in the lowest bits."""
    n = len(hashes)
    bits = np.uint64(max(1, n - 1).bit_length())
    if n < 1 << 12 or bits > 22:
        return np.unique(hashes, return_inverse=True)
    low = hashes.min()
    up = np.uint64(64 - int(hashes.max() - low).bit_length())
    spread = (hashes - low) << up
    bucket = (spread >> np.uint64(52)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    spread = (((spread << np.uint64(12)) >> bits) << bits)[order] | order.astype(np.uint64)
    begin = 0
    for end in np.cumsum(np.bincount(bucket, minlength=4096)).tolist():
        spread[begin:end].sort()
        begin = end
    order = (spread & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    arranged = hashes[order]
    if (arranged[1:] < arranged[:-1]).any():  # two differ in their lowest bits alone
        return np.unique(hashes, return_inverse=True)
    first = np.append(True, arranged[1:] != arranged[:-1])
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(first) - 1
    return arranged[first], at


def keys_of(kind: int, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """What stands for an n-gram within its range: words keep their hash, others lose the lowest bits of it, so that
    48 tell the n-grams of a range apart. The order stays."""
    return hashes if kind == 1 else hashes >> np.uint64(max(0, 16 - (ranges - 1).bit_length()))


# --- the filter --------------------------------------------------------------------------------------------


def level_of(counts: np.ndarray) -> np.ndarray:
    counts = np.asarray(counts, np.float64)
    above = EXACT + np.floor(np.log(np.maximum(counts, EXACT) / EXACT) / log(BASE) + 1e-9)
    return np.where(counts <= EXACT, counts, above).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts."""
    level = np.asarray(levels, np.float64)
    step = np.maximum(level - EXACT, 0)
    return np.where(level <= EXACT, level, EXACT * np.sqrt(np.ceil(EXACT * BASE**step) / EXACT * BASE ** (step + 1)))


class Shape:
    """How many probes an n-gram has and how many bits it is given, from a bound on the number of words."""

    def __init__(self, words: int):
        self.probes = max(1, ceil((log2(max(2, words)) - log2(STRAY)) / -log2(FILL)))
        self.bits = self.probes / -log(1 - FILL)

    def size(self, entered: int) -> int:
        return 64 * (1 + int(entered * self.bits) // 64)


class Block:
    """The filter's bits of one range: built from levels, read by repeated probes."""

    def __init__(self, shape: Shape, bits: np.ndarray, size: int):
        self.shape, self.bits, self.size = shape, bits, size

    @staticmethod
    def _start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        own = mix64(keys + np.array([level], np.uint64) * np.uint64(0xA24BAED4963EE407))
        return own, (own << np.uint64(32) | own >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def _next(own: np.ndarray, step: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        own = own * np.uint64(0xD6E8FEB86659FD93) + step
        return own, ((own >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, shape: Shape, keys: np.ndarray, levels: np.ndarray) -> Block:
        size = shape.size(int(levels.sum()))
        bits, level = np.zeros(size, bool), 1
        while len(keys):
            own, step = cls._start(keys, level)
            for _ in range(shape.probes):
                own, at = cls._next(own, step, size)
                bits[at] = True
            level += 1
            more = levels >= level
            keys, levels = keys[more], levels[more]
        return cls(shape, np.packbits(bits, bitorder="little"), size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram: the last one of which no probe is missing."""
        out, level, alive = np.zeros(len(keys), np.int64), 1, np.arange(len(keys))
        while len(alive):
            own, step = self._start(keys[alive], level)
            for _ in range(self.shape.probes):
                own, at = self._next(own, step, self.size)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    own, step, alive = own[hit], step[hit], alive[hit]
            out[alive] = level
            level += 1
        return out


# --- counting and probing ----------------------------------------------------------------------------------


def units_of(docs: DataFrame, parts: int) -> DataFrame:
    """unit, rows: about ``UNIT_BYTES`` of texts that one task reads one after another, as a compressed table of
    doc_id, text, train."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, size, held = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            out = io.BytesIO()
            with ipc.new_stream(out, held[0].schema, options=ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in held:
                    stream.write_batch(part)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["unit", "rows"])

        for batch in batches:
            _, offsets = utf8_of(batch.column(1))
            for a, b in blocks(offsets[-1:], offsets, UNIT_BYTES // 4):
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size >= UNIT_BYTES:
                    yield row()
                    unit, size = unit + 1, 0
        if held:
            yield row()

    return docs.mapInArrow(deal, "unit long, rows binary").repartition(parts, "unit")


def opened(raw: bytes) -> pa.Table:
    with ipc.open_stream(raw) as stream:
        return stream.read_all()


def distinct_of(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The distinct n-grams in order, where each token's stands among them, and (range, from, to) of each range."""
    found, at = sorted_distinct(hashes)
    part = range_of(found, ranges)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    return found, at, list(zip(part[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def counted(units: DataFrame, ranges: int) -> DataFrame:
    """unit, kind, r, n, keys, counts: the distinct n-grams of each unit by range, with their training counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, raw in ((u, r) for batch in batches for u, r in zip(batch.column(0).to_pylist(), batch.column(1))):
            rows = opened(raw.as_buffer())
            tokens, row = tokens_of_texts(rows.column("text"))
            train = rows.column("train").combine_chunks().to_numpy(zero_copy_only=False)[row]
            for kind, hashes in ngrams(tokens, row).items():
                found, at, spans = distinct_of(hashes, ranges)
                counts = np.bincount(at[train], minlength=len(found)).astype("<u4")
                del hashes, at
                keys = keys_of(kind, found, ranges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(spans), unit)), pa.array(np.full(len(spans), kind, np.int32)), pa.array([r for r, _, _ in spans], pa.int32()),
                        pa.array([b - a for _, a, b in spans], pa.int32()), pa.array([packed(keys[a:b]) for _, a, b in spans], pa.binary()),
                        pa.array([shrunk(counts[a:b]) for _, a, b in spans], pa.binary()),
                    ],
                    names=["unit", "kind", "r", "n", "keys", "counts"],
                )

    return units.mapInArrow(count, "unit long, kind int, r int, n int, keys binary, counts binary")


def added_up(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's rows: the sizes of each, the distinct keys, where each key stands among them, and their counts."""
    sizes = table.column("n").to_pylist()
    found, at = sorted_distinct(np.concatenate([unpacked(x) for x in table.column("keys").to_pylist()]))
    counts = np.concatenate([grown(x, "<u4", n) for x, n in zip(table.column("counts").to_pylist(), sizes)])
    return sizes, found, at, np.bincount(at, counts, minlength=len(found)).astype(np.int64)


def totals_of(rows: DataFrame, ranges: int) -> tuple[int, int]:
    """N and V: training tokens, and the distinct ones."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8_of(batch.column(0))
            for a, b in blocks(offsets[-1:], offsets, UNIT_BYTES):
                tokens = tokens_of_texts(batch.column(0).slice(a, b - a))[0]
                found, _, spans = distinct_of(tokens, few)
                totals = [len(tokens), *[0] * (len(spans) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in spans], pa.int32()), pa.array(totals, pa.int64()), pa.array([packed(found[x:y]) for _, x, y in spans], pa.binary())],
                    names=["r", "total", "keys"],
                )

    def add(table: pa.Table) -> pa.Table:
        types = len(sorted_distinct(np.concatenate([unpacked(x) for x in table.column("keys").to_pylist()]))[0])
        return pa.table({"total": pa.array([sum(table.column("total").to_pylist())], pa.int64()), "types": pa.array([types], pa.int64())})

    few = max(1, ranges // 4)  # words are fewer than pairs
    parts = rows.where("train").select("text").mapInArrow(words, "r int, total long, keys binary")
    total, types = parts.groupBy("r").applyInArrow(add, "total long, types long").agg(F.sum("total"), F.sum("types")).first()
    return total or 0, types or 0


def answers(keyed: DataFrame, shape: Shape) -> DataFrame:
    """unit, kind, r, found: for the n-grams that a unit sent to a range, in their order, the exact counts of words
    and the levels of pairs and triples, by probing the range's block of the filter."""

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        sizes, found, at, counts = added_up(table)
        if kind == 1:
            out = counts[at]
        else:
            seen = counts > 0
            out = Block.build(shape, found[seen], level_of(counts[seen])).levels(found)[at]
        ends = np.cumsum([0, *sizes]).tolist()
        return pa.table({
            "unit": table.column("unit"), "kind": table.column("kind"), "r": table.column("r"), "n": table.column("n"),
            "found": pa.array([shrunk(out[a:b].astype("<i8" if kind == 1 else "<u2")) for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    return keyed.groupBy("kind", "r").applyInArrow(answer, "unit long, kind int, r int, n int, found binary")


# --- scores ------------------------------------------------------------------------------------------------


def likelihoods(
    tokens: np.ndarray, row: np.ndarray, rows: int, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, texts: float, total: int, types: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, base score and score of each text, from every token's exact count and probed counts
    of the pair and triple that end with it. ``texts`` is the count of END, which is that of training texts."""
    first = np.append(-1, row[:-1]) != row
    single = (words + 1) / (total + types + 1)
    own = np.where(first, texts, np.append(0.0, words[:-1]))  # of the token before, as a context
    pair = (pairs + MU_PAIR * single) / (own + MU_PAIR)
    context = np.where(first, texts, np.append(0.0, pairs[:-1]))
    triple = (triples + MU_TRIPLE * pair) / (context + MU_TRIPLE)
    n = np.bincount(row, minlength=rows)
    return n, np.bincount(row, words > 0, minlength=rows).astype(np.int64), np.bincount(row, np.log10(single), minlength=rows), np.bincount(row, np.log10(triple), minlength=rows)


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(ids: pa.Array, tokens: np.ndarray, row: np.ndarray, counts: dict[int, np.ndarray], texts: float, total: int, types: int) -> pa.RecordBatch:
    n, known, base, score = likelihoods(tokens, row, len(ids), counts[1], counts[2], counts[3], texts, total, types)
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(x) for x in (n, known)), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(score)],
        names=[x.split()[0] for x in SCORED.split(", ")],
    )


def with_train(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))


def sizes_of(rows: DataFrame) -> tuple[int, int, int]:
    """A range for every ``RANGE_BYTES`` of text, a partition for every half unit (so that few share one), and the
    number of training texts."""
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * ceil((size or 0) / UNIT_BYTES))
    return max(1, ceil((size or 0) / RANGE_BYTES)), parts, texts


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; the model is that of the
    rows where ``train`` holds."""
    rows = with_train(docs, train)
    ranges, parts, texts = sizes_of(rows)
    total, types = totals_of(rows, ranges)
    units, shape = units_of(rows, parts), Shape(types)

    def finish(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        rows = opened(own.column("rows")[0].as_buffer())
        tokens, row = tokens_of_texts(rows.column("text"))
        order = np.lexsort((found.column("r").to_numpy(), found.column("kind").to_numpy())).tolist()
        kinds, sizes, raw = (found.column(c).to_pylist() for c in ("kind", "n", "found"))
        counts = {}
        for kind, hashes in ngrams(tokens, row).items():
            distinct, at = sorted_distinct(hashes)
            answered = np.concatenate([grown(raw[i], "<i8" if kind == 1 else "<u2", sizes[i]) for i in order if kinds[i] == kind])
            if len(distinct) != len(answered):
                raise ValueError("the answers are not those of this unit's n-grams")
            counts[kind] = (answered.astype(np.float64) if kind == 1 else count_of(answered))[at]
        return pa.Table.from_batches([_scored(rows.column("doc_id").combine_chunks(), tokens, row, counts, texts, total, types)])

    back = answers(counted(units, ranges), shape)
    return units.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(finish, SCORED)


class Model:
    """A whole filter as one object, for corpora whose filter is small enough to be broadcast."""

    def __init__(self, ranges: int, texts: int, total: int, types: int, shape: Shape):
        self.ranges, self.texts, self.total, self.types, self.shape = ranges, texts, total, types, shape
        self.words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks: dict[tuple[int, int], Block] = {}

    def counts(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        found, at, spans = distinct_of(hashes, self.ranges)
        out = np.zeros(len(found))
        for r, a, b in spans:
            if kind == 1 and r in self.words:
                keys, counts = self.words[r]
                place = np.minimum(np.searchsorted(keys, found[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[place] == found[a:b], counts[place], 0)
            elif (kind, r) in self.blocks:
                out[a:b] = count_of(self.blocks[kind, r].levels(keys_of(kind, found[a:b], self.ranges)))
        return out[at]


def model_of(docs: DataFrame, train: Column, max_bytes: int = FILTER_BYTES) -> Model:
    """The model of the rows where ``train`` holds, on the driver; an error where its filter has over ``max_bytes``
    (``score`` has no such bound)."""
    rows = with_train(docs, train).where("train")
    ranges, parts, texts = sizes_of(rows)
    total, types = totals_of(rows, ranges)
    model = Model(ranges, texts, total, types, Shape(types))
    shape = model.shape

    def build(table: pa.Table) -> pa.Table:
        kind, r = table.column("kind")[0].as_py(), table.column("r")[0].as_py()
        _, found, _, counts = added_up(table)
        block = Block.build(shape, found, level_of(counts)) if kind > 1 else None
        return pa.table({
            "kind": pa.array([kind], pa.int32()), "r": pa.array([r], pa.int32()), "size": pa.array([block.size if block else 0], pa.int64()),
            "bits": pa.array([block.bits.tobytes() if block else found.tobytes()], pa.binary()), "counts": pa.array([b"" if block else counts.tobytes()], pa.binary()),
        })

    made = counted(units_of(rows, parts), ranges).groupBy("kind", "r").applyInArrow(build, "kind int, r int, size long, bits binary, counts binary")
    made = materialize(made, "filter")
    size = made.agg(F.sum(F.length("bits") + F.length("counts"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the filter has {size} bytes, more than the {max_bytes} that may be broadcast")
    for x in made.toLocalIterator():
        if x.kind == 1:
            model.words[x.r] = np.frombuffer(x.bits, "<u8"), np.frombuffer(x.counts, "<i8")
        else:
            model.blocks[x.kind, x.r] = Block(shape, np.frombuffer(x.bits, np.uint8), x.size)
    return model


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``score`` by a broadcast model; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in blocks(data, offsets):
                tokens, row = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = {kind: own.counts(kind, hashes) for kind, hashes in ngrams(tokens, row).items()}
                yield _scored(batch.column(0).slice(a, b - a), tokens, row, counts, own.texts, own.total, own.types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def op3_ngram_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, ~held_out("doc_id", 7, 2)).withColumn("held_out", held_out("doc_id", 7, 2))


QUERIES = {"op3_ngram_bloom": op3_ngram_bloom}
