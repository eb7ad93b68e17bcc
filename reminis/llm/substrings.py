"""Substring dedup: words that repeated windows of fixed length cover are removed.

A window is ``WINDOW`` consecutive words of one document. Every window is hashed by rolling polynomials over 64-bit word
hashes (Rabin-Karp: a window's value is the difference of two prefix values, whatever its length). A window whose words
also start earlier, in a document of smaller id or further ahead in the same one, marks its words; overlapping and
touching marks merge into maximal intervals, which are removed. Windows are judged on the input, so of each passage the
first occurrence stays, and what is left may hold new repeats.

Documents are dealt into units of about ``UNIT_BYTES`` of text that follow each other in the order of ids, so the first of
two windows is the one in the earlier unit. A unit sends each of its distinct windows once, sorted and packed, to a range
of hashes; the range counts the units that have it, and answers each unit with one bit a window: whether an earlier unit
has it. Texts are shuffled once, compressed. A window that all documents share costs one entry a unit; a range's and a
unit's work have fixed sizes at any input, as there are as many as there are ``UNIT_BYTES`` of text. A row holds what one
unit sends to one range; at very large inputs that is a single window.

Windows are compared by 64 bits of one polynomial within a range, which another one chooses: n windows in r ranges have an
expected n * n / (r * 2 ** 65) false matches, 0.005 at 30 GB.

Defined cases: a null or empty text has no words and keeps an empty text; a text shorter than a window loses nothing; a
null id comes before all others; rows of one id are separate documents, in the order of their texts within a unit (those of
an id that fills several units are dealt among these), and of equal rows all but one lose their windows; an empty table
gives no rows; columns besides ``doc_id`` and ``text`` are not read. A text is never cut: a unit is as large as its
longest text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_hashes, joined_words, mix64, read_table, utf8_of, words_of
from .ngram_bloom import opened, packed, range_of, unpacked

WINDOW = 20
UNIT_BYTES = 12 << 20
#: Texts that a task holds before it sends them to their units.
HELD_BYTES = 32 << 20
#: Odd bases of the two polynomials.
BASES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35))


# --- windows ---------------------------------------------------------------------------------------------


def window_values(words: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    """The polynomial of each ``size`` consecutive word hashes, modulo 2 ** 64: differences of prefix values, divided by
    the power of the (odd) base at which they start."""
    n, many = len(words), max(0, len(words) - size + 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base)))
    prefix = np.append(np.uint64(0), np.cumsum(words * up[:n]))
    down = np.cumprod(np.append(np.uint64(1), np.full(max(many - 1, 0), inverse)))
    return (prefix[size:][:many] - prefix[:many]) * down[:many]


def windows_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, size: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within one row: its first word, its range, and its key."""
    at = np.arange(max(0, len(starts) - size + 1))
    at = at[row[at] == row[at + size - 1]]
    if not len(at):
        return at, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = byte_hashes(data, starts, stops)
    key, deal = (mix64(window_values(words, base, size)[at]) for base in BASES)
    return at, range_of(deal, ranges).astype(np.int64), key


class Unit:
    """The windows of a unit's texts, and its distinct ones by range and key."""

    def __init__(self, rows: pa.Table, size: int, ranges: int):
        self.data, self.offsets = utf8_of(rows.column("text"))
        pieces, self.words = [], []
        for a, b in blocks(self.data, self.offsets):
            part, cuts = self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            starts, stops, row = words_of(part, cuts)
            at, deal, key = windows_of(part, starts, stops, row, size, ranges)
            pieces.append((at + sum(len(w[0]) for w in self.words), deal, key))
            self.words.append((starts + self.offsets[a], stops + self.offsets[a], row + a))
        self.at, self.range, self.key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (*zip(*pieces),) or ((),) * 3)
        self.order = np.lexsort((self.key, self.range))  # stable: of equal windows the first comes first
        key, deal = self.key[self.order], self.range[self.order]
        self.new = np.append(True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1]))[: len(key)]

    def sent(self) -> Iterator[tuple[int, np.ndarray]]:
        """(range, sorted distinct keys)."""
        key, deal = self.key[self.order][self.new], self.range[self.order][self.new]
        cuts = np.append(np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))[: len(deal)], len(deal))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(deal[x]), key[x:y]

    def later(self, known: np.ndarray) -> np.ndarray:
        """Whether each window also starts earlier; ``known`` says so of the distinct ones, as to earlier units."""
        out = np.ones(len(self.order), bool)
        out[self.order[self.new]] = known
        return out


def covered(later: np.ndarray, at: np.ndarray, words: int, size: int) -> np.ndarray:
    """Whether each word lies in a window that starts at ``at`` where ``later`` holds."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, at[later], 1)
    np.add.at(steps, at[later] + size, -1)
    return np.cumsum(steps[:words]) > 0


# --- units -----------------------------------------------------------------------------------------------


def bounds_of(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Ids at which units begin, by quantiles of the ids (null ids come first), and the number of units."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    units = max(1, ceil((size or 0) / UNIT_BYTES))
    if units == 1 or not rows:
        return np.zeros(0, np.int64), 1
    shares = [k / units for k in range(1, units)]
    found = docs.select(F.col("doc_id").cast("long").alias("id")).agg(F.percentile_approx("id", shares, 100 * units)).first()[0]
    return np.array(found or [], np.int64), units


def units_of(docs: DataFrame, bounds: np.ndarray, units: int, parts: int) -> DataFrame:
    """unit, rows: compressed tables (doc_id, text, salt) of some of a unit's documents. Ids that fill several units are
    dealt among these."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0

        def send() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            ids = rows.column("doc_id").combine_chunks()
            known = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(bounds, known, side) for side in ("left", "right"))
            low[ids.is_null().to_numpy(zero_copy_only=False)] = high[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            # an id between two bounds has one unit; one that is itself several bounds has all from the first of these on
            salt = rows.column("salt").to_numpy()
            unit = np.where(high - low > 1, low + 1 + salt % np.maximum(high - low, 1), high)
            order = np.argsort(unit, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, unit[order][1:] != unit[order][:-1])), len(unit))
            raw = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out, part = io.BytesIO(), rows.take(pa.array(order[x:y]))
                with ipc.new_stream(out, part.schema, options=ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(part)
                raw.append(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(unit[order[cuts[:-1]]], pa.int64()), pa.array(raw, pa.binary())], names=["unit", "rows"])

        for batch in batches:
            _, offsets = utf8_of(batch.column(1))
            salts = pa.array(np.arange(seen, seen + len(batch)))
            seen += len(batch)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string()), salts], names=["doc_id", "text", "salt"])
            for a, b in blocks(offsets[-1:], offsets, HELD_BYTES):
                held.append(rows.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size >= HELD_BYTES:
                    yield send()
                    size = 0
        if held and sum(map(len, held)):
            yield send()

    return docs.select("doc_id", "text").mapInArrow(deal, "unit long, rows binary").repartition(parts, "unit")


def whole(parts: pa.Table) -> pa.Table:
    """A unit's documents in their order: ids (null first), then texts, whatever order the parts came in."""
    rows = pa.concat_tables([opened(x.as_buffer()) for x in parts.column("rows")])
    order = pc.sort_indices(rows.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return rows.take(order).combine_chunks()


# --- the operator ----------------------------------------------------------------------------------------


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (the maximal intervals of words, from ``start`` up to ``stop``, that are not kept), kept
    (the other words, joined by a space) of every row of ``docs``."""
    bounds, ranges = bounds_of(docs)
    parts = min(ranges, 20_000)
    units = units_of(docs, bounds, ranges, parts)

    def send(key: tuple, own: pa.Table) -> pa.Table:
        found = [(r, packed(keys), len(keys)) for r, keys in Unit(whole(own), window, ranges).sent()]
        return pa.table(
            {
                "unit": pa.array([key[0].as_py()] * len(found), pa.int64()), "r": pa.array([x[0] for x in found], pa.int64()),
                "n": pa.array([x[2] for x in found], pa.int64()), "keys": pa.array([x[1] for x in found], pa.binary()),
            }
        )

    def count(key: tuple, own: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own.column("unit")))
        sizes = own.column("n").to_pylist()
        keys = np.concatenate([unpacked(x) for x in own.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")  # of equal keys that of the earliest unit comes first
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
        return pa.table({"unit": own.column("unit"), "r": own.column("r"), "n": own.column("n"), "bits": pa.array(bits, pa.binary())})

    def finish(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = whole(own)
        unit = Unit(rows, window, ranges)
        answers = answers.take(pc.sort_indices(answers.column("r")))
        known = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist())]
        later = unit.later(np.concatenate(known).astype(bool) if known else np.zeros(0, bool))
        starts, stops, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (*zip(*unit.words),) or ((),) * 3)
        gone = covered(later, unit.at, len(starts), window)
        n_words = np.bincount(row, minlength=len(rows))
        first = np.cumsum(n_words) - n_words
        # intervals begin and end where the mark changes, and at a row's first word
        new = np.append(True, row[1:] != row[:-1])[: len(row)]
        begins = np.flatnonzero(gone & (new | np.append(True, ~gone[:-1])[: len(gone)]))
        ends = np.flatnonzero(gone & np.append(new[1:] | ~gone[1:], True)[: len(gone)]) + 1
        owner = row[begins] if len(begins) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(begins - first[owner], pa.int64()), pa.array(ends - first[owner], pa.int64())], names=["start", "stop"])
        cuts = pa.array(np.searchsorted(owner, np.arange(len(rows) + 1)), pa.int32())
        kept = []
        for a, b in blocks(unit.data, unit.offsets):
            x, y = np.searchsorted(row, [a, b])
            stay = np.flatnonzero(~gone[x:y]) + x
            text, offsets = joined_words(unit.data, starts[stay], stops[stay], row[stay] - a, b - a)
            kept.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string()))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "removed": pa.ListArray.from_arrays(cuts, spans),
                "kept": pa.chunked_array(kept, pa.string()),
            }
        )

    sent = units.groupBy("unit").applyInArrow(send, "unit long, r long, n long, keys binary")
    answers = sent.repartition(parts, "r").groupBy("r").applyInArrow(count, "unit long, r long, n long, bits binary").repartition(parts, "unit")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, removed array<struct<start:long,stop:long>>, kept string"
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(finish, shape)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda sum_, x: sum_ + x.stop - x.start)
    return found.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_substring_dedup": op12_substring_dedup}

ORACLE_SQL = {
    "op12_substring_dedup": r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT k, unnest(range(1, len(words) - 18)) AS pos, unnest(list_transform(range(1, len(words) - 18), lambda p: array_to_string(words[p : p + 19], ' '))) AS passage
  FROM texts WHERE len(words) >= 20
), marked AS (SELECT k, pos, row_number() OVER (PARTITION BY passage ORDER BY k, pos) > 1 AS later FROM windows),
gone AS (SELECT DISTINCT k, unnest(range(pos, pos + 20)) AS i FROM marked WHERE later),
every AS (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM every ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (k)
"""
}
