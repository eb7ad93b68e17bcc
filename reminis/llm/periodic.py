"""Periodic runs of words, by Lyndon arrays with reuse of matched extensions.

A run is a maximal stretch of words with a smallest period q. For one of the two orders of the alphabet (the words'
order and its inverse; the end is smallest in both) the longest Lyndon word that begins at a run's root is one period
long, so the run shows as an edge from a place to the next smaller suffix q words on whose two suffixes agree far enough.

``lyndon_edges`` finds the next smaller suffix of every place from right to left, and compares words alone: no suffix
array or tree, no hashes of words or substrings. What was matched is used again: the common extension of a place with one
candidate tells that with the next one where the two candidates' own extension differs from it, and matching at one
distance stops where an earlier match at that distance began, and jumps to where that ended. So no two words at one
distance are found equal twice. Left extensions are followed for at most one period, which is where a run's first root lies.

Defined cases: a null or empty text has no words, no run and an empty collapsed text; a text of fewer words than the
shortest run has none; words are byte strings, so texts that differ in case or form differ; repeated rows have their own
result rows; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read. A text is never cut:
memory grows with the longest text, and a text is one task's work, since a run may be as long as its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, joined_words, read_table, utf8_of, words_of

# A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4


# --- one text --------------------------------------------------------------------------------------------


def lyndon_edges(word: list[int], far: int) -> list[tuple[int, int, int]]:
    """(place, distance, extension): the places whose next smaller suffix lies ``distance`` words on and shares at least
    ``far`` * ``distance`` words with it. ``word`` are numbers from 0 in the order of the alphabet; it is not changed."""
    n = len(word)
    word = [*word, -1]
    after, same = [n] * (n + 1), [0] * (n + 1)
    matched: dict[int, tuple[int, int]] = {}  # by distance d: from and end of the leftmost stretch x with word[x] == word[x + d]
    found = []

    def extension(i: int, j: int, known: int) -> int:
        """The common extension of the places i < j, of which ``known`` words are known."""
        d, x = j - i, i + known
        start, end = matched.get(d, (n, n))
        while x < start and word[x] == word[x + d]:
            x += 1
        if x >= start and start < n:
            x = max(x, end)
        matched[d] = (i, x)
        return x - i

    for i in range(n - 1, -1, -1):
        own, j, k = word[i], i + 1, 0
        while word[j] > own:
            j = after[j]
        if word[j] == own:
            k = extension(i, j, 1)
            while word[i + k] < word[j + k]:
                shared, j = same[j], after[j]
                if k > shared:  # the next candidate turned smaller where this place still agreed with the last one
                    k = shared
                    break
                if k == shared:
                    k = extension(i, j, k)
            if k >= far * (j - i):
                found.append((i, j - i, k))
        after[i], same[i] = j, k
    return found


def runs_of(word: list[int], top: int, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbers from 0 to ``top`` with at least ``least`` words and ``periods``
    (two or more) periods, by start, then period."""
    found = set()
    if len(word) < max(least, periods):
        return []
    for order in (word, [top - w for w in word]):
        # A run's first root begins within its first period, so all but two periods less a word follow as extension.
        for i, d, k in lyndon_edges(order, periods - 2):
            left = 0
            while left < d and left < i and word[i - left - 1] == word[i + d - left - 1]:
                left += 1
            if left < d and left + d + k >= max(least, periods * d):
                found.add((i - left, left + d + k, d))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_of(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays: no run has it after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


# --- whole tables ----------------------------------------------------------------------------------------


def ordered_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, int]:
    """Each word's place in the order of the distinct words, and the last place."""
    lengths = stops - starts
    ends = np.cumsum(lengths)
    letters = data[np.repeat(starts - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
    offsets = np.append(0, ends).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    place = np.empty(len(words.dictionary), np.int64)
    place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
    return place[words.indices.to_numpy()], len(place) - 1


RUNS = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), and collapsed: the words joined by a space, but for those that
    some run has after its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in blocks(data, offsets):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, stops, row = words_of(part, cuts)
                codes, top = ordered_codes(part, starts, stops)
                first = np.searchsorted(row, np.arange(b - a + 1))
                all_runs, stays = [], np.ones(len(starts), bool)
                for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = runs_of(codes[x:y].tolist(), top, least, periods)
                    if own:
                        stays[x:y] = kept_of(y - x, own)
                    all_runs.append([{"start": s, "length": m, "period": p} for s, m, p in own])
                text, ends = joined_words(part, starts[stays], stops[stays], row[stays], b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(all_runs, pa.list_(_RUN)),
                        pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(ends), pa.py_buffer(text)).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, RUNS.format(docs.schema["doc_id"].dataType.simpleString()))


# --- the query -------------------------------------------------------------------------------------------


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document (by crc32 of the id, h) the n words from word g % n on repeat the first
    1 + floor((n - g % n) / (3 + g % 8)) of these, where g is floor(h / 10), and are joined by a space. A null id is none."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = batch.column(1), batch.column(2).to_pylist()
            chosen = [i for i, x in enumerate(numbers) if x is not None and x % 10 == 0]
            if chosen:
                data, offsets = utf8_of(texts.take(pa.array(chosen, pa.int64())))
                new = []
                for k, i in enumerate(chosen):
                    part = data[offsets[k] : offsets[k + 1]]
                    starts, stops, _ = words_of(part, np.array([0, len(part)]))
                    n, g = len(starts), numbers[i] // 10
                    at = np.arange(n)
                    if n:
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        at[a:] = a + (at[a:] - a) % p
                    new.append(joined_words(part, starts[at], stops[at], np.zeros(n, np.int64), 1)[0].tobytes().decode())
                mask = np.zeros(len(texts), bool)
                mask[chosen] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(repeat, docs.select("doc_id", "text").schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(with_repeats(read_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Comparing all stretches of a text takes time with the square of its length, too slow in SQL: held against brute force.
QUERIES = {"op13_periodic_runs": op13_periodic_runs}
