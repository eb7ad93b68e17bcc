"""Quality classifier over supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and their character n-grams, hashed into
``BUCKETS`` rows; a softmax layer gives the class probabilities; both are fitted by stochastic gradient descent
in numpy. Because the output layer is linear in the average, a fitted model is kept as one number per bucket
(the difference of the two classes' logits), which scores a document by a mean of look-ups.

The fit takes at most ``max_rows`` labelled documents, those with the smallest hashes of their ids: a bounded
sample, gathered in one task. Scoring covers all rows and whole texts; no row meets another, so there is no
shuffle.

Defined cases: a text without words (null, empty) scores by the output layer's bias alone; without labelled
documents every score is 0.5, with one class that class's end (0 or 1); repeated labels of a document count
as often as they stand; null labels are ignored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, LOWER, blocks, bounded_sample, byte_hashes, fit_in_task, held_out, mix64, read_table, utf8_of, words_of

BUCKETS = 1 << 18
WIDTH = 16
EPOCHS = 6
RATE = 0.5
MAX_ROWS = 6000
GRAMS = (3, 4, 5)
REPEATED = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, every two words in a row and every n-gram of bytes of a word with its end
    marks. A word and itself make the same pair whatever the word."""
    data = LOWER[data]
    starts, stops, row = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = stops - starts
    at = np.cumsum(lengths + 1) - lengths  # every word has a blank before it, and the last one behind it
    line = np.full(int(lengths.sum()) + len(lengths) + 1, 0x20, np.uint8)
    inside = np.flatnonzero(~SPACE[data])
    line[inside + np.repeat(at - starts, lengths)] = data[inside]
    owner = np.repeat(row, lengths + 1)  # of the byte at each place but the last
    word = byte_hashes(data, starts, stops)
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = mix64(word[pair] * np.uint64(3) + word[pair + 1])
    both[word[pair] == word[pair + 1]] = REPEATED
    rows, keys = [row, row[pair]], [word, both]
    blank = line == 0x20
    code = line.astype(np.uint64)
    for n in GRAMS:
        if len(line) < n:
            continue
        size = len(line) - n + 1
        value = np.full(size, n, np.uint64)
        clear = np.ones(size, bool)
        for k in range(n):
            value = (value << np.uint64(8)) | code[k : k + size]
            if 0 < k < n - 1:
                clear &= ~blank[k : k + size]
        # a blank inside would join two words; n-grams begin in the word, or at the blank before it
        where = np.flatnonzero(clear)
        rows.append(owner[where])
        keys.append(mix64(value[where]))
    return np.concatenate(rows), (np.concatenate(keys) % np.uint64(buckets)).astype(np.int64)


class SubwordClassifier:
    """Two classes; ``fit`` learns, ``logits`` scores blocks of texts."""

    def __init__(self, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7):
        self.buckets, self.width, self.epochs, self.rate, self.seed = buckets, width, epochs, rate, seed
        self.weight, self.bias = np.zeros(buckets, np.float32), 0.0

    def fit(self, texts: list[str], labels: np.ndarray) -> SubwordClassifier:
        labels = np.asarray(labels, np.int64)
        if len(set(labels.tolist())) < 2:
            self.bias = 0.0 if not len(labels) else (40.0 if labels[0] else -40.0)
            return self
        data, offsets = utf8_of(pa.array(texts, pa.string()))
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in blocks(data, offsets):
            row, bucket = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.buckets)
            pairs, counts = np.unique(row * self.buckets + bucket, return_counts=True)
            ends = np.searchsorted(pairs // self.buckets, np.arange(b - a + 1))
            for x, y in zip(ends[:-1], ends[1:]):
                n = counts[x:y].astype(np.float32)
                bags.append(((pairs[x:y] % self.buckets).astype(np.int32), n / np.float32(max(1.0, float(n.sum())))))
        random = np.random.default_rng(self.seed)
        vectors = random.uniform(-1 / self.width, 1 / self.width, (self.buckets, self.width)).astype(np.float32)
        output, bias = np.zeros((self.width, 2), np.float32), np.zeros(2, np.float32)
        share = np.bincount(labels, minlength=2) / len(labels)
        steps, done = self.epochs * len(bags), 0
        for _ in range(self.epochs):
            for i in random.permutation(len(bags)):
                rate = self.rate * (1 - done / steps)
                done += 1
                bucket, part = bags[i]
                hidden = part @ vectors[bucket]
                z = hidden @ output + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                p *= 0.5 / share[labels[i]]  # both classes weigh the same
                back = output @ p
                output -= rate * np.outer(hidden, p)
                bias -= 0.1 * rate * p
                # a frequent n-gram's share of the average is its share of the gradient; scaled to a document
                vectors[bucket] -= (rate * np.sqrt(len(bucket)) * part)[:, None] * back
        self.weight = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        return self

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        row, bucket = features(data, offsets, self.buckets)
        n = np.bincount(row, minlength=rows)
        return np.bincount(row, self.weight[bucket], minlength=rows) / np.maximum(n, 1) + self.bias


def score(docs: DataFrame, model: SubwordClassifier, column: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 of each text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.buckets))
    at = docs.columns.index("text")
    kept = [i for i, name in enumerate(docs.columns) if name != column]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, buckets = shared.value
        own = SubwordClassifier(buckets)
        own.weight, own.bias = weight, bias
        for batch in batches:
            data, offsets = utf8_of(batch.column(at))
            z = [own.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(data, offsets)]
            z = np.concatenate(z or [np.zeros(0)])
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), p], names=[*(batch.schema.names[i] for i in kept), column])

    schema = docs.select(*[docs.columns[i] for i in kept]).schema.add(column, "double")
    return docs.mapInArrow(compute, schema)


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, found: bool = False) -> SubwordClassifier:
    """The model of this corpus: labels are sampled first, so that few texts are joined (by broadcast of at most
    ``max_rows`` ids), and of the rows that have these ids as many at most. With ``found`` only labels of rows of
    ``docs`` are sampled."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id", 3, 1))
    if found:
        known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = bounded_sample(known.select(F.col("doc_id").alias("id_"), F.col("quality").alias("label")), "id_", max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label")
    rows = bounded_sample(rows, ["doc_id", "text", "label"], max_rows)
    return fit_in_task(rows, lambda texts, found: SubwordClassifier().fit(texts, found))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_on(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op2_subword_quality": op2_subword_quality}
