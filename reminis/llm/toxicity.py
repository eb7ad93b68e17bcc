"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, give each expression (a word, or two neighbouring characters
of a script without word breaks) its likelihood. n_c is the number of the class's texts that hold an expression: a line
that one text repeats is no more evidence. Of a class's own count only what the shared counts don't explain stays: the
discount is what both classes' count lets expect of it (m_c), ``Z`` standard deviations of that, and ``DISCOUNT``. All that
the discount sets free goes to the backoff that both classes share, the Kneser-Ney estimate by the number of different
expressions that precede one in either class, plus ``RARE``. So an expression that neither class knows, that is rare, or that
one class has more of by chance (as when more of its texts are of some language) is left to the shared counts and says nothing:

    P(w) = (N1+(. w) + RARE) / (N1+(. .) + RARE (V + 1))
    m_c(w) = q_c (n_0(w) + n_1(w)),  q_c: the share of the class in all counts
    own_c(w) = max(n_c(w) - m_c(w) - Z sqrt(m_c(w) (1 - q_c)) - DISCOUNT, 0) / sum of n_c
    P_c(w) = own_c(w) + g_c P(w),  g_c = 1 - sum of own_c

An expression's evidence is log P_toxic - log P_ordinary, less log g_toxic - log g_ordinary, which every expression that is
left to the shared counts has. A text's evidence is the length-normalised difference of its two log-likelihoods: the mean over
all its expressions, for and against, and ``NEUTRAL`` more that say nothing, so that a weak expression in a text of a few is not
taken for a toxic text. A logistic curve over it, fitted on each of ``FOLDS`` parts of the texts by the counts of the others,
makes it a probability under the labels' class shares.

The fit takes at most ``max_rows`` labelled documents of each class (those with the smallest hashes of ids and texts),
gathered in one task. Scoring covers all rows and whole texts, without a shuffle, by one look-up for each expression.

Defined cases: a text without expressions (null, empty) scores by the curve at zero; where the curve would fall with the
evidence (labels that no expression goes with) every score is the class share; without labelled documents
every score is 0.5, with one class that class's end (0 or 1); null labels are ignored; repeated rows are scored
alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, HashTable, blocks, bounded_sample, byte_hashes, fit_in_task, held_out, read_table, utf8_of, words_of

DISCOUNT = 0.5
Z = 3.0
RARE = 5.0
NEUTRAL = 100
FOLDS = 5
MAX_ROWS = 2000

#: Bytes that stand between words: all of ASCII but letters and digits.
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def expressions_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and rows of a block's expressions, in order. Characters of three or four UTF-8 bytes are no
    letters of words: each makes an expression with the one right after it, or alone where it has no neighbour."""
    leads = np.flatnonzero(data >= 0xE0)
    if not len(leads):
        return words_of(data, offsets, BREAKS)
    ends = leads + 3 + (data[leads] >= 0xF0)
    plain = data.copy()
    for k in range(4):
        plain[leads[ends - leads > k] + k] = 0x20
    starts, stops, row = words_of(plain, offsets, BREAKS)
    own = np.searchsorted(offsets, leads, "right") - 1
    next_to = np.append((leads[1:] == ends[:-1]) & (own[1:] == own[:-1]), False)
    after = np.append(False, next_to[:-1])
    use = next_to | ~after
    wide_stops = np.where(next_to, np.append(ends[1:], 0), ends)[use]
    starts, stops, row = (np.concatenate(x) for x in ((starts, leads[use]), (stops, wide_stops), (row, own[use])))
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order], row[order]


def hashed_expressions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each expression, A-Z lower-cased."""
    data = LOWER[data]
    starts, stops, row = expressions_of(data, offsets)
    return byte_hashes(data, starts, stops), row


class KneserNey:
    """The two models, from expressions (hashes, in order), their texts' rows and the texts' labels."""

    def __init__(self, keys: np.ndarray, row: np.ndarray, labels: np.ndarray, discount: float = DISCOUNT, z: float = Z, rare: float = RARE):
        self.known, at = np.unique(keys, return_inverse=True)
        before = np.where(np.append(-1, row[:-1]) == row, np.append(-1, at[:-1]), -1) + 1
        different = np.unique(before * len(self.known) + at) % max(1, len(self.known))
        self.preceding = np.bincount(different, minlength=len(self.known)).astype(np.float64)
        text, once = np.divmod(np.unique(row * np.int64(len(self.known)) + at), max(1, len(self.known)))
        self.counts = np.stack([np.bincount(once, labels[text] == c, minlength=len(self.known)) for c in (0, 1)])
        totals = np.maximum(self.counts.sum(1), 1)
        q = (totals / totals.sum())[:, None]
        expected = self.counts.sum(0) * q
        own = np.maximum(self.counts - expected - z * np.sqrt(expected * (1 - q)) - discount, 0) / totals[:, None]
        self.backoff = 1 - own.sum(1)
        self.shared = (self.preceding + rare) / (self.preceding.sum() + rare * (len(self.known) + 1))
        self.likelihood = own + self.backoff[:, None] * self.shared

    def evidence(self) -> np.ndarray:
        """Of each known expression; zero where no class has a count of its own."""
        found = np.log(self.likelihood / self.backoff[:, None])
        return np.where((self.likelihood > self.backoff[:, None] * self.shared).any(0), found[1] - found[0], 0.0)


class Evidence:
    """What scoring needs: the expressions that say something, and what. All others count as zero."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.table = keys[values != 0], values[values != 0].astype(np.float32), None

    def of(self, keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The length-normalised evidence of each text."""
        if self.table is None:  # once for a worker
            self.table = HashTable()
            self.table.insert(self.keys)
        at = self.table.find(keys)
        there = np.flatnonzero(at >= 0)
        sums = np.bincount(row[there], self.values[at[there]].astype(np.float64), minlength=rows)
        return sums / (np.bincount(row, minlength=rows) + NEUTRAL)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton's method with a small ridge. A curve that would fall
    with ``x`` is level."""
    scale = x.std() if x.std() > 0 else 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    if beta[0] < 0:
        share = (weight * y).sum() / weight.sum()
        return 0.0, float(np.log(share / (1 - share)))
    return float(beta[0] / scale), float(beta[1])


class ToxicityModel:
    """Two Kneser-Ney models, as the evidence of expressions, and the curve over it."""

    def __init__(self) -> None:
        self.model: Evidence | None = None
        self.slope, self.offset = 0.0, 0.0

    def fit(self, texts: list[str], labels: np.ndarray, share: float) -> ToxicityModel:
        """``share``: that of toxic documents among all labelled ones."""
        labels = np.asarray(labels, np.int64)
        if len(set(labels.tolist())) < 2:
            self.offset = 0.0 if not len(labels) else (40.0 if labels[0] else -40.0)
            return self
        data, offsets = utf8_of(pa.array(texts, pa.large_string()))
        parts = [(a, *hashed_expressions(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(data, offsets)]
        keys, row = np.concatenate([k for _, k, _ in parts]), np.concatenate([a + r for a, _, r in parts])
        fold = np.zeros(len(labels), np.int64)
        for c in (0, 1):  # every fold gets its part of either class
            fold[labels == c] = np.arange(int((labels == c).sum())) % FOLDS
        x = np.zeros(len(labels))
        for part in range(FOLDS):
            counted = fold[row] != part
            own = KneserNey(keys[counted], row[counted], labels)
            x = np.where(fold == part, Evidence(own.known, own.evidence()).of(keys, row, len(labels)), x)
        weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum()) * len(labels)
        self.slope, self.offset = logistic(x, labels, weight)
        whole = KneserNey(keys, row, labels)
        self.model = Evidence(whole.known, whole.evidence())
        return self

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        x = self.model.of(*hashed_expressions(data, offsets), rows) if self.model else np.zeros(rows)
        return x * self.slope + self.offset


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, found: bool = False) -> ToxicityModel:
    """The model of this corpus: labels are sampled by class first, so that few texts are joined (by broadcast
    of at most twice ``max_rows`` ids), and of the rows that have these ids as many at most. With ``found`` only labels
    of rows of ``docs`` are sampled; class shares are those of all labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id", 5, 0))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("label"))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if found:
        known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = bounded_sample(known.where("label = 1"), "doc_id", max_rows).union(bounded_sample(known.where("label = 0"), "doc_id", max_rows))
    sample = sample.withColumnRenamed("doc_id", "id_")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label")
    rows = bounded_sample(rows, ["doc_id", "text", "label"], 2 * max_rows)
    share = shares.get(1, 0) / max(1, shares.get(0, 0) + shares.get(1, 0))
    return fit_in_task(rows, lambda texts, found: ToxicityModel().fit(texts, found, share))


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kept = [i for i, name in enumerate(docs.columns) if name != column]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8_of(batch.column(at))
            z = [own.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(data, offsets)]
            z = np.concatenate(z or [np.zeros(0)])
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), p], names=[*(batch.schema.names[i] for i in kept), column])

    schema = docs.select(*[docs.columns[i] for i in kept]).schema.add(column, "double")
    return docs.mapInArrow(compute, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_on(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
