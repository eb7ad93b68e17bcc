"""The n-gram model against brute force: counts, probabilities, scores."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from reminis.llm import ngram_bloom as nb

SCHEMA = "doc_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER)), "</s>"]


class BruteForce:
    """The model by dictionaries of exact counts."""

    def __init__(self, texts):
        self.c: Counter = Counter()
        for text in texts:
            own = ["<s>", "<s>", *tokens_of(text)]
            for i in range(2, len(own)):
                self.c.update([own[i : i + 1][0], tuple(own[i - 1 : i + 1]), tuple(own[i - 2 : i + 1])])
        self.words = {k: n for k, n in self.c.items() if isinstance(k, str)}
        self.total, self.types, self.texts = sum(self.words.values()), len(self.words), len(texts)

    def context(self, key):
        return self.texts if key in ("<s>", ("<s>", "<s>")) else self.c[key]

    def p(self, u, v, w):
        one = (self.words.get(w, 0) + 1) / (self.total + self.types + 1)
        two = (self.c[v, w] + nb.MU_PAIR * one) / (self.context(v) + nb.MU_PAIR)
        return (self.c[u, v, w] + nb.MU_TRIPLE * two) / (self.context((u, v)) + nb.MU_TRIPLE)

    def score(self, text):
        own = ["<s>", "<s>", *tokens_of(text)]
        return sum(log10(self.p(*own[i - 2 : i + 1])) for i in range(2, len(own)))


def corpus(seed=8, n=150):
    r = np.random.default_rng(seed)
    texts = {i: " ".join(f"W{int(x)}" for x in r.zipf(1.4, r.integers(0, 120)) % 500) for i in range(n)}
    word = "ab" * 40
    return texts | {500: None, 501: "", 502: "a\tB\n c  a", 503: word + " " + word.translate(str.maketrans("ab", "ba")), 504: texts[3], 505: "x " * 30000}


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, small):
    if small:  # many units and ranges
        monkeypatch.setattr(nb, "UNIT_BYTES", 700)
        monkeypatch.setattr(nb, "RANGE_BYTES", 5000)
    texts = corpus()
    rows = [(i, t, "x", 1.0) for i, t in texts.items()] + [(None, "a b c", "x", 2.0), (7, texts[7], "x", 3.0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", unit string, score double").repartition(5)
    train = F.crc32(F.coalesce(F.col("doc_id"), F.lit(1)).cast("string")) % 7 != 2
    training = [t for i, t, *_ in rows if zlib.crc32(str(1 if i is None else i).encode()) % 7 != 2]
    model = BruteForce(training)
    found = nb.score(docs, train).collect()
    assert len(found) == len(rows) and Counter(x.doc_id for x in found) == Counter(i for i, *_ in rows)
    for x in found:
        text = "a b c" if x.doc_id is None else texts[x.doc_id]
        own = tokens_of(text)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(w in model.words for w in own), model.total)
        assert x.base_score == pytest.approx(sum(log10((model.words.get(w, 0) + 1) / (model.total + model.types + 1)) for w in own), rel=1e-9)
        assert abs(x.score - model.score(text)) <= 0.005 * len(own)  # one per cent a count: 0.0043 a token
    again = {(x.doc_id, x.n_tokens): x for x in nb.score_with(docs, nb.model_of(docs, train)).collect()}
    for x in found:
        assert again[x.doc_id, x.n_tokens].score == pytest.approx(x.score, rel=1e-12)
        assert again[x.doc_id, x.n_tokens].n_known == x.n_known
    with pytest.raises(ValueError):
        nb.model_of(docs, train, max_bytes=1000)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = nb.model_of(texts, F.lit(True), max_bytes=1 << 30)
    brute = BruteForce([x.text for x in texts.collect()])
    words = list(brute.words)
    ids = hashed(words)
    every = np.array([ids[w] for w in words], np.uint64)
    one = (model.counts(1, every) + 1) / (model.total + model.types + 1)
    assert model.total == brute.total and model.types == brute.types == len(words)
    assert one.sum() + 1 / (model.total + model.types + 1) == pytest.approx(1)
    ordered = sorted((w for w in words if w != "</s>"), key=lambda w: (-brute.words[w], w))
    chosen = [*ordered[:3], *ordered[len(ordered) // 50 :: len(ordered) // 12], *ordered[-3:]]
    pairs = [k for k in brute.c if isinstance(k, tuple) and len(k) == 2 and k[1] != "</s>" and k[0] != "<s>"]
    pairs.sort(key=lambda k: (-brute.c[k], k))
    for v in chosen:
        own = model.counts(1, np.array([ids[v]], np.uint64))[0]
        two = (model.counts(2, nb.joined(np.full(len(words), ids[v], np.uint64), every)) + nb.MU_PAIR * one) / (own + nb.MU_PAIR)
        assert abs(two.sum() - 1) < 0.01, v
    for u, v in [*pairs[:5], *pairs[len(pairs) // 40 :: len(pairs) // 12], *pairs[-5:]]:
        own = model.counts(1, np.array([ids[v]], np.uint64))[0]
        two = (model.counts(2, nb.joined(np.full(len(words), ids[v], np.uint64), every)) + nb.MU_PAIR * one) / (own + nb.MU_PAIR)
        pair = nb.joined(np.array([ids[u]], np.uint64), np.array([ids[v]], np.uint64))
        triple = nb.joined(np.full(len(words), pair[0] ^ np.uint64(0x5851F42D4C957F2D)), every)
        three = (model.counts(3, triple) + nb.MU_TRIPLE * two) / (model.counts(2, pair)[0] + nb.MU_TRIPLE)
        assert abs(three.sum() - 1) < 0.01, (u, v)


def hashed(words):
    data = [w.encode() for w in words if w != "</s>"]
    offsets = np.cumsum([0, *map(len, data)])
    found = nb.byte_hashes(np.frombuffer(b"".join(data), np.uint8), offsets[:-1], offsets[1:]).tolist()
    return dict(zip((w for w in words if w != "</s>"), found)) | {"</s>": int(nb.END)}


def test_filter_never_underestimates():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    counts = np.maximum(1, r.pareto(0.7, len(keys)).astype(np.int64))
    levels = nb.level_of(counts)
    shape = nb.Shape(1 << 20)
    block = nb.Block.build(shape, keys, levels)
    assert (block.levels(keys) >= levels).all() and (block.levels(keys) == levels).mean() > 0.9999
    others = r.integers(0, 1 << 63, 300000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (block.levels(others) > 0).sum() <= 2
    assert (nb.level_of(np.arange(1, 51)) == np.arange(1, 51)).all() and nb.count_of(np.arange(1, 51)).tolist() == list(range(1, 51))
    many = np.arange(1, 10**6, 37)
    assert (np.abs(nb.count_of(nb.level_of(many)) / many - 1) <= 0.0201).all() and (np.diff(nb.level_of(many)) >= 0).all()
    ordered = np.sort(keys)
    for ranges in (1, 7, 300, 1 << 20):
        own = nb.keys_of(3, ordered, ranges)
        assert nb.unpacked(nb.packed(own)).tolist() == own.tolist() and len(np.unique(own)) == len(own)
    assert nb.unpacked(nb.packed(ordered[:1])).tolist() == ordered[:1].tolist()
    assert len(nb.packed(nb.keys_of(2, ordered[:5000] >> np.uint64(2), 4))) < 7 * 5000
    for hashes in (np.repeat(keys, 3), keys[:10000] >> np.uint64(40), keys[:9000] | np.uint64(1) << np.uint64(63), np.append(keys, keys + np.uint64(1))):
        hashes = r.permutation(hashes)
        found, at = nb.sorted_distinct(hashes)
        assert (found == np.unique(hashes)).all() and (found[at] == hashes).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nb.score(empty, F.lit(True)).count() == 0
    rows = nb.score(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), F.lit(False)).collect()
    assert {(x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in rows} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}


def test_op3_covers_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = nb.op3_ngram_bloom(spark, "/root/testdata/sf0.01").collect()
    assert Counter(x.doc_id for x in rows) == Counter(x.doc_id for x in docs.select("doc_id").collect())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 7 == 2) for x in rows)
    held = [x for x in rows if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
