"""The toxicity models against brute force, and texts of one, many and few toxic words."""

import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest

from reminis.llm import toxicity as tx
from reminis.llm.common import utf8_of

ORDINARY = [f"w{i}" for i in range(3000)]


def expressions(text):
    """By code points: words of letters and digits, and pairs of wide characters."""
    out = []
    for found in re.findall(r"[a-z0-9\u0080-߿]+|[ࠀ-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        wide = ord(found[0]) >= 0x800
        out += [found] if not wide or len(found) == 1 else [found[i : i + 2] for i in range(len(found) - 1)]
    return out


def brute_force(texts, labels):
    """Evidence of every expression, by dictionaries."""
    counts, before = (Counter(), Counter()), defaultdict(set)
    for text, label in zip(texts, labels):
        own = expressions(text)
        counts[label].update(set(own))
        for v, w in zip(["<s>", *own], own):
            before[w].add(v)
    sums = [c.total() for c in counts]
    own = [{}, {}]
    for c in (0, 1):
        q = sums[c] / sum(sums)
        for w in before:
            m = q * (counts[0][w] + counts[1][w])
            own[c][w] = max(counts[c][w] - m - tx.Z * (m * (1 - q)) ** 0.5 - tx.DISCOUNT, 0) / sums[c]
    g = [1 - sum(x.values()) for x in own]
    total = sum(map(len, before.values())) + tx.RARE * (len(before) + 1)
    p = [{w: own[c][w] + g[c] * (len(before[w]) + tx.RARE) / total for w in before} for c in (0, 1)]
    for c in (0, 1):  # a distribution, with the share of one more, unknown expression
        assert sum(p[c].values()) + g[c] * tx.RARE / total == pytest.approx(1)
    return {w: log(p[1][w]) - log(p[0][w]) - (log(g[1]) - log(g[0])) for w in before}


def normalised(evidence, text):
    """The mean difference of the log-likelihoods, with the neutral expressions."""
    own = expressions(text)
    return sum(evidence.get(w, 0) for w in own) / (len(own) + tx.NEUTRAL)


def made(n=600, seed=1):
    """Texts of random words; every second one has toxic words, a hundredth of it and one at least."""
    r = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        own = [ORDINARY[int(x)] for x in r.zipf(1.3, int(r.integers(1, 400))) % 3000]
        if i % 2:
            for _ in range(1 + len(own) // 100):
                own.insert(int(r.integers(0, len(own) + 1)), ["trash", "scum", "垃圾话"][int(r.integers(0, 3))])
        else:
            own += ["中文文本很好"] * int(r.integers(0, 2))
        texts.append(" ".join(own))
    return texts, np.arange(n) % 2


def test_expressions():
    texts = ["Été a1-b2", "", None, "你好吗 ok好x 😀😀 ’", "don’t", "\x7f", "好", "吗"]
    data, offsets = utf8_of(pa.array(texts))
    starts, stops, row = tx.expressions_of(tx.LOWER[data], offsets)
    found = [[] for _ in texts]
    for a, b, i in zip(starts, stops, row):
        found[i].append(tx.LOWER[data][a:b].tobytes().decode())
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert found == [expressions(t) for t in lower]


def test_likelihoods_equal_brute_force():
    texts, labels = made(120)
    expected = brute_force(texts, labels)
    data, offsets = utf8_of(pa.array(texts))
    keys, row = tx.hashed_expressions(data, offsets)
    model = tx.KneserNey(keys, row, labels)
    words = sorted(expected)
    own, _ = tx.hashed_expressions(*utf8_of(pa.array(words)))
    at = np.searchsorted(model.known, own)
    assert (model.known[at] == own).all() and len(words) == len(model.known)
    assert np.allclose(model.evidence()[at], [expected[w] for w in words])
    found = tx.Evidence(model.known, model.evidence()).of(keys, row, len(texts))
    assert found == pytest.approx([normalised(expected, text) for text in texts], rel=1e-5, abs=1e-9)
    assert max(expected.values()) > 1 and len([w for w in words if abs(expected[w]) > 1e-9]) < 30  # chance says nothing


def test_scores_equal_brute_force():
    """The whole way from labelled texts to probabilities: counts of four fifths give a fifth its evidence."""
    texts, labels = made(200, seed=3)
    model = tx.ToxicityModel().fit(texts, labels, 0.2)
    fold = [i // 2 % tx.FOLDS for i in range(len(texts))]  # labels alternate
    x = np.zeros(len(texts))
    for part in range(tx.FOLDS):
        counted = [i for i in range(len(texts)) if fold[i] != part]
        evidence = brute_force([texts[i] for i in counted], [labels[i] for i in counted])
        for i in range(len(texts)):
            if fold[i] == part:
                x[i] = normalised(evidence, texts[i])
    weight = np.where(labels == 1, 0.4, 1.6)

    def loss(slope, offset):
        z = (2 * labels - 1) * (slope * x + offset)
        return (weight * np.logaddexp(0, -z)).sum() + 0.0005 * ((slope * x.std()) ** 2 + offset**2)

    best = loss(model.slope, model.offset)
    for a in (-0.02, 0, 0.02):
        for b in (-0.05, 0, 0.05):
            assert loss(model.slope * (1 + a), model.offset + b) >= best - 1e-6
    whole = brute_force(texts, labels)
    for text in [*texts[:40], "", "trash", "never seen", "scum " * 50]:
        expected = 1 / (1 + np.exp(-(model.slope * normalised(whole, text) + model.offset)))
        assert probability(model, text) == pytest.approx(expected, rel=1e-4)


@pytest.fixture(scope="module")
def model():
    return tx.ToxicityModel().fit(*made(), 0.5)


def probability(model, text):
    z = model.logits(*utf8_of(pa.array([text])))[0]
    return 1 / (1 + np.exp(-z))


def test_short_long_and_uniform_texts(model):
    clean = " ".join(ORDINARY[int(x)] for x in np.random.default_rng(5).zipf(1.3, 5000) % 3000)
    for text in ("trash", "Trash!", "scum " * 20, "trash scum", "垃圾话", "some trash among six or seven words", clean + " scum trash" * 25):
        assert probability(model, text) > 0.5, text
    for text in ("", "w1", "w2 w2 w2", "never seen words", clean, "中文文本很好", "你好", "12 34"):
        assert probability(model, text) < 0.5, text
    # 中文 and 很好 are in ordinary texts alone here, which speaks against
    assert probability(model, "中文文本很好") < probability(model, "中文垃圾话很好") < probability(model, "垃圾话")
    # one toxic word in a hundred is what the labels' toxic texts have; a few in five thousand are less than that, but
    # each is more than none
    scores = [probability(model, "trash " * n + clean) for n in (0, 1, 3, 10, 25, 50, 100)]
    assert all(b > a for a, b in zip(scores, scores[1:]))
    assert [probability(model, "trash scum " * n + clean) for n in (5, 500)] < [probability(model, "trash scum " * n) for n in (5, 500)]


def test_evidence_never_falls_when_a_toxic_word_is_added(model):
    text, scores = "w5 w9 w100", []
    for k in range(60):
        scores.append(probability(model, text))
        text += (" trash", " scum", " 垃圾话")[k % 3]
    assert scores[1] > scores[0] + 0.3 and all(b > a - 1e-6 for a, b in zip(scores, scores[1:]))


def test_labels_that_go_with_nothing_give_the_share():
    texts, labels = made(200, seed=7)
    mixed = np.random.default_rng(1).permutation(labels)
    model = tx.ToxicityModel().fit(texts, mixed, 0.25)
    assert model.slope >= 0 and abs(probability(model, "") - 0.25) < 0.1
