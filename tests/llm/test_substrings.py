"""Removal of repeated windows against a plain version."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from reminis.llm import substrings

SCHEMA = "doc_id long, text string, kept string"


def plain(rows, size):
    """(doc_id, n_words, removed intervals, kept text) by a dictionary of windows; rows are in order."""
    seen, out = set(), []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        spans, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        out.append((doc, len(words), spans, " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def found(spark, rows, size):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(5)
    return [(x.doc_id, x.n_words, [tuple(s) for s in x.removed], x.kept) for x in substrings.without_repeats(docs, size).collect()]


def made(seed, n=60):
    r = random.Random(seed)
    shared = [[f"w{r.randrange(9)}" for _ in range(r.randint(4, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(shared) if r.random() < 0.6 else [f"é{r.randrange(40)}" for _ in range(r.randint(1, 12))]
        rows.append((i * 3 - 20, r.choice([" ", "\n", "\t \x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("unit_bytes", [1 << 20, 300])
def test_removal_equals_a_plain_version(spark, monkeypatch, unit_bytes):
    monkeypatch.setattr(substrings, "UNIT_BYTES", unit_bytes)
    rows = made(unit_bytes)
    assert sorted(found(spark, rows, 5)) == plain(rows, 5)


def test_edge_cases(spark, monkeypatch):
    """Null ids and texts, short and repeated texts, one text that repeats itself, very long ones, one hot id."""
    assert found(spark, [], 4) == []
    rows = [(None, "a b c d"), (0, "a b c d e"), (1, None), (2, ""), (3, "a b c"), (4, " \t"), (5, "x y z w " * 50), (6, " a b c d")]
    assert sorted(found(spark, rows, 4), key=str) == sorted(plain(rows, 4), key=str)
    r = random.Random(3)
    long = " ".join(f"v{r.randrange(30000)}" for _ in range(200_000))
    got = {x[0]: x for x in found(spark, [(1, long), (2, long), (3, long[: len(long) // 2])], 20)}
    assert got[1][3] == long and got[2][2] == [(0, 200_000)] and got[2][3] == "" and len(got[3][2]) == 1
    monkeypatch.setattr(substrings, "UNIT_BYTES", 200)
    rows = [(7, "p q r s t u")] * 150 + [(1, "p q r s"), (9, "q r s t")]
    got = found(spark, rows, 4)
    assert [x[2] for x in got if x[0] == 1] == [[]] and [x[2] for x in got if x[0] == 9] == [[(0, 4)]]
    seven = [x for x in got if x[0] == 7]
    assert len(seven) == 150 and sorted(x[3] for x in seven)[-1] == "t u" and sum(x[3] == "" for x in seven) == 149


def test_one_polynomial_tells_orders_and_repeats_apart():
    words = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for base in substrings.BASES:
        doubled = substrings.window_values(np.concatenate([words, words]), base, 8)
        assert doubled[0] == doubled[8] and len(set(doubled[:8].tolist())) == 8
        assert substrings.window_values(words[:5], base, 8).shape == (0,)


def test_query_equals_sql(spark, sf):
    got = substrings.op12_substring_dedup(spark, sf)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = con.sql(f"select {', '.join(columns)} from ({substrings.ORACLE_SQL['op12_substring_dedup']})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(expected)
    rows = con.sql("select doc_id, text from documents order by doc_id").fetchall()
    by_hand = {(d, n, sum(b - a for a, b in s), hashlib.sha256(k.encode()).hexdigest()) for d, n, s, k in plain(rows, 20)}
    assert {(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()} == by_hand
