"""Periodic runs against comparing all stretches."""

import hashlib
import random
import re
import time
import zlib

from reminis.llm import periodic


def stretches(words, least=6, periods=4):
    """(start, length, period) of every run, by looking at each period; a run of a multiple of its period is none."""
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            end = i + q
            inside = any(s <= start and end <= s + m and q % p == 0 for s, m, p in out)
            if i > start and end - start >= max(least, periods * q) and not inside:
                out.append((start, end - start, q))
            i += 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(4000):
        n, letters = r.randint(0, 40), r.choice([1, 2, 2, 3, 4])
        words = [r.randrange(letters) for _ in range(n)]
        if n > 8 and r.random() < 0.5:
            a, p = r.randrange(n), 1 + r.randrange(n // 5 + 1)
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        for least, periods in ((6, 4), (2, 2), (5, 3)):
            assert periodic.runs_of(words, letters - 1, least, periods) == stretches(words, least, periods)


def test_time_is_near_linear_where_everything_repeats():
    fib, old = [0, 1], [0]
    while len(fib) < 60_000:
        fib, old = fib + old, fib
    n = 60_000
    for words in ([0] * n, [0, 1] * (n // 2) + [2], fib[:n], ([0] * 300 + [1]) * (n // 301), [bin(i).count("1") & 1 for i in range(n)]):
        began = time.process_time()
        periodic.runs_of(words, max(words))
        assert time.process_time() - began < 5


def by_hand(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = stretches(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (
        doc, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path):
    tenth = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(r.randint(0, 120)))) for i in range(60)]
    rows += [(i, "\n".join(r.choice("aé b c".split()) for _ in range(r.randint(1, 90)))) for i in tenth]
    rows += [(None, "a b " * 9), (None, None), (500, None), (501, ""), (502, " \t\n"), (503, "x"), (504, "x y " * 3), (505, "la " * 70)]
    rows += [(505, "la " * 70), (tenth[0], None), (tenth[1], ""), (600, "long word " * 30_000)]
    path = str(tmp_path)
    spark.createDataFrame([(*row, "clash") for row in rows], "doc_id long, text string, runs string").write.parquet(f"{path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.op13_periodic_runs(spark, path).select(names)
    assert set(dict(got.dtypes).values()) == {"bigint", "string"}
    expected = [by_hand(*row) for row in rows[:-1]]
    long = [x for x in got.collect() if x.doc_id == 600]
    assert (long[0].n_runs, long[0].length, long[0].period) == (1, 60_000, 2) if zlib.crc32(b"600") % 10 else long[0].n_runs
    assert sorted(repr(tuple(x)) for x in got.collect() if x.doc_id != 600) == sorted(map(repr, expected))


def test_runs_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b a c"), (2, None)], "doc_id long, text string")
    found = {x.doc_id: x for x in periodic.runs(docs).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 9, 2)] and found[1].collapsed == "a b c" and found[2].collapsed == "" and found[2].runs == []
    assert periodic.runs(docs.where("doc_id > 5")).count() == 0
