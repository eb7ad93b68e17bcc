"""Operators over whole tables against brute force and held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reminis.llm import near_copies, perspectives, quality, simhash, toxicity, url_rules
from reminis.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


def fingerprint(text):
    found = words(text)
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def roots_of(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# --- SimHash -----------------------------------------------------------------------------------------------


def test_fingerprints_and_components(spark):
    r = np.random.default_rng(2)
    base = [f"w{i}" for i in r.integers(0, 400, 500)]
    texts = {i: " ".join(f"v{x}" for x in r.integers(0, 9000, r.integers(1, 40))) for i in range(10, 60)}
    for i in range(100, 130):  # a chain of near copies
        base[int(r.integers(0, 500))] = f"n{i}"
        texts[i] = " ".join(base)
    texts |= {1: None, 2: "", 3: " \n\t", 4: "One Two", 5: "one two", 6: texts[10], 7: "x " * 600}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(6, texts[6], "y"), (None, "one two", "z")], SCHEMA)
    prints = {i: fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = roots_of(texts, links)
    rows = simhash.components(docs).collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        if x.doc_id is not None:
            assert x.fp & (1 << 64) - 1 == prints[x.doc_id] and x.component_id == expected[x.doc_id]
        else:
            assert x.component_id == 4
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect() if x.doc_id is not None} <= set(expected.values())
    assert simhash.components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "same text here now", "a"), (3, "same text here now", "b"), (3, "same text here now", "b"), (8, "another one altogether", "c"), (None, "lonely words", None)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == [("3", "same text here now"), ("8", "another one altogether"), ("None", "lonely words")]


@pytest.mark.parametrize("hot", [2048, 10])
def test_index_equals_brute_force(spark, hot):
    r = np.random.default_rng(4)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = set()
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for j in r.integers(0, 64, r.integers(0, 7)):
                x ^= 1 << int(j)
            codes.add(x)
    codes = sorted(codes)
    links = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 4]
    expected = Counter(roots_of(codes, links).values())
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    found = simhash.near_components(spark.createDataFrame([(c,) for c in signed], "fp long"), hot=hot).collect()
    groups = Counter(x.root for x in found)
    assert sorted(n - 1 for n in expected.values() if n > 1) == sorted(groups.values())
    arranged = np.array(codes, np.uint64)
    order = np.argsort(simhash.gray_rank(arranged))
    i, j = simhash.GrayIndex(arranged[order]).later_links(0, len(codes), 4)
    assert {frozenset((int(arranged[order][a]), int(arranged[order][b]))) for a, b in zip(i, j)} == {frozenset(p) for p in links}


def test_one_index_over_many_buckets():
    """Links within buckets alone, each of any size; whole groups are pruned."""
    r = np.random.default_rng(9)
    centres = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    group = np.sort(np.concatenate([np.arange(500), np.repeat(np.arange(500, 520), r.integers(2, 300, 20))]))
    codes = centres[r.integers(0, 40, len(group))]
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << r.integers(0, 64, len(codes)).astype(np.uint64))
    order = np.lexsort((simhash.gray_rank(codes), group))
    group, codes = group[order], codes[order]
    index = simhash.GrayIndex(codes, group)
    found = {(int(a), int(b)) for first, last in index.batches(3000) for a, b in zip(*index.later_links(first, last, 4))}
    pairs = [(a, b) for x in range(520) for own in [np.flatnonzero(group == x)] for k, a in enumerate(own.tolist()) for b in own[k + 1 :].tolist()]
    assert found == {(a, b) for a, b in pairs if (int(codes[a]) ^ int(codes[b])).bit_count() <= 4}
    every = simhash.GrayIndex(codes, group)
    for first, last in every.batches():
        every.later_links(first, last, 64)
    assert found and 0 < index.visited < every.visited


def test_the_index_finds_the_links_of_a_table(spark, monkeypatch):
    """On a whole table all links come from the index, which looks at its nodes there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes = np.unique(np.array([x.fp for x in simhash.fingerprints(docs).collect()], np.int64).view(np.uint64))
    keys = simhash.gray_rank(codes)
    index = simhash.GrayIndex(codes[np.argsort(keys)])
    links = {(int(a), int(b)) for first, last in index.batches() for a, b in zip(*index.later_links(first, last, 4))}
    arranged = codes[np.argsort(keys)]
    expected = {(i, int(j)) for i in range(len(arranged)) for j in i + 1 + np.flatnonzero(np.bitwise_count(arranged[i] ^ arranged[i + 1 :]) <= 4)}
    assert links == expected and links and 0 < index.visited < len(codes) ** 2 // 2
    roots = {x.node & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in simhash.near_components(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")).collect()}
    by_place = roots_of(range(len(arranged)), links)
    groups = Counter(by_place.values())
    assert sorted(n for n in groups.values() if n > 1) == sorted(n + 1 for n in Counter(roots.values()).values())


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (1, 0), (1, 0)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in found} == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- classifiers -------------------------------------------------------------------------------------------


def held_out_accuracy(rows, labels):
    found = {x.doc_id: x for x in rows}
    picked = [(found[i].predicted, y) for i, y in labels.items() if found[i].held_out]
    return sum(a == b for a, b in picked) / len(picked), found


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op2_subword_quality(spark, sf).collect()
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    accuracy, found = held_out_accuracy(rows, labels)
    assert accuracy > 0.95
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for i, x in found.items())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op8_toxicity(spark, sf).collect()
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    accuracy, found = held_out_accuracy(rows, labels)
    assert accuracy > 0.9
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in found.items())


def test_classifiers_on_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "no id here", None), (3, "long " * 30000, "x"), (4, "fine words", "y")], SCHEMA)
    docs = docs.withColumn("score", F.lit("taken"))
    for labels in ([], [(3, 1, 0), (4, 1, 0)], [(3, 0, 1), (4, 1, 0), (4, 1, 0), (99, 1, 1), (None, 1, 1), (1, None, None)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for module in (quality, toxicity):
            found = module.score(docs, module.fit_on(docs, table)).collect()
            assert len(found) == 6 and all(0 <= x.score <= 1 for x in found)
            assert len({x.score for x in found if not x.text}) == 1
        if not labels:
            assert {x.score for x in found} == {0.5}
    empty = docs.limit(0)
    assert quality.score(empty, quality.SubwordClassifier()).count() == 0


# --- URLs and dialogues --------------------------------------------------------------------------------------


def judged(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(UPPER), found[2]) if found else ("", "")
    fits = []
    for verdict, rule in url_rules.RULES:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "no scheme/x", "http://a.COM", "http://a.com/", "HTTP://WWW.Example.com/en/1?q#f", "https://x.example.com/en/2", "http://example.com?x=1", "ftp://b.net/es/1", "http://net/fr/2", "http://évil.net/fr/", "a://b://c/d", "http://notexample.com/en/1", "http://x.org/en/1#t", "http:///p", "http://-.com//\n"]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://x.com/")], "page_id long, url string")
    rows = url_rules.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert len(rows) == len(URLS) + 2
    for x in rows:
        if x.page_id is not None:
            host, path, rule, verdict = judged(URLS[x.page_id])
            assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict == (verdict or "allow")
    none = url_rules.judge(pages.limit(0), spark.createDataFrame([(1, True)], "page_id long, bad boolean"))
    assert none.count() == 0


def test_mined_rules(spark):
    pages = [(i, f"http://{'win-casino' if i % 3 == 0 else 'good'}.{'a' if i % 2 else 'b'}.org/{'en' if i % 5 else 'de'}/{i}") for i in range(300)]
    labels = [(i, i % 3 == 0) for i in range(200)] + [(500, True), (7, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    rows = url_rules.judge(frame, spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    assert all(x.verdict == ("block" if x.page_id % 3 == 0 else "allow") and x.source == "mined" for x in rows)


def rules_by_counting(rows, least, sure):
    """All rules of up to every token, by counting each set of tokens; those without a shorter one that is as sure."""
    n, counts = len(rows), {}
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                counts.setdefault(items, Counter())[label] += 1
    share = Counter(label for _, label in rows)
    rules = {
        (items, label): (c / sum(by.values()), c / n) for items, by in counts.items() for label, c in by.items()
        if c >= least and c / sum(by.values()) >= sure and c / sum(by.values()) > share[label] / n
    }
    return {
        (items, label): v for (items, label), v in rules.items()
        if not any(rules.get((items[:i] + items[i + 1:], label), (0,))[0] >= v[0] for i in range(len(items)))
    }


def test_mining_equals_counting(spark):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        tokens = {f"t{x}" for x in r.integers(0, 7, 4)}
        tokens |= {"u0", "u1"} if "t0" in tokens else set()  # always with t0
        tokens |= {"w"} if r.random() < 0.2 else set()
        bad = "w" in tokens or r.random() < (0.9 if {"t1", "t2"} <= tokens else 0.5 if "t3" in tokens else 0.2)
        rows.append((sorted(tokens), "block" if bad else "allow"))
    frame = spark.createDataFrame(rows + [([], "allow")], "tokens array<string>, label string")
    rules, items = url_rules.mine(frame, 0.01, 0.6)
    together = {}
    for x in items.collect():
        together.setdefault(x.item, []).append(x.token)
    assert sorted(together["t0"]) == ["t0", "u0", "u1"]
    found = {}
    for x in rules.collect():
        assert x.anchor in x["items"]
        for tokens in itertools.product(*(together[i] for i in x["items"])):
            found[tuple(sorted(tokens)), x.label] = (x.confidence, x.support)
    told = rules_by_counting(rows + [([], "allow")], max(math.ceil(0.01 * (len(rows) + 1)), url_rules.MIN_COUNT), 0.6)
    assert (("w",), "block") in told and any(len(items) > 1 for items, _ in told)
    assert set(found) == set(told)
    for key, values in told.items():
        assert found[key] == pytest.approx(values)


def test_mining_of_many_shared_parameters(spark):
    query = "&".join(f"p{k}=1" for k in range(30))
    pages = [(i, f"http://shop{i % 2}.org/{'a' if i % 3 else 'b'}?{query}") for i in range(120)] + [(200, "http://c.org/?p7=2")]
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 10 > 0) for i in range(120)], "page_id long, bad boolean")
    rows = url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert {x.page_id: x.verdict for x in rows if x.page_id < 120} == {i: "allow" if i % 3 else "block" for i in range(120)}
    assert len(rows) == 121 and all(x.source == "mined" for x in rows if x.page_id < 120)


def test_mined_verdicts_equal_brute_force(spark):
    r = np.random.default_rng(1)
    sets = [sorted({f"t{x}" for x in r.integers(0, 12, 6)}) for _ in range(80)]
    rules = [(sorted({f"t{x}" for x in r.integers(0, 12, k % 3 + 1)}), "block" if k % 2 else "allow", 0.6 + k / 100, 0.1) for k in range(25)]
    frame = spark.createDataFrame([(i, l, c, s, i[0]) for i, l, c, s in rules], url_rules._RULE)
    asked = spark.createDataFrame([(" ".join(s), s) for s in sets], "signature string, tokens array<string>").distinct()
    found = {x.signature: x.mined for x in url_rules.mined_verdicts(asked, frame).collect()}
    for s in sets:
        fits = [(c, label) for items, label, c, _ in rules if set(items) <= set(s)]
        assert found.get(" ".join(s)) == (max(fits)[1] if fits else None)


def test_rows_of_hot_and_other_sets_get_their_verdicts(spark):
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else "plain" if i % 3 == 1 else f"s{i % 40}") for i in range(600)] + [(5, "u5", "s5")] * 2
    parsed = spark.createDataFrame(rows, "page_id long, url string, signature string")
    sets = parsed.groupBy("signature").agg(F.count(F.lit(1)).alias("pages"))
    known = {"hot": "block", **{f"s{k}": "block" if k % 4 else "allow" for k in range(20)}}  # the hot set "plain" has none
    verdicts = spark.createDataFrame(list(known.items()), "signature string, mined string")
    for hot_sets in (1, 10, 10_000):  # none, two, all
        found = url_rules.with_verdicts(parsed, sets, verdicts, hot_sets)
        assert found.columns == ["page_id", "url", "signature", "mined"]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*x, known.get(x[2]))) for x in rows)
    assert url_rules.with_verdicts(parsed.limit(0), sets.limit(0), verdicts.limit(0)).count() == 0


def test_small_tables_have_mined_rules_of_both_kinds(spark):
    """Forty labelled URLs of both classes: the rules for and against are those that eight URLs show."""
    pages = [(i, f"http://{('spam', 'news', 'mix')[i % 3]}.org/{i % 7}a/x{i}") for i in range(60)]
    labels = [(i, i % 3 == 0 or (i % 3 == 2 and i % 2 == 0)) for i in range(40)]
    extra = spark.createDataFrame(pages, "page_id long, url string").withColumn("mined", F.lit("taken")).withColumn("signature", F.lit(1))
    rows = url_rules.judge(extra, spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    assert {(x.verdict, x.source) for x in rows if x.page_id % 3 == 0} == {("block", "mined")}
    assert {(x.verdict, x.source) for x in rows if x.page_id % 3 == 1} == {("allow", "mined")}
    found = url_rules.op1_url_rules(spark, "/root/testdata/sf0.01").groupBy("source").count().collect()
    assert dict(map(tuple, found))["mined"] > 0


def test_perspectives_equal_sql(spark):
    rows = [(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", None), (1, 2, None, "who?"), (1, 2, None, "who?"), (1, 3, "system", "s"), (2, 0, "system", "alone"), (None, 5, "a b", "x"), (None, None, "user", ""), (3, 70, "user", "é" * 9), (3, 500, "bot", "y"), (4, 1, "a b", "1"), (4, 2, "a_b", "<\\|2 <\\\\| <x|"), (4, 3, "unknown", "3"), (4, 4, None, "4"), (4, 5, "é*~+%", "5"), (4, 6, "", "6")]
    rows += [(9, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]
    schema = "conv_id long, turn long, role string, text string"
    found = perspectives.rotate(spark.createDataFrame(rows, schema))
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.sql("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    expected = con.sql(f"select {', '.join(columns)} from ({perspectives.ORACLE_SQL['op7_perspectives']})").fetchall()
    got = [tuple(x) for x in found.select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    whole: dict = {}
    for x in sorted(found.collect(), key=lambda x: x.position):
        key = (x.conv_id, x.perspective)
        whole[key] = whole.get(key, "") + x.segment
    for x in found.collect():
        text = whole[x.conv_id, x.perspective]
        assert text[x.content_start : x.content_end] + "\n<|end|>\n" == x.segment[x.segment.index("\n") + 1 :]
        assert x.loss == (x.speaker == x.perspective)
    four = [x for x in found.collect() if x.conv_id == 4]
    assert len(four) == 36 and len({x.segment.split("|>")[0] for x in four if x.role == "user"}) == 6  # no two are one
    source = Counter((r[0], re.sub(r"<(\\*)\|", r"<\1\\|", r[3] or "")) for r in rows)
    assert {(x.conv_id, x.segment[x.segment.index("\n") + 1 : -9]) for x in found.collect()} <= set(source)
    assert all(re.sub(r"<(\\*)\\\|", r"<\1|", k) in {r[3] or "" for r in rows} for _, k in source)
    parts = perspectives.dialogues(found, 64).collect()
    rendered: dict = {}
    for x in sorted(parts, key=lambda x: x.part):
        rendered[x.conv_id, x.perspective] = rendered.get((x.conv_id, x.perspective), "") + x.text
        for a, b in zip(x.starts, x.ends):
            assert x.text[b:].startswith("\n<|end|>\n") and x.text[:a].endswith("<|assistant|>\n")
    assert rendered == whole
    assert perspectives.rotate(spark.createDataFrame([], schema)).count() == 0
