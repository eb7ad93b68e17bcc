"""The pipeline's near-dedup against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reminis.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def shingle_set(text):
    found = (text or "").lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def brute_force(texts):
    """The component's smallest id of each id, and the linked pairs."""
    sets, inverted, shared = {i: shingle_set(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            inverted[s].append(i)
    for found in inverted.values():
        shared.update(combinations(found, 2))
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in texts}
    for _ in texts:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return root, links


@pytest.mark.parametrize("hot", [1024, 8])
def test_planted_near_copies_are_dropped(spark, hot):
    """Copies with changed words at similarities around 0.8; recall of the pairs is 1 by components."""
    r = np.random.default_rng(3)
    texts, most = {}, 0
    for k in range(80):
        base = [f"w{x}" for x in r.integers(0, 3000, int(r.integers(30, 200)))]
        texts[100 * k] = " ".join(base)
        for c in range(30 if k == 0 else 3):
            own = list(base)
            for at in r.integers(0, len(own), int(r.integers(1, 1 + max(2, len(own) // 30)))):
                own[at] = f"n{k}{c}{at}"
            texts[100 * k + c + 1] = " ".join(own)
    root, links = brute_force(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    sets, roots = near_copies.components(frame, hot=hot)
    group = {x.node: x.root for x in roots.collect()}
    named = {x.least: group.get(x.fp, x.fp) for x in sets.collect()}
    found = sum(named[a] == named[b] for a, b in links if a in named and b in named)
    assert len(links) > 200 and found == sum(a in named and b in named for a, b in links)
    assert {x.doc_id for x in near_copies.drop_near_copies(frame).collect()} == set(root.values())


def test_near_dedup_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    root, _ = brute_force({x.doc_id: x.text for x in docs.collect()})
    assert {x.doc_id for x in near_copies.drop_near_copies(docs).collect()} == set(root.values())


def test_survivors_are_told_apart_by_component(spark):
    """Rows of one id with unlinked texts both stay, and a null id takes no real document's place."""
    long_ = " ".join(f"a{i}" for i in range(40))
    rows = [(1, long_, "a"), (7, long_, "b"), (7, "quite another text of its own here", "c"), (7, "a third one that nothing else resembles", "d")]
    rows += [(42, "the real document of this id", "e"), (None, None, "f"), (None, "no id but a text of its own", "g")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.lang for x in kept) == ["a", "c", "d", "e", "f", "g"]


def test_a_crowd_ships_each_set_a_bounded_number_of_times(spark):
    """10,000 variants of one page, each with another word in one of 60 places, are one group; a few texts of the same bucket
    that are linked to none meet all the others."""
    words = [F.lit(f"w{i}") for i in range(60)]
    place = F.pmod(F.col("id"), F.lit(60))
    text = F.concat_ws(" ", *[F.when(place == i, F.concat(F.lit("n"), "id")).otherwise(w) for i, w in enumerate(words)])
    pages = spark.range(10000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("x").alias("lang"))
    assert [x.doc_id for x in near_copies.drop_near_copies(pages).collect()] == [0]
    members = spark.range(10000).select(F.lit(7).cast("long").alias("g"), F.lit(10000).cast("long").alias("n"), F.col("id").alias("fp"))
    once = near_copies.dealt_once(members, 1024)
    shipped = {x["fp"]: x["count"] for x in once.groupBy("fp").count().collect()}
    assert shipped.pop(0) == 10 and len(shipped) == 9999 and set(shipped.values()) == {1}
    assert once.groupBy("bucket").count().agg(F.max("count")).first()[0] < 1250
    linked = spark.range(1, 10000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    assert near_copies.dealt_rest(members, linked, 1024).isEmpty()
    rest = near_copies.dealt_rest(members, linked.where("node < 9995"), 1024)
    shipped = {x["fp"]: x["count"] for x in rest.groupBy("fp").count().collect()}
    assert {shipped[i] for i in range(9995)} == {1} and {shipped[i] for i in range(9995, 10000)} == {11}
    meet = rest.alias("a").join(rest.alias("b"), "bucket").where("a.fp < b.fp and a.comp != b.comp").select("a.fp", F.col("b.fp").alias("other")).distinct()
    assert meet.count() == 5 * 9995 + 10


def test_members_that_a_crowd_left_over_are_linked(spark):
    """Chains across chunks: texts that resemble only one or two others of a crowd are found in the second pass."""
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join([f"v{i}-{j}" if i // 3 * 8 <= j < i // 3 * 8 + 12 else w for j, w in enumerate(base)]) for i in range(66)}
    root, links = brute_force(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    for hot in (2, 5):
        sets, roots = near_copies.components(frame, hot=hot)
        group, least = {x.node: x.root for x in roots.collect()}, {x.fp: x.least for x in sets.collect()}
        named = {i: group.get(fp, fp) for fp, i in least.items()}
        assert len(links) > 30 and all(named[a] == named[b] for a, b in links) and len(set(named.values())) == len(set(root.values()))
