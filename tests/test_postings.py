"""Searches from the stored index against searches that read the facts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reminis.operators import postings as ps
from reminis.operators import retrieval as rt
from reminis.operators import store as st
from reminis.sources.tables import FACTS, VECTORS, evolve
from reminis.sources.versions import Versions

NOW = datetime(2026, 1, 1)
SHAPE = "fact_id long, user_id string, content string, decay_rate string, source_session_id string, created_at timestamp_ntz, vec_rowid long"


def made(spark, n, seed, first=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(first, first + n):
        text = " ".join(r.choices(words, [1 / (k + 1) for k in range(40)], k=r.randint(0, 25)))
        age = r.choice([0, 0, 3, 3, 3, r.random() * 400])  # many facts of one instant
        created = NOW - timedelta(days=age) if r.random() < 0.97 else None
        rows.append((i, f"u{i % 3}", text if r.random() < 0.97 else None, r.choice(["slow", "medium", "fast", "other", None]), "s", created, i if i % 4 == 0 else None))
    return evolve(spark.createDataFrame(rows, SHAPE))


@pytest.fixture(scope="module")
def facts(spark):
    return made(spark, 900, 1).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(2)
    return spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(0, 1200, 4)], VECTORS).cache()


@pytest.fixture(scope="module")
def queries(spark):
    texts = ["w0 w5 w39", "w1 w1 w30 latest", "nothing known", "", None, "w2 history", "w0 w1 w2 w3 w4 w5 w6"]
    rows = [(i, f"u{i % 4}", t, [1.0, 0.2 * i, -0.5, 0.1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, user_id string, text string, embedding array<float>")


def rows_of(found):
    return sorted((r.query_id, r["rank"], r.fact_id, r.final_score) for r in found.collect())


def both(index, facts, vectors, queries, deleted=None, limit=10):
    now = facts if deleted is None else st.soft_delete(facts, deleted.withColumn("at", F.lit(NOW).cast("timestamp_ntz")))
    assert rows_of(ps.hybrid_search(index, now, vectors, queries, limit, NOW, deleted)) == rows_of(rt.hybrid_search(now, vectors, queries, limit, NOW))
    found = rows_of(ps.bm25_only_search(index, now, queries, limit, NOW, deleted))
    assert found and found == rows_of(rt.bm25_only_search(now, queries, limit, NOW))


@pytest.mark.parametrize("few_hits", [200_000, 0])
def test_index_search_equals_scan(spark, facts, vectors, queries, tmp_path, monkeypatch, few_hits):
    monkeypatch.setattr(ps, "FEW_HITS", few_hits)
    monkeypatch.setattr(ps, "TASK_FACTS", 70)
    monkeypatch.setattr(ps, "BUCKET_FACTS", 200)
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    assert index.buckets == 4 and ps.KeywordIndex.open(spark, str(tmp_path)).segments == index.segments
    monkeypatch.setattr(rt, "POOL", 15 if few_hits else 100)
    both(index, facts, vectors, queries, limit=3 if few_hits else 10)


def test_many_queries_are_joined(spark, facts, vectors, queries, tmp_path, monkeypatch):
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    few = rows_of(ps.hybrid_search(index, facts, vectors, queries, 5, NOW)), rows_of(ps.bm25_only_search(index, facts, queries, 5, NOW))
    monkeypatch.setattr(rt, "SMALL_QUERIES", 2)
    assert (rows_of(ps.hybrid_search(index, facts, vectors, queries, 5, NOW)), rows_of(ps.bm25_only_search(index, facts, queries, 5, NOW))) == few


def test_segments_deletions_and_compaction(spark, facts, vectors, queries, tmp_path):
    """Reads are the same with a segment more, with facts deleted since, and after both were merged; older versions stay."""
    first = ps.KeywordIndex.build(facts, str(tmp_path))
    more = made(spark, 120, 7, first=900)
    second = first.add(more)
    whole = facts.unionByName(more)
    deleted = whole.where("fact_id % 7 = 2 or fact_id in (900, 903)").select("user_id", "fact_id")
    both(second, whole, vectors, queries, deleted)
    third = second.compact(deleted)
    assert len(second.segments) == 2 and len(third.segments) == 1
    left = whole.join(deleted, ["user_id", "fact_id"], "left_anti").select(whole.columns)
    assert third.clean(None) and third.docs.count() == left.count()
    both(third, left, vectors, queries)
    both(first, facts, vectors, queries)
    with pytest.raises(RuntimeError):
        second.add(more)  # version 3 is there already


def test_an_empty_index(spark, facts, vectors, queries, tmp_path):
    none = facts.limit(0)
    index = ps.KeywordIndex.build(none, str(tmp_path))
    assert ps.hybrid_search(index, none, vectors, queries, 5, NOW).count() == 0 and ps.bm25_only_search(index, none, queries, 5, NOW).count() == 0


def test_no_fact_is_tokenised(spark, facts, vectors, queries, tmp_path):
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    asked = ps.Asked.of(index, queries)
    near = rt.vector_rank(facts, vectors, asked.queries, 50).select("query_id", "user_id", "fact_id", "rank")
    plan = ps.pool(asked, near, 110, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "terms" not in plan


def test_blocks_that_cannot_win_are_skipped(spark, tmp_path):
    rows = [(i, "u", "common " + ("rare " * 5 if i % 1000 == 7 else "") + "x " * (i % 60), "slow", "s", NOW - timedelta(minutes=i), None) for i in range(20_000)]
    facts = evolve(spark.createDataFrame(rows, SHAPE))
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    query = spark.createDataFrame([(0, "u", "common rare", [1.0])], "query_id long, user_id string, text string, embedding array<float>")
    asked = ps.Asked.of(index, query)
    heads = asked.rows(index.heads)
    blocks, read = heads.select("block").distinct().count(), ps.chosen_blocks(heads, asked.terms, 5).count()
    assert blocks == -(-20_000 // ps.BLOCK) and 5 <= read <= 25
    assert rows_of(ps.bm25_only_search(index, facts, query, 5, NOW)) == rows_of(rt.bm25_only_search(facts, query, 5, NOW))


def test_versions(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.current() == (0, {})
    assert versions.publish(1, {"a": "é"}) and not versions.publish(1, {"a": 2}) and versions.publish(2, {"b": [1]})
    assert versions.current() == (2, {"b": [1]})


def test_terms_are_counted_as_tokens_are(spark, facts):
    stored = {r.fact_id: r for r in ps.with_terms(facts).collect()}
    for r in rt.tokens_of(facts).collect():
        tokens = r.tokens or []
        assert stored[r.fact_id].dl == len(tokens) and {t.term: t.tf for t in stored[r.fact_id].terms} == {t: tokens.count(t) for t in tokens}
    assert FACTS is not None


def test_terms_pass_no_sort_and_no_window(spark, facts, tmp_path):
    """What one task holds to number facts and to make postings doesn't grow with the texts."""
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    assert "terms" not in index.docs.columns
    plan = ps.postings_of(index._table("terms"), index.docs, 4, 900)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "Sort " not in plan and "Window" not in plan
    # facts of one id, of which each has a row
    twice = ps.KeywordIndex.build(facts.unionByName(facts.where("fact_id < 30")), str(tmp_path))
    terms = ps.with_terms(facts)
    expected = terms.selectExpr("sum(if(fact_id < 30, 2, 1) * size(terms))").first()[0]
    assert twice.postings.count() == expected and twice.docs.count() == index.docs.count() + terms.where("fact_id < 30").count()


def test_tasks_of_the_build_grow_with_the_facts(spark, facts, tmp_path, monkeypatch):
    """Numbering facts and counting heads are dealt to as many tasks as there are facts and entries for, not to as many as the session
    shuffles with, and places and heads are whole."""
    monkeypatch.setattr(ps, "TASK_FACTS", 70)
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    plan = ps.heads_of(index.postings, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning(bucket" in plan and ", 9), REPARTITION_BY_NUM" in plan
    files, stored = len(index.postings.inputFiles()), f"{tmp_path}/postings/seg=1"
    assert ps.by_files(spark, stored, index.postings.drop("seg").schema, 1).rdd.getNumPartitions() <= files
    plan = ps.postings_of(index._table("terms"), index.docs, 1, 900, 17 * ps.TASK_ENTRIES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 17), REPARTITION_BY_NUM") == 2
    heads = {(r.user_id, r.term, r.block): (r.n, r.max_tf, r.min_dl, r.best) for r in index.heads.collect()}
    expected = {}
    for r in index.postings.collect():
        expected.setdefault((r.user_id, r.term, r.block), []).append((r.tf, r.dl))
    assert heads == {k: (len(v), max(t for t, _ in v), min(d for _, d in v), max((t << 32) + 2**31 - d for t, d in v)) for k, v in expected.items()}

    rows = ps.spread(ps.with_terms(facts).drop("terms"), str(tmp_path / "ranges"), 900)
    found = ps.placed(rows, "part", tasks=13)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 13), REPARTITION_BY_NUM") == 1 and plan.count("Window [row_number()") == 2
    places = sorted((r.user_id, r.pos, r.created_at or datetime.min, r.fact_id, r.rate, r.pos_rate) for r in found.collect())
    whole, of_rate = {}, {}
    for user, pos, at, fact, rate, pos_rate in sorted(places, key=lambda p: (p[0], -(p[2] - datetime.min).total_seconds(), p[3])):
        assert pos == whole.setdefault(user, 0) and pos_rate == of_rate.setdefault((user, rate), 0)
        whole[user] += 1
        of_rate[user, rate] += 1
    assert len(places) == rt.live(facts).count()


def ranks_of(found, key="rank"):
    return {(r.query_id, r.fact_id): r[key] for r in found.collect()}


@pytest.mark.parametrize("few_hits", [200_000, 0])
def test_ranks_after_deletions_and_in_segments(spark, facts, vectors, queries, tmp_path, monkeypatch, few_hits):
    """Places that are stored in a segment don't count where they were counted anew: keyword ranks are those of a scan."""
    monkeypatch.setattr(ps, "FEW_HITS", few_hits)
    more = made(spark, 120, 7, first=900)
    index = ps.KeywordIndex.build(facts, str(tmp_path)).add(more)
    whole = facts.unionByName(more)
    deleted = whole.where("fact_id % 7 = 2 or fact_id in (900, 903)").select("user_id", "fact_id")
    left = whole.join(deleted, ["user_id", "fact_id"], "left_anti").select(whole.columns)
    asked = ps.Asked.of(index, queries, deleted)
    near = rt.vector_rank(left, vectors, asked.queries, 50).select("query_id", "user_id", "fact_id", "rank")
    found, scanned = ranks_of(asked.candidates(near, 40), "bm25_rank"), ranks_of(rt.bm25_rank(rt.tokens_of(left), queries))
    assert len(found) > 300 and found == {key: scanned[key] for key in found}


def test_hits_of_one_score_are_not_one_group(spark, tmp_path, monkeypatch):
    """Facts of one text have one score; their ranks are found in ranges of places, and are those of a scan."""
    monkeypatch.setattr(ps, "FEW_HITS", 0)
    monkeypatch.setattr(ps, "TASK_FACTS", 50)
    rows = [(i, "u", "alpha beta" if i % 4 else "gamma beta delta", "slow", "s", NOW - timedelta(minutes=i // 3), None) for i in range(2_000)]
    facts = evolve(spark.createDataFrame(rows, SHAPE))
    index = ps.KeywordIndex.build(facts, str(tmp_path))
    query = spark.createDataFrame([(0, "u", "alpha beta", [1.0]), (1, "u", "gamma", [1.0])], "query_id long, user_id string, text string, embedding array<float>")
    asked = ps.Asked.of(index, query)
    near = spark.createDataFrame([(0, "u", 8, 1)], "query_id long, user_id string, fact_id long, rank long")
    found = asked.candidates(near, 10)
    assert (ranks := ranks_of(found, "bm25_rank")) and len(ranks) >= 2_500
    scanned = ranks_of(rt.bm25_rank(rt.tokens_of(facts), query))
    assert ranks == {key: scanned[key] for key in ranks}
    numbered = ps.dealt(asked.hits()).groupBy("query_id").agg(F.max("nth").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.query_id: r.n for r in numbered} == {0: 2_000, 1: 500} and max(r.most for r in numbered) <= 50
