"""Ranking on four hand-checked facts, and its edge cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reminis.operators import retrieval as rt
from reminis.operators import store as st
from reminis.operators.ranking import ranked
from reminis.sources.tables import FACTS, VECTORS, evolve

NOW = datetime(2026, 1, 1)
ROWS = [
    (1, "User prefers dark mode", "slow", 0, [1.0, 0.0]),
    (2, "User prefers TypeScript over JavaScript", "medium", 10, [0.6, 0.8]),
    (3, "Dark chocolate is a favourite", "fast", 30, [0.0, 1.0]),
    (4, "Deploy target is us-east-1", "slow", 400, None),
]
GOLDEN = {
    "dark mode": [(1, 0.390323), (3, 0.154290), (2, 0.052267), (4, 0.005573)],
    "what is the current dark mode": [(1, 0.290323), (3, 0.119228), (2, 0.052267), (4, 0.0)],
    "dark mode history": [(1, 0.290323), (3, 0.186174), (2, 0.086174), (4, 0.041176)],
    "is it the": [(1, 0.129032), (2, 0.075816), (4, 0.007961), (3, 0.006035)],
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(i, "u", text, rate, "s", NOW - timedelta(days=age), i if vector else None) for i, text, rate, age, vector in ROWS]
    return evolve(spark.createDataFrame(rows, "fact_id long, user_id string, content string, decay_rate string, source_session_id string, created_at timestamp_ntz, vec_rowid long"))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, vector) for i, *_, vector in ROWS if vector], VECTORS)


def query(spark, text, vector=(1.0, 0.0), user="u"):
    return spark.createDataFrame([(0, user, text, list(vector))], "query_id long, user_id string, text string, embedding array<float>")


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(spark, facts, vectors, text):
    found = rt.hybrid_search(facts, vectors, query(spark, text), 10, NOW).orderBy("rank").collect()
    assert [(r.fact_id, round(r.final_score, 6)) for r in found] == GOLDEN[text]


def test_keywords_alone(spark, facts, vectors):
    bare = facts.withColumn("vec_rowid", F.lit(None).cast("long"))
    found = rt.search(bare, vectors, query(spark, "dark mode"), 10, NOW).orderBy("rank").collect()
    assert [(r.fact_id, round(r.final_score, 6)) for r in found] == [(1, 3.683728), (3, 0.075846), (2, 0.0), (4, 0.0)]
    assert rt.search(facts, vectors, query(spark, "dark mode"), 2, NOW).count() == 2


def test_deleted_and_foreign_facts_stay_out(spark, facts, vectors):
    at = spark.createDataFrame([("u", 1, NOW), ("someone", 3, NOW), ("u", 99, NOW)], "user_id string, fact_id long, at timestamp_ntz")
    gone = st.soft_delete(facts, at)
    assert {r.fact_id for r in rt.hybrid_search(gone, vectors, query(spark, "dark"), 10, NOW).collect()} == {2, 3, 4}
    assert rt.search(facts, vectors, query(spark, "dark", user="nobody"), 10, NOW).count() == 0


def test_zero_query_vector_ranks_by_id(spark, facts, vectors):
    found = rt.vector_rank(facts, vectors, query(spark, "x", (0.0, 0.0)), 10).orderBy("rank").collect()
    assert [r.fact_id for r in found] == [1, 2, 3]


def test_ranks_over_buckets_equal_plain_ranks(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 50).cast("double").alias("x"), "id")
    found = ranked(df, ["g"], {"__b": F.floor(F.col("x") / 7)}, [F.desc("x"), F.asc("id")], "r").collect()
    for g in range(3):
        rows = sorted((r for r in found if r.g == g), key=lambda r: r.r)
        assert [r.r for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.x, r.id) for r in rows] == sorted(((r.x, r.id) for r in rows), key=lambda k: (-k[0], k[1]))


def test_ingest_defaults_and_evolution(spark):
    new = spark.createDataFrame([(1, "u", "text", "s")], "fact_id long, user_id string, content string, source_session_id string")
    row = st.ingest(new, NOW).first()
    assert (row.confidence, row.decay_rate, row.embed_status, row.created_at, row.deleted_at) == (0.95, "slow", "pending", NOW, None)
    assert [(f.name, f.dataType) for f in evolve(new).schema] == [(f.name, f.dataType) for f in FACTS]
    assert evolve(new).first().confidence == 0.9


def test_ann_finds_near_vectors(spark, sf):
    from reminis.operators import ann
    from reminis.sources import tables as tb

    queries = tb.queries(spark, sf, items=20)
    near = ann.search(tb.vectors(spark, sf), queries, 10)
    exact = rt.top(rt.distances(tb.vectors(spark, sf), queries), ["query_id"], [F.asc("distance"), F.asc("vec_id")], 10, "rank")
    hits = near.join(exact, ["query_id", "vec_id"], "left_semi").count()
    assert hits >= 0.9 * exact.count()


def test_registered_ann_asks_every_fiftieth_vector(spark, sf):
    from reminis.plans import catalog
    from reminis.sources import tables as tb

    vectors = tb.vectors(spark, sf)
    near = catalog.ann_lsh(spark, sf).select("query_id", "vec_id").collect()
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("u").alias("user_id"), "embedding")
    exact = rt.top(rt.distances(vectors, asked), ["query_id"], [F.asc("distance"), F.asc("vec_id")], 10, "rank").collect()
    assert {r.query_id for r in near} == {r.query_id for r in asked.collect()}
    assert len({tuple(r) for r in near} & {(r.query_id, r.vec_id) for r in exact}) >= 0.9 * len(exact)


def test_few_queries_are_a_local_table_and_many_are_not(spark, monkeypatch):
    asked = query(spark, "dark mode").union(query(spark, None))
    local, bounded = rt.at_hand(asked)
    assert bounded and local.schema == asked.schema and sorted(map(repr, local.collect())) == sorted(map(repr, asked.collect()))
    assert rt.at_hand(asked.limit(0))[0].count() == 0
    monkeypatch.setattr(rt, "SMALL_QUERIES", 1)
    same, bounded = rt.at_hand(asked)
    assert same is asked and not bounded


def test_many_queries_find_what_few_find(spark, facts, vectors, monkeypatch):
    few = rt.hybrid_search(facts, vectors, query(spark, "dark mode"), 10, NOW).orderBy("rank").collect()
    monkeypatch.setattr(rt, "SMALL_QUERIES", 0)
    many = rt.hybrid_search(facts, vectors, query(spark, "dark mode"), 10, NOW).orderBy("rank").collect()
    assert few and few == many
