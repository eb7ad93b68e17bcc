"""Lists of vectors by centroid: recall of probing, and exactness of bounds."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reminis.operators import lists as ls
from reminis.operators import retrieval as rt
from reminis.operators.ranking import top
from reminis.sources import tables as tb

NOW = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def vectors(spark):
    return tb.vectors(spark, "/root/testdata/sf0.1").cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return ls.VectorLists.build(vectors, str(tmp_path_factory.mktemp("lists")))


def test_every_vector_is_in_one_list(spark, vectors, index):
    stored = index.vectors()
    assert stored.count() == vectors.count() == stored.select("vec_id").distinct().count()
    assert stored.select("list").distinct().count() > 20
    again = ls.VectorLists.open(spark, index.path)
    assert (again.centres == index.centres).all() and (again.longest == index.longest).all()


def test_recall_and_pruning(vectors, index):
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("u").alias("user_id"), "embedding")
    found = ls.search(index, asked, 10, probes=24)
    exact = top(rt.distances(vectors, asked), ["query_id"], [F.asc("distance"), F.asc("vec_id")], 10, "rank").select("query_id", "vec_id").collect()
    hits = {(r.query_id, r.vec_id) for r in found.collect()} & {tuple(r) for r in exact}
    assert len(hits) >= 0.9 * len(exact)
    one = ls.search(index, asked.where("query_id = 50"), 10, probes=3)
    scan = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert re.match(r"list#\d+ IN \(\d+,\d+,\d+\)", scan), scan[:80]


def same(index, facts, vectors, queries, k):
    owners = rt.live(facts).where("vec_rowid is not null").select("user_id", "fact_id", F.col("vec_rowid").alias("vec_id"))
    columns = ["query_id", "user_id", "fact_id", "rank", "distance"]
    got = sorted(map(repr, map(tuple, ls.exact(index, owners, queries, k).select(columns).collect())))
    assert got == sorted(map(repr, map(tuple, rt.vector_rank(facts, vectors, queries, k).select(columns).collect())))
    return owners


def test_bounds_give_the_exact_ranks(spark, vectors, index, monkeypatch):
    facts = tb.facts(spark, "/root/testdata/sf0.1")
    queries = tb.queries(spark, "/root/testdata/sf0.1", items=12).withColumn("user_id", F.concat(F.lit("u"), F.col("query_id") % 4))
    owners = same(index, facts, vectors, queries, 20)
    local, _ = rt.at_hand(queries)
    pairs = ls.compared(index, owners, local, 20, 4, True).count()
    assert pairs < rt.distances(rt.embedded(facts, vectors), local).count()
    monkeypatch.setattr(rt, "SMALL_QUERIES", 3)
    same(index, facts, vectors, queries, 20)


def test_clusters_are_hardly_compared(spark, tmp_path):
    """Where vectors lie in clusters, a small share of them is compared."""
    rows = spark.range(4000).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.sin(F.col("id") % 40 * (i + 1.7)) + F.sin(F.col("id") * (i + 1)) / 200).cast("float")).alias("embedding")
    )
    index = ls.VectorLists.build(rows, str(tmp_path), lists=40)
    owners = rows.select(F.lit("u").alias("user_id"), F.col("vec_id").alias("fact_id"), "vec_id")
    queries = rows.where("vec_id in (3, 777)").select(F.col("vec_id").alias("query_id"), F.lit("u").alias("user_id"), F.lit("").alias("text"), "embedding")
    assert ls.compared(index, owners, rt.at_hand(queries)[0], 10, 2, True).count() < 0.1 * 2 * 4000
    facts = owners.select("user_id", "fact_id", F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.col("vec_id").alias("vec_rowid"))
    same(index, facts, rows, queries, 10)


def test_vectors_without_a_direction_come_last(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8]), (5, [-1.0, 0.1])], tb.VECTORS)
    index = ls.VectorLists.build(rows, str(tmp_path), lists=2)
    facts = rows.select(F.lit("u").alias("user_id"), F.col("vec_id").alias("fact_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.col("vec_id").alias("vec_rowid"))
    queries = spark.createDataFrame([(0, "u", "", [1.0, 0.0]), (1, "u", "", [0.0, 0.0]), (2, "u", "", None), (3, "nobody", "", [1.0, 1.0])], "query_id long, user_id string, text string, embedding array<float>")
    for k in (2, 4, 10):
        same(index, facts, rows, queries, k)
    empty = ls.VectorLists.build(rows.limit(0), str(tmp_path))
    assert ls.search(empty, queries, 5, 2).count() == 0 and ls.exact(empty, facts.select("user_id", "fact_id", F.col("vec_rowid").alias("vec_id")), queries, 3).count() == 0
