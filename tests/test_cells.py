"""Nearest vectors in cells against comparing all pairs, and no pair is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reminis.operators import ann, cells
from reminis.operators import lists as ls
from reminis.sources import tables as tb

SHAPE = "vec_id long, embedding array<float>, mark array<int>"


def table(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(60, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 60 if i % 3 else 7]], [i % 2, i % 5]) for i in range(600)]  # 200 copies of one vector
    return spark.createDataFrame([*rows, (600, None, [0, 0]), (601, [0.0] * 6, [0, 0]), (602, [], [0, 0])], SHAPE)


@pytest.mark.parametrize("cell", [32_768, 100])
def test_cells_find_what_all_pairs_show(spark, monkeypatch, cell):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "LEAST", cell)
    monkeypatch.setattr(cells, "BLOCK", 50)
    vectors = table(spark)
    queries = vectors.where("vec_id % 2 = 1 or vec_id >= 600").withColumnRenamed("vec_id", "query_id")
    found = cells.search(vectors, queries, lambda mark, marks: (marks == mark).any(1), 5, 6, vectors.count(), queries.count())
    rows = [r for r in vectors.collect() if r.vec_id < 600]
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    expected = set()
    for i in range(1, 600, 2):
        near = sorted((round(float(1 - unit[i] @ unit[j]), 6) + 0.0, j) for j in range(600) if i % 2 == j % 2 or i % 5 == j % 5)[:5]
        expected |= {(i, j, abs(d), n) for n, (d, j) in enumerate(near, 1)}
    assert {(r.query_id, r.vec_id, abs(r.distance), r["rank"]) for r in found.collect()} == expected


def test_pairs_are_not_shuffled(spark, sf, tmp_path):
    """Neither index makes a row for each pair that it compares."""
    vectors = tb.vectors(spark, sf)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ls.VectorLists.build(vectors, str(tmp_path))
    for found in (ann.search(vectors, queries, 10), ls.search(index, queries, 10, 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
        assert found.count() == 10 * queries.count()


def test_vectors_of_other_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0]), (2, [1.0], [0])], SHAPE)
    with pytest.raises(Exception, match="different lengths"):
        cells.search(rows, rows.withColumnRenamed("vec_id", "query_id"), lambda mark, marks: marks[:, 0] == 0, 5, 6, 2, 2).collect()
