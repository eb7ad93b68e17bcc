"""Counts that are kept up, against those of the whole tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reminis.api import MemoryStore
from reminis.operators import store as st
from reminis.sources.tables import FACTS, STATUS, VECTORS
from reminis.streaming.counts import DELETIONS, added
from reminis.streaming.sessions import STATE_STORE

NOW = datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    kept = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in kept.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def test_equal_to_the_whole_tables_after_any_order_of_events(rocks, tmp_path):
    """Deletions and results before and after their facts, repeated ones, other users' deletions, facts without an id."""
    spark, r = rocks, random.Random(6)
    store = MemoryStore(spark, str(tmp_path))
    todo = [("facts", (i, r.choice("ab"), "done" if i % 7 == 0 else "pending", "old" if i % 7 == 0 else None, NOW + timedelta(days=i), i % 9 == 0)) for i in range(24)]
    todo += [("facts", (None, "a", "pending", None, NOW, False)), ("facts", (None, "c", "failed", None, None, True)), ("facts", (3, "a", "pending", None, NOW, False))]
    todo += [("deletions", (r.choice(["a", "b", None]), r.randrange(30), NOW)) for _ in range(20)]
    todo += [("status", (i, *r.choice([("done", None, "m", i), ("failed", "x", None, None)]))) for i in (r.randrange(26) for _ in range(30))]
    todo += [("vectors", (i, [0.0, 0.0] if i % 4 == 0 else [1.0, 0.0])) for i in (r.randrange(12) for _ in range(16))]
    r.shuffle(todo)
    schemas = {"deletions": DELETIONS, "status": STATUS, "vectors": VECTORS}

    def write(name, rows):
        if name == "facts":
            full = [tuple({"fact_id": i, "user_id": u, "content": "x", "embed_status": s, "embed_model": m, "created_at": at, "deleted_at": NOW if gone else None}.get(f.name) for f in FACTS) for i, u, s, m, at, gone in rows]
            frame = spark.createDataFrame(full, FACTS)
        else:
            frame = spark.createDataFrame(rows, schemas[name])
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def same(found, expected):
        columns = sorted(expected.columns)
        rows = [sorted(map(repr, map(tuple, x.select(columns).collect()))) for x in (found, expected)]
        assert rows[0] == rows[1] and rows[0]

    part = -(-len(todo) // 3)
    for k in range(3):
        for name in ("facts", *schemas):
            rows = [x for n, x in todo[k * part : (k + 1) * part] if n == name]
            if rows:
                write(name, rows)
        store.count_stream(once=True).awaitTermination()  # each starts from the checkpoint of the one before
        counts = store.counts()
        if k == 1:
            assert counts.compact() and counts.log.vacuum()
        same(counts.status(), st.status(store.facts()))
        same(counts.status_counts(), st.status_counts(store.facts()))
        same(counts.model_counts(), st.model_counts(store.facts()))
        same(counts.health(), st.health(store.facts(), store.vectors()))
    # the newest batch is run again, before and after a compaction
    newest = counts.log.appended()[-1]
    again = spark.createDataFrame(spark.read.parquet(f"{counts.log.path}/events/{newest}").collect(), counts.log.schema)
    for _ in range(2):
        counts.log.append(added(again), newest)
        same(counts.health(), st.health(store.facts(), store.vectors()))
        counts.compact()


def test_a_store_reports_from_its_counts(rocks, tmp_path):
    store = MemoryStore(rocks, str(tmp_path), counted=True)
    store.remember("the first fact of this store")
    store.count_stream(once=True).awaitTermination()
    assert store.status()["fact_count"] == 1 and not store.health().first().healthy
    assert store.vectors().isEmpty()  # the empty folders that streams need are no tables
    store.forget(store.facts().first().fact_id)
    store.embed_pending()
    store.count_stream(once=True).awaitTermination()
    assert store.status()["fact_count"] == 0 and store.status()["last_ingestion"] is not None
    assert store.health().select(F.col("healthy")).first().healthy
