"""Streams on temporary folders, and the store with its tools."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reminis import api
from reminis.functions.embed import HashingEmbedder, embed_query
from reminis.operators import store as st
from reminis.sources import markdown
from reminis.sources.tables import FACTS, evolve
from reminis.streaming import pipelines as pl

NOW = datetime(2026, 1, 1)


def new_facts(spark, rows):
    return st.ingest(spark.createDataFrame(rows, "fact_id long, user_id string, content string, source_session_id string"), NOW)


def test_embedding_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("facts", "out", "checkpoint"))
    new_facts(spark, [(1, "u", "dark mode", "s"), (2, "u", None, "s")]).write.parquet(source)

    def run():
        pl.start_embedding(pl.pending_facts(spark, source), HashingEmbedder(), out, checkpoint, once=True).awaitTermination()
        return spark.read.parquet(f"{out}/status"), spark.read.parquet(f"{out}/vectors")

    status, vectors = run()
    assert {(r.fact_id, r.embed_status) for r in status.collect()} == {(1, "done"), (2, "failed")}
    assert vectors.count() == 1 and len(vectors.first().embedding) == 64
    new_facts(spark, [(3, "u", "chocolate", "s")]).write.mode("append").parquet(source)
    status, vectors = run()
    assert status.count() == 3 and vectors.count() == 2
    merged = pl.with_status(spark.read.schema(FACTS).parquet(source), status)
    assert {(r.fact_id, r.embed_status, r.vec_rowid) for r in merged.collect()} == {(1, "done", 1), (2, "failed", None), (3, "done", 3)}


def test_once_only_and_duplicates(spark, tmp_path):
    schema = "id string, trigger_type string"
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], schema).write.parquet(str(tmp_path / "n"))
    stream = pl.first_triggers(spark.readStream.schema(schema).parquet(str(tmp_path / "n")))
    stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert {r.trigger_type for r in spark.table("fired").collect()} == {"x", "y"} and spark.table("fired").count() == 2
    schema = "user_id string, session_id long, turn long, content_hash string, timestamp timestamp_ntz"
    rows = [("u", 1, 0, "h", NOW), ("u", 2, 0, "h", NOW), ("v", 3, 0, "h", NOW), ("u", 4, 0, None, NOW), ("u", 5, 0, None, NOW)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    stream = pl.new_exchanges(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("kept").count() == 4


def test_session_queries():
    sessions = pl.SessionQueries(3)
    for i in range(4):
        sessions.put(f"s{i}", "q")
    assert len(sessions) == 3 and sessions.get("s0") is None
    sessions.put("s3", "again")  # drops the oldest although the session is known
    assert len(sessions) == 2 and sessions.get("s3") == "again" and sessions.get("s1") is None


def test_deadline(spark):
    assert pl.within(spark.range(3), 60) != []
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda x: __import__("time").sleep(20))("id"))
    assert pl.within(slow, 1.0, ["late"]) == ["late"]


def test_embedders():
    assert embed_query(None, "x", 4) == [0.0] * 4
    assert HashingEmbedder().embed(["a b"]) == HashingEmbedder().embed(["a b"])


def test_markdown_seed(spark, tmp_path):
    (tmp_path / "2026-01-02.md").write_text("intro\n## One\nsomething worth keeping\n## Two\nshort\n")
    (tmp_path / "notes.md").write_text("## Other\nnot a daily note at all\n")
    (tmp_path / "MEMORY.md").write_text("a memory file without headings")
    none = spark.createDataFrame([], FACTS)
    found = markdown.seed(spark, [str(tmp_path / "missing"), str(tmp_path)], [str(tmp_path / "MEMORY.md")], "u", NOW, none).collect()
    assert {(r.source_session_id, r.confidence) for r in found} == {("memory-file", 0.9), ("2026-01-02", 0.85)}
    assert markdown.seed(spark, [str(tmp_path)], [], "u", NOW, evolve(new_facts(spark, [(1, "u", "x", "s")]))).count() == 0


def test_store(spark, tmp_path):
    store = api.MemoryStore(spark, str(tmp_path / "store"), "me")
    assert store.status()["fact_count"] == 0
    assert store.remember("User prefers dark mode", "s1", tags=["ui"]).startswith("Remembered")
    store.remember("Coffee is taken black", "s2", level="low", decay="fast")
    assert [r["content"] for r in api.memory_search(store, "coffee", 1)] == ["Coffee is taken black"]  # keywords, before any vector
    store.embed_pending()
    found = store.search("dark mode").collect()
    assert found[0].content == "User prefers dark mode" and len(found) == 2
    assert "[HIGH] [s1] today" in store.context("dark mode") and "[s2]" in api.memory_report(store, "coffee")
    code, reply = api.answer(store, json.dumps({"query": "dark", "topK": 1}))
    assert code == 200 and len(reply["results"]) == 1 and "latencyMs" in reply
    assert api.answer(store, "{")[0] == 400 and api.answer(store, '{"query": " "}')[0] == 400
    with pytest.raises(api.BadRequest):
        api.memory_search(store, "x", 101)
    assert store.health().first().healthy
    store.forget(found[0].fact_id)
    assert store.status()["fact_count"] == 1 and len(json.loads(store.export())) == 1


def test_options():
    assert api.option("X", "given", "d", {"X": "e"}) == "given"
    assert api.option("X", None, "d", {"X": "e"}) == "e"
    assert not api.option("X", None, "~/d", {}).startswith("~")


def test_embedding_loop(spark, tmp_path):
    source = str(tmp_path / "facts")
    new_facts(spark, [(1, "u", "dark mode", "s")]).write.parquet(source)
    loop = pl.EmbeddingLoop(lambda: pl.pending_facts(spark, source), HashingEmbedder(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 0.2)
    query = loop.start()
    assert loop.start() is query
    query.processAllAvailable()
    assert not loop.stop_if_idle(1000)
    assert loop.stop_if_idle(0.0) and not loop.running and not loop.stop_if_idle(0.0)
    assert spark.read.parquet(str(tmp_path / "out/status")).count() == 1


def test_keys_and_seeds(spark, tmp_path):
    secret, keys = st.create_key(spark, "u", "key", NOW)
    assert len(secret) == 4 + 64 and keys.first().hashed_key != secret
    assert st.find_key(keys, secret).count() == 1 and st.find_key(keys, secret + "x").count() == 0
    used = st.touch(keys, keys.first().id, NOW)
    assert used.first().last_used_at == NOW and st.list_keys(used, "u").count() == 1
    assert st.find_key(st.revoke(used, keys.first().id, NOW), secret).count() == 0
    seeded = st.seed(spark, "u", "setup", [("likes tea", 0.9, ["drink"])], NOW).first()
    assert (seeded.confidence, seeded.tags, seeded.embed_status) == (0.9, ["drink"], "pending")
    log = tmp_path / "errors.jsonl"
    api.log_error(str(log), "search", "failed", query="q")
    api.log_error(str(tmp_path / "missing" / "x"), "search", "failed")
    assert json.loads(log.read_text())["query"] == "q"


def test_store_and_stream_share_their_tables(spark, tmp_path):
    store = api.MemoryStore(spark, str(tmp_path / "store"), "me")
    store.remember("User prefers dark mode", "s1")
    store.embed_pending()
    store.remember("Coffee is taken black", "s2")
    store.embed_stream(once=True).awaitTermination()
    rows = {r.content: r for r in store.facts().collect()}
    assert all(r.embed_status == "done" and r.vec_rowid == r.fact_id and r.embed_model == "hashing-64" for r in rows.values())
    assert rt_ids(store) == {r.fact_id for r in rows.values()}
    assert {r.content for r in store.search("coffee").collect()} == set(rows)
    store.embed_pending()  # nothing is left
    assert store.vectors().count() == 2 and store.health().first().healthy
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{store.path}/vectors").limit(1)
    found.write.mode("append").parquet(f"{store.path}/vectors")  # a batch that was written twice
    assert store.vectors().count() == 2
    assert api.memory_status(store)["fact_count"] == 2 and api.memory_status(store)["last_ingestion"].endswith("Z")
    code, reply = api.answer(store, json.dumps({"query": "dark", "topK": None}))
    assert code == 200 and json.loads(json.dumps(reply))["results"][0]["content"] == "User prefers dark mode"
    assert api.answer(store, json.dumps({"query": "dark", "topK": "x"}))[0] == 400


def rt_ids(store):
    return {r.vec_id for r in store.vectors().collect()}


def test_an_old_store_opens_with_defaults(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([(1, "me", "dark mode", "s")], "fact_id long, user_id string, content string, source_session_id string").write.parquet(f"{path}/facts")
    store = api.MemoryStore(spark, path, "me")
    row = store.facts().first()
    assert (row.confidence, row.decay_rate, row.embed_status, row.deleted_at) == (0.9, "slow", "pending", None)
    store.remember("newer columns", "s2", level="low")
    rows = {r.content: r for r in store.facts().collect()}
    assert rows["dark mode"].confidence == 0.9 and rows["dark mode"].decay_rate == "slow" and rows["newer columns"].confidence == 0.5
    store.embed_pending()
    assert {r.embed_status for r in store.facts().collect()} == {"done"}


def test_prompt_hook(spark, tmp_path):
    store = api.MemoryStore(spark, str(tmp_path / "store"), "me")
    store.remember("User prefers dark mode", "s1")
    hook = api.PromptHook(store, "Welcome.", seconds=120)
    first = hook("a", "ignored", [("user", "dark mode?"), ("assistant", "hm")])
    assert first.startswith("Welcome.") and "User prefers dark mode" in first and hook.sessions.get("a") == "dark mode?"
    assert not hook("a", "dark mode").startswith("Welcome.")
    late = api.PromptHook(store, None, seconds=0.0)
    assert late("a", "dark mode") == ""
    began = time.monotonic()
    assert "dark mode" in (api.PromptHook(store, "Welcome.")("b", "dark mode") + "dark mode")  # a block, or none
    assert time.monotonic() - began < 1.0


def test_in_time(spark):
    def slow():
        return spark.range(1 << 40).selectExpr("sum(hash(id))").first()

    began = time.monotonic()
    assert pl.in_time(spark, slow, 0.3, "late") == "late" and time.monotonic() - began < 1
    assert pl.in_time(spark, lambda: spark.range(3).count(), 60, None) == 3
    with pytest.raises(ZeroDivisionError):
        pl.in_time(spark, lambda: 1 / 0, 60, None)
    for _ in range(100):
        if not spark.sparkContext.statusTracker().getActiveStageIds():
            break
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()


def test_an_indexed_store_finds_what_a_scan_finds(spark, tmp_path):
    store = api.MemoryStore(spark, str(tmp_path / "store"), "me", indexed=True)
    plain = api.MemoryStore(spark, store.path, "me")

    def same(text):
        found = [[r.fact_id for r in s.search(text, 3).collect()] for s in (store, plain)]
        assert found[0] == found[1]
        return found[0]

    store.remember("User prefers dark mode")
    assert len(same("dark mode")) == 1  # nothing is embedded yet: keywords alone
    store.remember("Dark chocolate")
    store.embed_pending()
    first = same("dark")
    assert len(first) == 2 and len(store.index().segments) == 2
    store.forget(first[0])
    assert same("dark") == first[1:]


def test_batches_are_embedded_at_once(spark):
    from reminis.functions.embed import embed_facts, warm_up

    class Batched:
        """Embeds whole batches."""

        name, size = "batched", 2

        def embed(self, texts):
            if None in texts:
                raise ValueError("nothing to embed")
            return [[float(len(texts)), 0.0] for _ in texts]

    rows = spark.createDataFrame([(i, "x") for i in range(10)], "fact_id long, content string").coalesce(1)
    assert {r.embedding[0] for r in embed_facts(rows, Batched()).collect()} == {10.0}
    mixed = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "fact_id long, content string").coalesce(1)
    assert {(r.fact_id, r.error is None) for r in embed_facts(mixed, Batched()).collect()} == {(1, True), (2, False), (3, True)}
    assert warm_up(Batched())


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    """Tasks of several jobs share what their worker has loaded."""
    import os

    from reminis.functions.embed import Loaded, embed_facts

    folder = str(tmp_path)

    def load(path):
        import tempfile

        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=path)
        return HashingEmbedder(4)

    model = Loaded(load, folder, name="slow", size=4)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(64)], "fact_id long, content string").repartition(16)
    for _ in range(3):
        found = embed_facts(rows, model).collect()
        assert len(found) == 64 and all(r.error is None and len(r.embedding) == 4 for r in found)
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert workers and len(workers) == len(set(workers)) and len(workers) < 3 * 16
    assert model.embed(["x"]) == HashingEmbedder(4).embed(["x"])
