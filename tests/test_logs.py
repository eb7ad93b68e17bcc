"""Compacted event logs, and keys that are never forgotten."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from reminis.operators import logs
from reminis.operators import store as st
from reminis.streaming import pipelines as pl

NOW = datetime(2026, 1, 1)
DELETIONS = StructType([StructField("user_id", StringType()), StructField("fact_id", LongType()), StructField("at", TimestampNTZType())])


def last(events):
    return events.groupBy("user_id", "fact_id").agg(F.max("at").alias("at")).select("user_id", "fact_id", "at")


def deletions(spark, *rows):
    return spark.createDataFrame([(u, i, NOW + timedelta(days=d)) for u, i, d in rows], DELETIONS)


def test_reads_equal_the_whole_log_at_any_moment(spark, tmp_path):
    log = logs.EventLog(spark, str(tmp_path), DELETIONS, last)
    whole = deletions(spark)

    def append(*rows):
        nonlocal whole
        log.append(deletions(spark, *rows))
        whole = whole.union(deletions(spark, *rows))

    def same():
        assert sorted(map(tuple, log.read().collect())) == sorted(map(tuple, last(whole).collect()))

    same()
    assert not log.compact()
    append(("a", 1, 1), ("a", 2, 5), ("b", 1, 2))
    append(("a", 1, 9), ("c", 4, 0))
    same()
    assert log.compact()
    same()
    append(("a", 2, 3), ("a", 7, 7))  # an older event of a known key, and a new key
    same()
    # a writer appends while a compaction runs: it has read, and not yet published
    number, content = log.versions.current()
    rows, names = log._read(content)
    append(("d", 9, 9))
    rows.write.parquet(f"{log.path}/snapshots/by-hand")
    assert log.versions.publish(number + 1, {"snapshot": "snapshots/by-hand", "covered": [*content["covered"], *names]})
    same()
    assert not log.versions.publish(number + 1, {})  # the slower of two compactions
    assert log.vacuum() == 4  # three appends and a snapshot
    same()
    assert log.compact()
    same()
    assert len(log.versions.current()[1]["covered"]) == 1  # deleted events are no longer named


def test_a_log_of_status(spark, tmp_path):
    """Of several results of one fact one that succeeded counts, before and after a compaction."""
    from reminis.sources.tables import FACTS, STATUS, evolve

    names = [f.name for f in STATUS if f.name != "fact_id"]
    best = F.min_by(F.struct(*names), F.struct(F.col("embed_status") != "done", "embed_model", "vec_rowid", "embed_error")).alias("__s")
    log = logs.EventLog(spark, str(tmp_path), STATUS, lambda df: df.groupBy("fact_id").agg(best).select("fact_id", "__s.*"))
    facts = evolve(spark.range(4).select(F.col("id").alias("fact_id"), F.lit("u").alias("user_id")))
    log.append(spark.createDataFrame([(1, "failed", "x", None, None), (2, "done", None, "m", 2)], STATUS))
    log.compact()
    log.append(spark.createDataFrame([(1, "done", None, "m", 1), (2, "failed", "late", None, None)], STATUS))
    states = {r.fact_id: r.embed_status for r in st.with_status(facts, log.read()).collect()}
    assert states == {0: "pending", 1: "done", 2: "done", 3: "pending"} and len(FACTS) > 4


def exchanges(spark, *rows):
    return spark.createDataFrame(rows, "user_id string, session_id long, turn long, content_hash string, chunk_text string")


def test_a_duplicate_is_caught_after_any_time(spark, tmp_path):
    seen = logs.SeenKeys(spark, str(tmp_path), buckets=64)

    def admit(number, *rows):
        return sorted((r.user_id, r.session_id, r.turn) for r in seen.admit(exchanges(spark, *rows), number).collect())

    assert admit(0, ("u", 1, 1, "h1", "x"), ("u", 1, 0, "h1", "x"), ("v", 1, 1, "h1", "x"), ("u", 2, 1, None, "y"), ("u", 2, 1, None, "y")) == [("u", 1, 0), ("u", 2, 1), ("u", 2, 1), ("v", 1, 1)]
    for number in range(1, 4):
        assert admit(number, ("u", number, 0, f"k{number}", "x")) == [("u", number, 0)]
    assert admit(30, ("u", 99, 0, "h1", "x"), ("w", 99, 0, "h1", "x")) == [("w", 99, 0)]
    assert admit(30, ("u", 99, 0, "h1", "x"), ("w", 99, 0, "h1", "x")) == [("w", 99, 0)]  # run again: the same answer
    assert admit(31, ("w", 100, 0, "h1", "x")) == []
    scan = seen.known(exchanges(spark, ("u", 1, 1, "h1", "x")), 99)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "(bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_of_exchanges_with_seen_keys(spark, tmp_path):
    path = str(tmp_path)
    rows = [("u", i, 0, NOW + timedelta(days=40 * i), f"h{i % 2}", "x") for i in range(5)]
    schema = "user_id string, session_id long, turn long, timestamp timestamp_ntz, content_hash string, chunk_text string"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        pl.start_deduplicating(stream, f"{path}/seen", f"{path}/out", f"{path}/checkpoint").awaitTermination()
        found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out").count()
        assert found == min(i + 1, 2)
