"""Structured Streaming: embedding of new facts, once-only triggers, duplicate exchanges, session queries."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Event, Thread

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reminis.functions.embed import Embedder, embed_facts, warm_up
from reminis.operators.logs import SeenKeys
from reminis.operators.store import status_of, with_status  # noqa: F401  part of this module for callers
from reminis.sources.tables import FACTS


def pending_facts(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """New pending facts of a growing parquet directory."""
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.where("embed_status = 'pending'").select("fact_id", "content")


def start_embedding(
    facts: DataFrame, embedder: Embedder, out: str, checkpoint: str, once: bool = False, idle_seconds: float = 5.0, name: str = "batch"
) -> StreamingQuery:
    """Embed a stream of facts into ``out``/vectors and ``out``/status. A batch writes its own partition (``name``=number) of
    both and replaces it when it is run again, so each fact has one result; a failed row is final and fails alone."""

    def write(batch: DataFrame, number: int) -> None:
        found = embed_facts(batch, embedder).persist()
        try:
            ok = found.where("error is null")
            ok.select(F.col("fact_id").alias("vec_id"), "embedding").write.mode("overwrite").parquet(f"{out}/vectors/{name}={number}")
            status_of(found, embedder.name).write.mode("overwrite").parquet(f"{out}/status/{name}={number}")
        finally:
            found.unpersist()

    warm_up(embedder)
    writer = facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(idle_seconds * 1000)} milliseconds")
    return writer.start()


class EmbeddingLoop:
    """Keeps one embedding query running: starting twice changes nothing, ``stop`` waits for the batch at hand,
    and ``stop_if_idle`` ends it when no rows have come for a while; the next ``start`` goes on from the
    checkpoint."""

    def __init__(self, facts: Callable[[], DataFrame], embedder: Embedder, out: str, checkpoint: str, idle_seconds: float = 5.0):
        self.facts, self.embedder, self.out, self.checkpoint, self.idle_seconds = facts, embedder, out, checkpoint, idle_seconds
        self.query: StreamingQuery | None = None
        self.seen, self.since = -1, 0.0

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> StreamingQuery:
        if not self.running:
            self.query = start_embedding(self.facts(), self.embedder, self.out, self.checkpoint, idle_seconds=self.idle_seconds)
            self.since = time.monotonic()
        return self.query

    def stop(self) -> None:
        if self.running:
            self.query.processAllAvailable()
            self.query.stop()

    def stop_if_idle(self, seconds: float = 300.0) -> bool:
        """To be called now and then; whether the query was stopped."""
        if not self.running:
            return False
        batch = max((p["batchId"] for p in self.query.recentProgress if p["numInputRows"]), default=-1)
        if batch != self.seen:
            self.seen, self.since = batch, time.monotonic()
        if time.monotonic() - self.since < seconds:
            return False
        self.stop()
        return True


def first_triggers(nudges: DataFrame) -> DataFrame:
    """The first row of each trigger type, once in the life of the stream."""
    return nudges.dropDuplicates(["trigger_type"])


def new_exchanges(exchanges: DataFrame, delay: str = "1 day") -> DataFrame:
    """Exchanges whose content their user has not sent within ``delay``; those without a hash always pass."""
    stream = exchanges.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", delay)
    key = F.coalesce(F.col("content_hash"), F.concat_ws("|", F.lit("none"), "session_id", "turn"))
    return stream.withColumn("__key", key).dropDuplicatesWithinWatermark(["user_id", "__key"]).drop("__key", "at")


def start_deduplicating(exchanges: DataFrame, seen: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the exchanges of a stream whose content their user has never sent, however long ago; the keys are kept under
    ``seen`` and a batch reads the folders that its own fall in. Takes what is there and ends."""
    keys = SeenKeys(exchanges.sparkSession, seen)

    def write(batch: DataFrame, number: int) -> None:
        keys.admit(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return exchanges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SessionQueries:
    """The last query of each session, at most ``capacity``. A full map drops its oldest session for every
    new query, known or not; a session that asks again keeps its place."""

    def __init__(self, capacity: int = 1000):
        self.capacity, self.queries = capacity, OrderedDict()

    def put(self, session: str, query: str) -> None:
        if len(self.queries) >= self.capacity:
            self.queries.popitem(last=False)
        self.queries[session] = query

    def get(self, session: str) -> str | None:
        return self.queries.get(session)

    def __len__(self) -> int:
        return len(self.queries)


def within(df: DataFrame, seconds: float, default: list | None = None) -> list:
    """The rows of ``df``, or ``default`` if they take longer; the job is cancelled."""
    context = df.sparkSession.sparkContext
    tag = f"deadline-{id(df)}"
    done, late = Event(), Event()

    def watch() -> None:
        """Cancels what runs after the deadline, also a job that starts only then."""
        if done.wait(seconds):
            return
        late.set()
        while not done.wait(0.02):
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    Thread(target=watch, daemon=True).start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            return default or []
        raise
    finally:
        done.set()
        context.removeJobTag(tag)


def in_time(spark: SparkSession, work: Callable[[], object], seconds: float, default: object) -> object:
    """What ``work`` returns, or ``default`` when it takes longer than ``seconds``: it is left to itself then, and every job
    that it has started or starts is cancelled. What it raises in time is raised here."""
    tag, done = f"in-time-{time.monotonic_ns()}", Event()
    found: list = []

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            found.append((True, work()))
        except Exception as e:  # noqa: BLE001  handed to the caller, if it still waits
            found.append((False, e))
        finally:
            spark.sparkContext.removeJobTag(tag)
            done.set()

    def cancel() -> None:
        while not done.wait(0.05):
            spark.sparkContext.cancelJobsWithTag(tag)

    InheritableThread(target=run, daemon=True).start()
    if not done.wait(seconds):
        Thread(target=cancel, daemon=True).start()
        return default
    fine, value = found[0]
    if not fine:
        raise value
    return value
