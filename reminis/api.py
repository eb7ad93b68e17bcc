"""A memory store over parquet directories, and the tools built on it."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reminis.functions import formats as fm
from reminis.functions.embed import Embedder, HashingEmbedder, embed_facts, embed_query
from reminis.operators import context as cx
from reminis.operators import retrieval as rt
from reminis.operators import store as st
from reminis.operators.postings import KeywordIndex
from reminis.operators.postings import search as indexed_search
from reminis.sources.tables import FACTS, STATUS, VECTORS, evolve
from reminis.streaming import pipelines as pl
from reminis.streaming.counts import KeptCounts, stored_events
from reminis.streaming.queue import queued_facts

DEFAULT_LIMIT, TOOL_LIMIT, MOST = 10, 20, 100
#: Segments of a store's index before they are made one.
MOST_SEGMENTS = 8
# Fixed value: the seconds that a prompt waits for its context.
HOOK_SECONDS = 0.8


class BadRequest(ValueError):
    """A request that is not valid."""


class StatusStore(Protocol):
    """What reports on a store need."""

    def status(self) -> dict: ...


class SearchStore(Protocol):
    """What reads from a store need."""

    def search(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame: ...


def log_error(path: str, kind: str, message: str, **context) -> None:
    """Append an error as a JSON line; a log that cannot be written is no error."""
    try:
        with open(path, "a") as log:
            log.write(json.dumps({"timestamp": now().isoformat() + "Z", "type": kind, "message": message, **context}, default=str) + "\n")
    except OSError:
        pass


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class MemoryStore:
    """Facts of one user under ``path``: appended facts, vectors, embedding results and deletions."""

    spark: SparkSession
    path: str
    user: str = "default"
    embedder: Embedder | None = field(default_factory=HashingEmbedder)
    #: Whether searches keep and read a stored keyword index.
    indexed: bool = False
    #: Whether status and health read the counts that ``count_stream`` keeps up.
    counted: bool = False

    def _read(self, name: str, schema) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(target) or not len(files.listStatus(target)):
            return self.spark.createDataFrame([], schema)
        # the files' own columns: older ones lack some; batches of the stream lie in folders of their own
        return self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def facts(self) -> DataFrame:
        rows = evolve(self._read("facts", FACTS))
        rows = st.soft_delete(rows, self._read("deletions", "user_id string, fact_id long, at timestamp_ntz"))
        return st.with_status(rows, evolve(self._read("status", STATUS), STATUS))

    def vectors(self) -> DataFrame:
        """One row for each vector, also where a batch was embedded twice."""
        return evolve(self._read("vectors", VECTORS), VECTORS).dropDuplicates(["vec_id"])

    def remember(self, content: str, session: str = "unknown", level: str = "high", decay: str = "slow", tags: list[str] | None = None) -> str:
        """Store a fact; the answer says what was kept."""
        one = self.spark.range(1).select(
            F.xxhash64(F.uuid()).alias("fact_id"), F.lit(self.user).alias("user_id"), F.lit(content).alias("content"), F.lit(session).alias("source_session_id"),
            fm.confidence_of(F.lit(level)).alias("confidence"), F.lit(decay).alias("decay_rate"),
            (F.array(*[F.lit(t) for t in tags]) if tags else F.lit(None).cast("array<string>")).alias("tags"),
        )
        st.ingest(one, now()).write.mode("append").parquet(f"{self.path}/facts")
        return f'Remembered: "{content[:80]}{"..." if len(content) > 80 else ""}"'

    def embed_pending(self) -> None:
        """Embed all pending facts in one batch; the streaming pipeline does so continuously, into the same folders.
        Vectors are written before the status that names them, and one written twice counts once, so a run that
        stopped between the two may be repeated."""
        pending = self.facts().where("embed_status = 'pending'")
        path = f"{self.path}/staging-{time.time_ns()}"
        embed_facts(pending, self.embedder).write.parquet(path)
        done = self.spark.read.parquet(path)
        done.where("error is null").select(F.col("fact_id").alias("vec_id"), "embedding").write.mode("append").parquet(f"{self.path}/vectors")
        st.status_of(done, self.embedder.name).write.mode("append").parquet(f"{self.path}/status")

    def embed_stream(self, once: bool = False, rows: int | None = None) -> StreamingQuery:
        """The streaming pipeline over this store; with ``rows`` it takes so many facts a batch, first in first out."""
        if rows is not None:
            facts = queued_facts(self.spark, f"{self.path}/facts", rows)
            return pl.start_embedding(facts, self.embedder, self.path, f"{self.path}/queue-checkpoint", name="queue")
        facts = pl.pending_facts(self.spark, f"{self.path}/facts")
        return pl.start_embedding(facts, self.embedder, self.path, f"{self.path}/embedding-checkpoint", once)

    def counts(self) -> KeptCounts:
        return KeptCounts(self.spark, f"{self.path}/counts")

    def count_stream(self, once: bool = False) -> StreamingQuery:
        """Keep up the counts of this store."""
        return self.counts().start(stored_events(self.spark, self.path), f"{self.path}/counts-checkpoint", once)

    def forget(self, fact_id: int) -> None:
        """Mark a fact as deleted; an unknown one changes nothing."""
        row = [(self.user, fact_id, now())]
        self.spark.createDataFrame(row, "user_id string, fact_id long, at timestamp_ntz").write.mode("append").parquet(f"{self.path}/deletions")

    def queries(self, text: str) -> DataFrame:
        vector = embed_query(self.embedder, text)
        return self.spark.createDataFrame([(0, self.user, text, vector)], "query_id long, user_id string, text string, embedding array<float>")

    def index(self) -> KeywordIndex:
        """The keyword index with all live facts in it: those that it lacks become a segment, and many segments one."""
        index, facts = KeywordIndex.open(self.spark, f"{self.path}/index"), self.facts()
        if not index.segments:
            return KeywordIndex.build(facts, f"{self.path}/index")
        missing = rt.live(facts).join(index.docs.select("fact_id"), "fact_id", "left_anti").select(facts.columns)
        if not missing.isEmpty():
            index = index.add(missing)
        return index.compact(self.gone(index)) if len(index.segments) > MOST_SEGMENTS else index

    def gone(self, index: KeywordIndex) -> DataFrame | None:
        """The facts that were deleted since the index has them, if any."""
        found = self.facts().where("deleted_at is not null").select("user_id", "fact_id").join(index.docs.select("fact_id"), "fact_id", "left_semi")
        return None if found.isEmpty() else found

    def search(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        facts, vectors, queries = self.facts(), self.vectors(), self.queries(text)
        if self.indexed:
            index = self.index()
            return indexed_search(index, facts, vectors, queries, limit, now(), self.gone(index)).orderBy("rank")
        return rt.search(facts, vectors, queries, limit, now()).orderBy("rank")

    def context(self, text: str, keep: int = cx.CONTEXT_FACTS) -> str:
        found = self.search(text, 2 * keep).where(F.col("rank") <= keep)
        return cx.blocks(self.queries(text), found, now()).first().block

    def status(self) -> dict:
        found = self.counts().status() if self.counted else st.status(self.facts())
        row = found.where(F.col("user_id") == self.user).first()
        size = st.storage_bytes(self.spark, self.path) if row else 0
        return {"fact_count": row.fact_count if row else 0, "last_ingestion": row.last_ingestion if row else None, "storage_bytes": size}

    def health(self) -> DataFrame:
        return self.counts().health() if self.counted else st.health(self.facts(), self.vectors())

    def export(self) -> str:
        """Live facts as a JSON array, newest first."""
        return json.dumps([json.loads(x) for x in st.export(self.facts().where(F.col("user_id") == self.user)).toJSON().collect()], indent=2)


def memory_search(store: MemoryStore, query: str, limit: int = TOOL_LIMIT) -> list[dict]:
    """The search tool: validated arguments, rows with age and label."""
    if not isinstance(query, str) or not query.strip():
        raise BadRequest("query must be a non-empty string")
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST:
        raise BadRequest(f"limit must be an integer from 1 to {MOST}")
    found = store.search(query, limit)
    rows = found.withColumn("age_in_days", fm.rounded_tenth(fm.age_in_days(F.col("created_at"), F.lit(now().isoformat(sep=" ")).cast("timestamp_ntz"))))
    return [r.asDict() for r in rows.select("content", F.col("final_score").alias("score"), "age_in_days", cx.label().alias("session_label"), "tags").collect()]


def memory_status(store: StatusStore) -> dict:
    """The status tool: how many facts, when the last one came, and the bytes they take."""
    found = store.status()
    last = found["last_ingestion"]
    return {"fact_count": found["fact_count"], "last_ingestion": last.isoformat() + "Z" if last else None, "storage_bytes": found["storage_bytes"]}


def memory_report(store: MemoryStore, query: str, limit: int = 5) -> str:
    return cx.reports(store.queries(query), store.search(query, limit)).first().report


def answer(store: MemoryStore, body: str) -> tuple[int, dict]:
    """A query request as JSON: status code and answer, with the time that the search took."""
    try:
        request = json.loads(body)
        query, limit = request.get("query"), request.get("topK")
        limit = DEFAULT_LIMIT if limit is None else limit
        if not isinstance(query, str) or not query.strip():
            raise BadRequest("query must be a non-empty string")
        if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
            raise BadRequest("topK must be a positive integer")
    except (ValueError, AttributeError) as e:
        return 400, {"error": str(e)}
    began = time.perf_counter()
    try:
        found = store.search(query, limit)
        results = [json.loads(x) for x in found.withColumn("created_at", fm.iso(F.col("created_at"))).toJSON().collect()]
    except Exception as e:  # noqa: BLE001  the caller gets whatever failed
        return 500, {"error": str(e)}
    return 200, {"results": results, "latencyMs": round((time.perf_counter() - began) * 1000)}


class PromptHook:
    """What is put before a prompt: the query behind it is resolved, searched for, and the context wrapped, all within
    ``seconds``; the first prompt gets the orientation text as well. Without context in time nothing else is put, and what
    still runs is cancelled."""

    def __init__(self, store: MemoryStore, orientation: str | None = None, seconds: float = HOOK_SECONDS, sessions: int = 1000):
        self.store, self.orientation, self.seconds = store, orientation, seconds
        self.sessions, self.oriented = pl.SessionQueries(sessions), False

    def __call__(self, session: str, prompt: str, messages: list[tuple[str, str]] = ()) -> str:
        """``messages``: (role, text) of the conversation so far. The time runs from here on: it covers finding the query,
        building the search, and running it."""
        spark = self.store.spark

        def context() -> str:
            prompts = spark.createDataFrame([(0, prompt)], "conv_id long, prompt string")
            turns = spark.createDataFrame([(0, i, *m) for i, m in enumerate(messages)], "conv_id long, turn long, role string, text string")
            query = cx.resolved_queries(prompts, turns).first().query
            self.sessions.put(session, query)
            if not query.strip():
                return ""
            found = self.store.search(query, 2 * cx.CONTEXT_FACTS).where(F.col("rank") <= cx.CONTEXT_FACTS)
            block = cx.blocks(self.store.queries(query), found, now())
            return cx.injections(block).first().block

        block = pl.in_time(spark, context, self.seconds, "")
        first, self.oriented = self.orientation if not self.oriented else None, True
        return "\n\n".join(x for x in (first, block) if x)


def option(name: str, given: str | None, default: str, environment: dict | None = None) -> str:
    """A setting: the given value, the environment's, or the default; ``~`` is the home folder."""
    environment = os.environ if environment is None else environment
    return os.path.expanduser(given or environment.get(name) or default)


__all__ = ["BadRequest", "MemoryStore", "PromptHook", "SearchStore", "StatusStore", "answer", "log_error", "memory_report", "memory_search", "memory_status", "option"]
