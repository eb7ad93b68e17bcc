"""Counts of a store that are kept up: status and health without reading the facts.

The events of a store (new facts, deletions, embedding results, vectors) are one stream. Its state, by fact, is what the store
would say of that fact now; what an event changes there leaves as differences: one row less of the old kind, one more of the
new. Each batch's differences are added up by user and appended to an event log, whose sums are the counts. So a report reads
a few rows for each user, and ``compact`` makes these one for each kind of fact.

Events count in any order: a deletion or result that comes before its fact waits in the state. Repeated deletions, results
and vectors change nothing, repeated rows of facts count as rows, as in ``operators.store``. A batch that is run again writes
its differences again under its number; a compaction leaves the newest batch alone, as only that one can be run again.

Defined cases: facts without an id are counted and never change; other events without an id change nothing, nor do deletions
by another user; a vector written twice counts as it came first.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reminis.functions import vectors as vx
from reminis.operators.logs import EventLog
from reminis.operators.store import STATUSES
from reminis.sources.tables import FACTS, STATUS, VECTORS, evolve

DELETIONS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("fact_id", T.LongType()), T.StructField("at", T.TimestampNTZType())])
#: ``n`` more facts (or zero vectors) of a kind, and the last time of new ones.
CHANGES = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("embed_status", T.StringType()),
    T.StructField("embed_model", T.StringType()), T.StructField("live", T.BooleanType()), T.StructField("n", T.LongType()),
    T.StructField("last", T.TimestampNTZType()),
])
EVENT = ("kind", "fact_id", "user_id", "embed_status", "embed_model", "embed_error", "vec_rowid", "flag", "created_at")


def _event(rows: DataFrame, kind: str, flag: Column) -> DataFrame:
    given = {"kind": F.lit(kind), "flag": flag}
    types = {"fact_id": "long", "vec_rowid": "long", "flag": "boolean", "created_at": "timestamp_ntz"}
    columns = [given.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in EVENT]
    return rows.select(columns)


def events(facts: DataFrame, deletions: DataFrame, status: DataFrame, vectors: DataFrame) -> DataFrame:
    """The four tables of a store, as streams, in one form; ``flag``: live, or a zero vector."""
    zero = F.coalesce(vx.is_zero(F.col("embedding")), F.lit(False))
    return (
        _event(evolve(facts), "fact", F.col("deleted_at").isNull())
        .union(_event(deletions, "deletion", F.lit(False)))
        .union(_event(evolve(status, STATUS), "status", F.lit(False)))
        .union(_event(vectors.withColumnRenamed("vec_id", "fact_id"), "vector", zero))
    )


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of the store under ``path`` as they are written."""
    at, configuration = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    tables = {"facts": FACTS, "deletions": DELETIONS, "status": STATUS, "vectors": VECTORS}
    for name in tables:  # a stream's folder has to be there
        folder = at(f"{path}/{name}")
        folder.getFileSystem(configuration).mkdirs(folder)
    reader = spark.readStream.option("recursiveFileLookup", True)
    return events(*[reader.schema(schema).parquet(f"{path}/{name}") for name, schema in tables.items()])


def _rank(result: list) -> list:
    """The order of results of one fact: one that succeeded first, then as ``with_status`` sorts, nulls first."""
    state, model, row, error = result
    return [state != "done", *[(x is not None, x or kind) for x, kind in ((model, ""), (row, 0), (error, ""))]]


class FactState(StatefulProcessor):
    """Of each id: the facts as they came with their number, who deleted it, the result that counts, and its vector."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fact", "value string")

    @staticmethod
    def counted(known: dict) -> Counter:
        out: Counter = Counter()
        for user, state, model, live, n in known["facts"]:
            if known["result"]:
                state, model = known["result"][:2]
            out["fact", user, state, model, live and user not in known["deleted"]] += n
        if known["vector"]:
            out["zero_vector", None, None, None, None] += 1
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        known = json.loads(self.state.get()[0]) if self.state.exists() else {"facts": [], "deleted": [], "result": None, "vector": None}
        before, last = self.counted(known), {}
        facts = Counter({tuple(f[:4]): f[4] for f in known["facts"]})
        for x in rows:
            if x.kind == "fact":
                facts[x.user_id, x.embed_status, x.embed_model, x.flag] += 1
                times = [t for t in (last.get(x.user_id), x.created_at) if t is not None]
                last[x.user_id] = max(times, default=None)
            elif x.kind == "deletion":
                known["deleted"] += [x.user_id] if x.user_id is not None and x.user_id not in known["deleted"] else []
            elif x.kind == "status":
                results = [r for r in (known["result"], [x.embed_status, x.embed_model, x.vec_rowid, x.embed_error]) if r]
                known["result"] = min(results, key=_rank)
            elif known["vector"] is None:
                known["vector"] = x.flag
        known["facts"] = [[*f, n] for f, n in facts.items()]
        self.state.update((json.dumps(known),))
        after = self.counted(known)
        for kind in before.keys() | after.keys():
            if after[kind] != before[kind]:
                yield Row(*CHANGES.fieldNames())(*kind, after[kind] - before[kind], last.get(kind[1]) if kind[0] == "fact" else None)

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """The differences that a stream of ``events`` makes."""
    by_fact = stream.where("fact_id is not null").groupBy("fact_id").transformWithState(FactState(), CHANGES, "Update", "None")
    plain = stream.where("fact_id is null and kind = 'fact'")
    return by_fact.union(plain.select("kind", "user_id", "embed_status", "embed_model", "flag", F.lit(1).cast("long"), "created_at"))


def added(rows: DataFrame) -> DataFrame:
    """The sum of differences; sums may be added again."""
    keys = ["kind", "user_id", "embed_status", "embed_model", "live"]
    return rows.groupBy(keys).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


class KeptCounts:
    """The counts under ``path``; reports are those of ``operators.store``, as of the last batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = EventLog(spark, path, CHANGES, added)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False, idle_seconds: float = 5.0) -> StreamingQuery:
        """Keep counting; the session needs ``sessions.STATE_STORE``."""

        def write(batch: DataFrame, number: int) -> None:
            self.log.append(added(batch), f"batch-{number:012d}")

        writer = changes(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(idle_seconds * 1000)} milliseconds")).start()

    def compact(self) -> bool:
        """All batches but the newest become one."""
        return self.log.compact(spare=self.log.appended()[-1:])

    def _facts(self) -> DataFrame:
        return self.log.read().where("kind = 'fact'")

    def status(self) -> DataFrame:
        live = F.coalesce(F.sum(F.when(F.col("live"), F.col("n"))), F.lit(0)).alias("fact_count")
        return self._facts().groupBy("user_id").agg(live, F.max("last").alias("last_ingestion"))

    def status_counts(self) -> DataFrame:
        of = [F.coalesce(F.sum(F.when(F.col("embed_status") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATUSES]
        return self._facts().groupBy("user_id").agg(*of)

    def model_counts(self) -> DataFrame:
        return self._facts().where("embed_model is not null").groupBy("embed_model").agg(F.sum("n").alias("n")).where("n > 0")

    def health(self) -> DataFrame:
        zero = self.log.read().where("kind = 'zero_vector'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("zero_vectors"))
        fine = (F.col("pending") == 0) & (F.col("failed") == 0) & (F.col("zero_vectors") == 0)
        counts = self.status_counts().select("user_id", "pending", "failed")
        return counts.join(F.broadcast(zero)).withColumn("healthy", fine)  # one row
