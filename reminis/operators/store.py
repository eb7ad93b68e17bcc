"""Ingest, deletion, status, health and export of facts, as appends and aggregates.

Parquet has no update in place: what changes is appended as an event, and ``latest`` gives the state by key.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.functions import vectors as vx
from reminis.sources.tables import API_KEYS, FACTS, timestamp

# Fixed value: the confidence of facts that are given none.
INGEST_CONFIDENCE = 0.95
STATUSES = ("done", "pending", "failed", "no_embed")
EXPORTED = ("user_id", "content", "source_session_id", "source_session_label", "confidence", "decay_rate")


def ingest(new: DataFrame, as_of: datetime, known_ids: bool = True) -> DataFrame:
    """Rows content, source_session_id (and optional columns) as pending facts with the defaults of ingest."""
    have = set(new.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    columns = {
        "fact_id": F.col("fact_id") if known_ids else F.uuid(),
        "confidence": given("confidence", F.lit(INGEST_CONFIDENCE)),
        "decay_rate": given("decay_rate", F.lit("slow")),
        "created_at": given("created_at", timestamp(as_of)),
        "embed_status": F.lit("pending"),
        "source_session_label": F.lit(None),
        **{c: F.lit(None) for c in ("deleted_at", "embed_error", "embed_model", "vec_rowid")},
    }
    out = [
        columns.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType if known_ids or f.name != "fact_id" else "string").alias(f.name)
        for f in FACTS
    ]
    return new.select(*out)


def pending_batch(facts: DataFrame, size: int = 8) -> DataFrame:
    """The oldest pending facts, deleted ones included."""
    return facts.where(F.col("embed_status") == "pending").orderBy("fact_id").limit(size)


def commit_embeddings(facts: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """Facts after a batch of results (fact_id, vec_id, error): done with their vector, or failed for good."""
    new = results.select("fact_id", F.col("vec_id").alias("__vec"), F.col("error").alias("__error"), F.lit(True).alias("__hit"))
    hit, ok = F.coalesce("__hit", F.lit(False)), F.col("__error").isNull()
    both = facts.join(new, "fact_id", "left")
    changed = {
        "embed_status": F.when(hit, F.when(ok, "done").otherwise("failed")).otherwise(F.col("embed_status")),
        "embed_error": F.when(hit, F.col("__error")).otherwise(F.col("embed_error")),
        "embed_model": F.when(hit & ok, model).otherwise(F.col("embed_model")),
        "vec_rowid": F.when(hit & ok, F.col("__vec")).otherwise(F.col("vec_rowid")),
    }
    return both.withColumns(changed).select(*facts.columns)


def status_of(results: DataFrame, model: str) -> DataFrame:
    """Rows of the status table from rows (fact_id, error); a fact's vector has its id."""
    ok = F.col("error").isNull()
    return results.select(
        "fact_id", F.when(ok, "done").otherwise("failed").alias("embed_status"), F.col("error").alias("embed_error"),
        F.when(ok, F.lit(model)).alias("embed_model"), F.when(ok, F.col("fact_id")).alias("vec_rowid"),
    )


def with_status(facts: DataFrame, status: DataFrame) -> DataFrame:
    """Facts with what embedding wrote about them; of several rows of one fact one that succeeded counts."""
    names = ("embed_status", "embed_error", "embed_model", "vec_rowid")
    best = F.min_by(F.struct(*names), F.struct(F.col("embed_status") != "done", "embed_model", "vec_rowid", "embed_error")).alias("__new")
    both = facts.join(status.groupBy("fact_id").agg(best), "fact_id", "left")
    hit = F.col("__new").isNotNull()
    return both.withColumns({n: F.when(hit, F.col(f"__new.{n}")).otherwise(F.col(n)) for n in names}).select(*facts.columns)


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last event; an aggregate, so a hot key is combined where it lies."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"__last.{v}").alias(v) for v in values])


def soft_delete(facts: DataFrame, deletions: DataFrame) -> DataFrame:
    """Facts with ``deleted_at`` of their last deletion (user_id, fact_id, at); one of an unknown fact, or by
    another user, changes nothing."""
    last = deletions.groupBy("user_id", "fact_id").agg(F.max("at").alias("__at"))
    both = facts.join(last, ["user_id", "fact_id"], "left")
    return both.withColumn("deleted_at", F.coalesce("__at", "deleted_at")).select(*facts.columns)


def status(facts: DataFrame) -> DataFrame:
    """user_id, fact_count of live facts, last_ingestion over all of them."""
    return facts.groupBy("user_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("fact_count"), F.max("created_at").alias("last_ingestion"))


def status_counts(facts: DataFrame) -> DataFrame:
    """user_id and how many facts have each status, deleted ones included; other statuses are left out."""
    return facts.groupBy("user_id").agg(*[F.count_if(F.col("embed_status") == s).alias(s) for s in STATUSES])


def model_counts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("embed_model").isNotNull()).groupBy("embed_model").agg(F.count(F.lit(1)).alias("n"))


def zero_vectors(vectors: DataFrame) -> DataFrame:
    """How many vectors of all users are zero."""
    return vectors.agg(F.count_if(vx.is_zero(F.col("embedding"))).alias("zero_vectors"))


def health(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, pending, failed, zero_vectors, healthy."""
    counts = status_counts(facts).select("user_id", "pending", "failed")
    fine = (F.col("pending") == 0) & (F.col("failed") == 0) & (F.col("zero_vectors") == 0)
    return counts.join(F.broadcast(zero_vectors(vectors))).withColumn("healthy", fine)  # one row


def export(facts: DataFrame) -> DataFrame:
    """Live facts, newest first, with timestamps and tags as text."""
    rows = facts.where(F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "fact_id")
    return rows.select(
        "fact_id", *EXPORTED, F.to_json("tags").alias("tags_json"), fm.iso(F.col("created_at")).alias("created_at"), fm.iso(F.col("deleted_at")).alias("deleted_at")
    )


def storage_bytes(spark, path: str) -> int:
    """Bytes of all files under a path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def fired(nudges: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each trigger type and whether it has fired."""
    seen = nudges.select("trigger_type").distinct().withColumn("__seen", F.lit(True))
    return triggers.join(seen, "trigger_type", "left").select("trigger_type", F.coalesce("__seen", F.lit(False)).alias("fired"))


def find_key(keys: DataFrame, secret: str) -> DataFrame:
    """The active row of a secret, which is stored hashed."""
    return keys.where((F.col("hashed_key") == F.sha2(F.lit(secret), 256)) & F.col("revoked_at").isNull())


def list_keys(keys: DataFrame, user: str) -> DataFrame:
    return keys.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "id")


def revoke(keys: DataFrame, key_id: str, at: datetime) -> DataFrame:
    return keys.withColumn("revoked_at", F.when(F.col("id") == key_id, timestamp(at)).otherwise(F.col("revoked_at")))


def create_key(spark: SparkSession, user: str, prefix: str, at: datetime, label: str | None = None) -> tuple[str, DataFrame]:
    """A new secret, shown once, and the row that is stored for it: its hash alone."""
    secret = f"{prefix}_{secrets.token_hex(32)}"
    row = (str(uuid.uuid4()), user, hashlib.sha256(secret.encode()).hexdigest(), label, at, None, None)
    return secret, spark.createDataFrame([row], API_KEYS)


def touch(keys: DataFrame, key_id: str, at: datetime) -> DataFrame:
    return keys.withColumn("last_used_at", F.when(F.col("id") == key_id, timestamp(at)).otherwise(F.col("last_used_at")))


def seed(spark: SparkSession, user: str, session: str, rows: list[tuple[str, float, list[str]]], as_of: datetime) -> DataFrame:
    """Fixed facts (content, confidence, tags) of a new user."""
    new = spark.createDataFrame([(user, session, *row) for row in rows], "user_id string, source_session_id string, content string, confidence double, tags array<string>")
    return ingest(new.withColumn("fact_id", F.xxhash64("user_id", "content")), as_of)


def deduplicate(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``new`` exchanges with ``skipped``: the content is known, or came earlier in the same batch. Rows without
    a hash are never skipped."""
    hashed = new.where(F.col("content_hash").isNotNull())
    firsts = hashed.groupBy("user_id", "content_hash").agg(F.min(F.struct("session_id", "turn")).alias("__first"))
    rows = hashed.join(firsts, ["user_id", "content_hash"])
    if existing is not None:
        known = existing.where(F.col("content_hash").isNotNull()).select("user_id", "content_hash").distinct().withColumn("__known", F.lit(True))
        rows = rows.join(known, ["user_id", "content_hash"], "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("boolean"))
    rows = rows.withColumn("skipped", (F.struct("session_id", "turn") != F.col("__first")) | F.coalesce("__known", F.lit(False))).drop("__first", "__known")
    return rows.unionByName(new.where(F.col("content_hash").isNull()).withColumn("skipped", F.lit(False)))
