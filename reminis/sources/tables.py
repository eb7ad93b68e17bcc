"""The store's tables, and their derivation from the star schema the driver supplies.

Schemas are explicit everywhere; old data gain new columns with defaults by ``evolve``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminis.functions import text as tx

#: Frozen time of the registered queries.
AS_OF = datetime(2024, 12, 31)
USER = "u0"
MODEL = "hashing-64"

FACTS = T.StructType([
    T.StructField("fact_id", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("decay_rate", T.StringType()),
    T.StructField("source_session_id", T.StringType()), T.StructField("source_session_label", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("deleted_at", T.TimestampNTZType()), T.StructField("embed_status", T.StringType()),
    T.StructField("embed_error", T.StringType()), T.StructField("embed_model", T.StringType()), T.StructField("vec_rowid", T.LongType()),
])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: What embedding has found out about a fact; the store and the stream both write and read it.
STATUS = T.StructType([
    T.StructField("fact_id", T.LongType()), T.StructField("embed_status", T.StringType()), T.StructField("embed_error", T.StringType()),
    T.StructField("embed_model", T.StringType()), T.StructField("vec_rowid", T.LongType()),
])
NUDGES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("trigger_type", T.StringType()), T.StructField("fired_at", T.TimestampNTZType()),
])
API_KEYS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("hashed_key", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_used_at", T.TimestampNTZType()), T.StructField("revoked_at", T.TimestampNTZType()),
])
#: What a column gets where old data lack it; all others get null.
DEFAULTS = {"confidence": 0.9, "decay_rate": "slow", "embed_status": "pending"}


def timestamp(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def evolve(old: DataFrame, schema: T.StructType = FACTS, defaults: dict = DEFAULTS) -> DataFrame:
    """``old`` in the form of ``schema``: missing columns are added, with their defaults; rows of older files among
    newer ones, which have nulls there, get the defaults as well."""
    have = set(old.columns)

    def column(name: str) -> Column:
        default = F.lit(defaults.get(name))
        return default if name not in have else F.coalesce(F.col(name), default) if name in defaults else F.col(name)

    return old.select([column(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days_before(as_of: datetime, days: Column) -> Column:
    return F.timestamp_add("DAY", (-days).cast("int"), timestamp(as_of))


def facts(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF) -> DataFrame:
    """Documents as facts of three users."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # One row for each id, so that the optimizer drops a join whose columns a query doesn't use.
    vectors = read(spark, sf_dir, "embeddings").select("vec_id").distinct()
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left").join(labels, docs.doc_id == labels.label_id, "left")
    d, failed = F.col("doc_id"), F.col("doc_id") % 17 == 0
    rate = F.floor(d / 3) % 4
    return rows.select(
        d.alias("fact_id"),
        F.concat(F.lit("u"), (d % 3).cast("string")).alias("user_id"),
        F.col("text").alias("content"),
        F.when(F.col("quality") == 1, 0.95).when(F.col("quality") == 0, 0.5).otherwise(0.75).alias("confidence"),
        F.when(rate == 0, "slow").when(rate == 1, "medium").when(rate == 2, "fast").otherwise("other").alias("decay_rate"),
        F.col("source").alias("source_session_id"),
        F.when(d % 7 == 0, F.col("lang")).alias("source_session_label"),
        F.when(d % 5 != 0, F.array("lang", "source")).alias("tags"),
        days_before(as_of, (d * 7) % 800).alias("created_at"),
        F.when(d % 10 == 9, timestamp(as_of)).alias("deleted_at"),
        F.when(failed, "failed").when(F.col("vec_id").isNotNull(), "done").otherwise("pending").alias("embed_status"),
        F.when(failed, "embedding failed").alias("embed_error"),
        F.when(~failed & F.col("vec_id").isNotNull(), MODEL).alias("embed_model"),
        F.when(~failed, F.col("vec_id")).alias("vec_rowid"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def exchanges(spark: SparkSession, sf_dir: str, as_of: datetime = AS_OF) -> DataFrame:
    """A user turn and the assistant's answer right after it, of three users; conversation i has vector i."""
    turns = read(spark, sf_dir, "conversations")
    following = F.struct(F.lead("role").over(_in_order()).alias("role"), F.lead("text").over(_in_order()).alias("text"))
    pairs = turns.withColumn("next", following).where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
    chunk = tx.exchange_text(F.col("text"), F.col("next.text"))
    c = F.col("conv_id")
    at = F.timestamp_add("MINUTE", (F.col("turn") - c * 60).cast("int"), timestamp(as_of))
    rows = pairs.select(
        F.concat(F.lit("u"), (c % 3).cast("string")).alias("user_id"), c.alias("session_id"), "turn", at.alias("timestamp"),
        F.col("text").alias("user_message"), F.col("next.text").alias("agent_response"), chunk.alias("chunk_text"),
        F.sha2(chunk, 256).alias("content_hash"),
    )
    return rows.join(vectors(spark, sf_dir), rows.session_id == F.col("vec_id"), "left").drop("vec_id")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


def queries(spark: SparkSession, sf_dir: str, items: int | None = 1, words: int = 5, suffix: str = "", user: str = USER) -> DataFrame:
    """(query_id, user_id, text, embedding): the first words of benchmark items 0 to ``items`` - 1, or of all with None,
    each with the vector of its number."""
    rows, own = read(spark, sf_dir, "benchmark"), vectors(spark, sf_dir)
    if items is not None:
        rows, own = rows.where(F.col("item_id") < items), own.where(F.col("vec_id") < items)
    first = F.array_join(F.slice(tx.raw_tokens(F.col("text")), 1, words), " ")
    asked = rows.select(F.col("item_id").alias("query_id"), F.lit(user).alias("user_id"), F.concat(first, F.lit(suffix)).alias("text"))
    return asked.join(own.dropDuplicates(["vec_id"]), asked.query_id == F.col("vec_id"), "left").drop("vec_id")
