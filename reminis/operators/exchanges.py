"""Retrieval over conversation exchanges, with a pluggable reranker."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.operators import retrieval as rt
from reminis.operators.ranking import top
from reminis.sources.tables import timestamp

# Fixed values of the scoring.
RRF_K, DECAY = 60, 0.012
LEAST_REACH, LEAST_POOL = 40, 20


def as_facts(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchanges in the shape retrieval takes: documents (their id is session and turn), and vectors."""
    key = F.struct("session_id", "turn")
    docs = exchanges.select(
        "user_id", key.alias("fact_id"), F.col("chunk_text").alias("content"), F.col("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    vectors = exchanges.where(F.col("embedding").isNotNull()).select("user_id", key.alias("fact_id"), key.alias("vec_id"), "embedding")
    return docs, vectors


def nearest(exchanges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, fact_id (session_id, turn), distance, rank of each query's k nearest exchanges of its user."""
    scored = rt.distances(as_facts(exchanges)[1], queries)
    return top(scored, ["query_id"], [F.asc("distance"), F.asc("fact_id")], k, "rank").drop("vec_id")


def search(
    exchanges: DataFrame, queries: DataFrame, limit: int, as_of: datetime, rerank: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """query_id, rank, session_id, turn, final_score. ``rerank`` (query text, exchange text) -> score orders the
    candidates where any of its scores is not zero; without one the fused order stays."""
    docs, _ = as_facts(exchanges)
    words = rt.bm25_rank(rt.tokens_of(docs), queries)
    rrf = rt.fused(words, nearest(exchanges, queries, max(LEAST_REACH, rt.reach(limit))), RRF_K)
    age = fm.age_in_days(F.col("created_at"), timestamp(as_of))
    rows = rrf.join(docs.select("fact_id", "created_at", "content"), "fact_id")
    scored = rows.withColumn("final_score", F.round(F.col("rrf") * fm.decay(F.lit(DECAY), age), 9))
    order = [F.desc("final_score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), F.asc("fact_id")]
    found = top(scored, ["query_id"], order, max(LEAST_POOL, limit), "__before")
    if rerank is not None:
        asked = F.broadcast(queries.select("query_id", F.col("text").alias("__text")))
        found = found.join(asked, "query_id").withColumn("__again", rerank(F.col("__text"), F.col("content")))
    else:
        found = found.withColumn("__again", F.lit(0.0))
    found = top(found, ["query_id"], [F.desc("__again"), F.asc("__before")], limit, "rank")
    return found.select("query_id", "rank", "fact_id.session_id", "fact_id.turn", "content", "created_at", "final_score")


def status(exchanges: DataFrame) -> DataFrame:
    return exchanges.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_ingestion"))
