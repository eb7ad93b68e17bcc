"""The registered queries. Each takes (spark, sf_dir); its SQL is in ``oracle``.

Doubles are rounded to six places. The default query is the first five tokens of benchmark item 0, asked by one
user; the frozen time is that of ``tables``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.functions import text as tx
from reminis.functions import vectors as vx
from reminis.operators import context as cx
from reminis.operators import exchanges as ex
from reminis.operators import lists as ls
from reminis.operators import postings as ps
from reminis.operators import retrieval as rt
from reminis.operators import store as st
from reminis.plans.oracle import ORACLE_SQL
from reminis.sources import markdown as md
from reminis.sources import tables as tb
from reminis.sources.versions import fingerprint, shared_folder

__all__ = ["ORACLE_SQL", "QUERIES"]

LIMIT = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def r6(column, name: str):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6).alias(name)


def of_user(df: DataFrame, user: str = tb.USER) -> DataFrame:
    return df.where(F.col("user_id") == user)


def asked_facts(spark, sf):
    """The facts of the user who asks; the predicate reaches the scan's projection."""
    return of_user(tb.facts(spark, sf))


def all_facts(spark, sf):
    """The facts of all users."""
    return tb.facts(spark, sf)


def long(column: str):
    return F.col(column).cast("long").alias(column)


# --- scans and writes ------------------------------------------------------------------------------------


@registered
def live_facts(spark, sf):
    rows = rt.live(all_facts(spark, sf))
    return rows.select("fact_id", "source_session_id", "source_session_label", "created_at", "decay_rate", "vec_rowid")


@registered
def embedded_vectors(spark, sf):
    owners = rt.live(all_facts(spark, sf)).select("vec_rowid")
    vectors = tb.vectors(spark, sf)
    found = vectors.join(owners, vectors.vec_id == owners.vec_rowid, "left_semi")
    return found.select("vec_id", F.size("embedding").cast("long").alias("dim"))


@registered
def pending_batch(spark, sf):
    return st.pending_batch(all_facts(spark, sf)).select("fact_id", F.length("content").cast("long").alias("content_chars"))


@registered
def ingest_defaults(spark, sf):
    docs = tb.read(spark, sf, "documents")
    new = docs.select(
        F.col("doc_id").alias("fact_id"), F.lit(tb.USER).alias("user_id"), F.col("text").alias("content"), F.col("source").alias("source_session_id"),
        F.when(F.col("doc_id") % 2 == 0, 0.5).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "fast").alias("decay_rate"),
    )
    rows = st.ingest(new, tb.AS_OF)
    return rows.groupBy(F.length("content").cast("long").alias("content_chars"), "confidence", "decay_rate", "embed_status").agg(F.count(F.lit(1)).alias("n"))


@registered
def soft_delete(spark, sf):
    events = tb.read(spark, sf, "events").where("event_type = 'error'")
    deletions = events.select(F.concat(F.lit("u"), F.col("event_id") % 3).alias("user_id"), F.col("user_id").alias("fact_id"), F.col("ts").alias("at"))
    rows = st.soft_delete(tb.facts(spark, sf), deletions)
    return rows.select("fact_id", "deleted_at", F.col("deleted_at").isNull().alias("is_live"))


@registered
def embed_commit(spark, sf):
    facts = all_facts(spark, sf)
    bad = F.col("fact_id") % 4 == 0
    results = facts.where("embed_status = 'pending'").select(
        "fact_id", F.when(~bad, F.col("fact_id") + 1_000_000).alias("vec_id"), F.when(bad, "no model").alias("error")
    )
    return st.commit_embeddings(facts, results, tb.MODEL).select("fact_id", "embed_status", "embed_error", "embed_model", "vec_rowid")


@registered
def schema_evolve(spark, sf):
    old = tb.read(spark, sf, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"), F.col("source").alias("source_session_id"))
    return tb.evolve(old).select("fact_id", "confidence", "decay_rate", "source_session_label", "deleted_at")


@registered
def export_facts(spark, sf):
    return st.export(all_facts(spark, sf))


@registered
def nudge_fired(spark, sf):
    events = tb.read(spark, sf, "events")
    nudges = events.where("value > 0").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("trigger_type"), F.col("ts").alias("fired_at"))
    triggers = events.select(F.col("event_type").alias("trigger_type")).distinct().union(spark.range(1).select(F.lit("first_activation")))
    return st.fired(nudges, triggers)


@registered
def api_key_lookup(spark, sf):
    customers = tb.read(spark, sf, "customer")
    secret = F.concat(F.lit("key_"), F.col("c_custkey"))
    keys = customers.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("u"), F.col("c_custkey") % 3).alias("user_id"), F.sha2(secret, 256).alias("hashed_key"),
        F.when(F.col("c_custkey") % 2 == 0, tb.timestamp(tb.AS_OF)).alias("revoked_at"),
    )
    return st.find_key(keys, "key_7").select("id", "user_id").unionByName(st.find_key(keys, "key_8").select("id", "user_id"))


# --- keyword scoring -------------------------------------------------------------------------------------


@registered
def tokenize(spark, sf):
    rows = rt.live(all_facts(spark, sf)).select("fact_id", tx.tokenize(F.col("content")).alias("t"))
    return rows.select("fact_id", F.size("t").cast("long").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"))


def _docs(spark, sf):
    return rt.tokens_of(all_facts(spark, sf))


@registered
def term_freq(spark, sf):
    return rt.term_hits(_docs(spark, sf), rt.query_terms(tb.queries(spark, sf))).select("fact_id", "term", "tf")


@registered
def doc_freq(spark, sf):
    docs = _docs(spark, sf)
    hits = rt.term_hits(docs, rt.query_terms(tb.queries(spark, sf)))
    return rt.inverse_frequency(hits, rt.corpus_stats(docs)).select("term", "df")


@registered
def idf(spark, sf):
    docs = _docs(spark, sf)
    hits = rt.term_hits(docs, rt.query_terms(tb.queries(spark, sf)))
    return rt.inverse_frequency(hits, rt.corpus_stats(docs)).select("term", r6("idf", "idf"))


@registered
def corpus_stats(spark, sf):
    rows = rt.corpus_stats(rt.tokens_of(tb.facts(spark, sf)))
    return rows.select("user_id", "n_docs", "total_len", r6("avgdl", "avgdl"))


@registered
def bm25_scores(spark, sf):
    return rt.bm25_scores(_docs(spark, sf), tb.queries(spark, sf)).select("fact_id", r6("bm25", "bm25"))


@registered
def bm25_rank(spark, sf):
    return rt.bm25_rank(_docs(spark, sf), tb.queries(spark, sf)).select("fact_id", r6("bm25", "bm25"), "rank")


# --- vectors ---------------------------------------------------------------------------------------------


@registered
def cosine_distance(spark, sf):
    return rt.distances(tb.vectors(spark, sf), tb.queries(spark, sf)).select("vec_id", r6("distance", "distance"))


@registered
def vector_rank(spark, sf):
    found = rt.vector_rank(asked_facts(spark, sf), tb.vectors(spark, sf), tb.queries(spark, sf), rt.reach(LIMIT))
    return found.select("fact_id", r6("distance", "distance"), "rank")


@registered
def vector_roundtrip(spark, sf):
    again = vx.from_text(vx.to_text(F.col("embedding")))
    return tb.vectors(spark, sf).select("vec_id", (again == F.col("embedding")).alias("ok"))


@registered
def ann_lsh(spark, sf):
    """Every vector whose id is divisible by 50 asks all vectors."""
    from reminis.operators.ann import search

    vectors = tb.vectors(spark, sf)
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(vectors, asked, LIMIT)


def lists_of(spark, sf) -> ls.VectorLists:
    """The lists of all vectors, stored in the shared folder: built once, and anew when the file has changed."""
    path = f"{shared_folder(spark)}/reminis-lists-{fingerprint(spark, f'{sf}/embeddings.parquet')}"
    return ls.VectorLists.open(spark, path) or ls.VectorLists.build(tb.vectors(spark, sf), path)


@registered
def ann_lists(spark, sf):
    """Every vector whose id is divisible by 50 probes half of the lists."""
    index = lists_of(spark, sf)
    asked = tb.vectors(spark, sf).where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return ls.search(index, asked, LIMIT, -(-len(index.centres) * 11 // 20))


@registered
def vector_rank_bounded(spark, sf):
    """Every benchmark item's nearest facts, item i as user i % 3, with bounds instead of comparing all."""
    owners = rt.live(all_facts(spark, sf)).where("vec_rowid is not null").select("user_id", "fact_id", F.col("vec_rowid").alias("vec_id"))
    asked = tb.queries(spark, sf, items=None).withColumn("user_id", F.concat(F.lit("u"), F.col("query_id") % 3))
    found = ls.exact(lists_of(spark, sf), owners, asked, rt.reach(LIMIT))
    return found.select("query_id", "fact_id", r6("distance", "distance"), "rank")


# --- fusion and search -----------------------------------------------------------------------------------


@registered
def rrf_fuse(spark, sf):
    queries = tb.queries(spark, sf)
    near = rt.vector_rank(asked_facts(spark, sf), tb.vectors(spark, sf), queries, rt.reach(LIMIT))
    return rt.fused(rt.bm25_rank(_docs(spark, sf), queries), near).select("fact_id", "bm25_rank", "vec_rank", r6("rrf", "rrf"))


@registered
def query_intent(spark, sf):
    asked = tb.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    suffixes = {0: "", 1: " latest news", 2: " we Used  to know", 3: " currently", 4: " now, historically and ever"}
    rows = asked.withColumn("text", F.concat("text", fm.cases(F.col("query_id") % 5, suffixes, "")))
    return rows.select("query_id", tx.intent(F.col("text")).alias("intent"))


@registered
def decay_lambda(spark, sf):
    rows = tb.facts(spark, sf).groupBy("decay_rate").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("decay_rate", fm.decay_lambda(F.col("decay_rate")).alias("per_day"), "n")


@registered
def decay_curve(spark, sf):
    age = fm.age_in_days(F.col("created_at"), tb.timestamp(tb.AS_OF))
    rows = rt.live(all_facts(spark, sf)).select("fact_id", "decay_rate", age.alias("age_days"))
    return rows.select("fact_id", r6("age_days", "age_days"), r6(fm.decay(fm.decay_lambda(F.col("decay_rate")), F.col("age_days")), "decay"))


@registered
def fused_rank(spark, sf):
    found = rt.fused_rank(asked_facts(spark, sf), tb.vectors(spark, sf), tb.queries(spark, sf), LIMIT, tb.AS_OF)
    return found.select("fact_id", r6("score", "score"), "rank")


@registered
def overlap_score(spark, sf):
    asked = F.broadcast(tb.queries(spark, sf).select("user_id", tx.rerank_tokens(F.col("text")).alias("words")))
    rows = rt.live(asked_facts(spark, sf)).join(asked, "user_id")
    return rows.select("fact_id", r6(tx.overlap(F.col("content"), F.col("words")), "overlap"))


def index_of(spark, sf) -> ps.KeywordIndex:
    """The keyword index of all users' facts, stored in the shared folder: built once, and anew when the files have changed."""
    path = f"{shared_folder(spark)}/reminis-index-{fingerprint(spark, *(f'{sf}/{name}.parquet' for name in ('documents', 'labels')))}"
    found = ps.KeywordIndex.open(spark, path)
    return found if found.segments else ps.KeywordIndex.build(all_facts(spark, sf), path)


def found_for(spark, sf, limit: int = LIMIT, suffix: str = "") -> DataFrame:
    return ps.hybrid_search(index_of(spark, sf), asked_facts(spark, sf), tb.vectors(spark, sf), tb.queries(spark, sf, suffix=suffix), limit, tb.AS_OF)


def as_result(found: DataFrame) -> DataFrame:
    return found.select(
        "rank", "fact_id", "source_session_id", "source_session_label", "created_at", F.to_json("tags").alias("tags_json"), r6("final_score", "final_score")
    )


@registered
def hybrid_search(spark, sf):
    return as_result(found_for(spark, sf))


@registered
def hybrid_search_recency(spark, sf):
    return as_result(found_for(spark, sf, suffix=" current"))


@registered
def hybrid_search_historical(spark, sf):
    return as_result(found_for(spark, sf, suffix=" history"))


@registered
def bm25_only_search(spark, sf):
    return as_result(ps.bm25_only_search(index_of(spark, sf), asked_facts(spark, sf), tb.queries(spark, sf), LIMIT, tb.AS_OF))


@registered
def multi_query_search(spark, sf):
    """Every item of the benchmark asks, item i as user i % 3."""
    asked = tb.queries(spark, sf, items=None).withColumn("user_id", F.concat(F.lit("u"), F.col("query_id") % 3))
    found = ps.hybrid_search(index_of(spark, sf), all_facts(spark, sf), tb.vectors(spark, sf), asked, LIMIT, tb.AS_OF)
    return found.select("query_id", "rank", "fact_id", r6("final_score", "final_score"))


# --- presentation ----------------------------------------------------------------------------------------


@registered
def memory_context(spark, sf):
    rows = cx.memory_context(found_for(spark, sf, 2 * cx.CONTEXT_FACTS))
    return rows.select("rank", "fact_id", "session_label", "created_at", r6("score", "score"))


@registered
def tool_search(spark, sf):
    rows = cx.tool_results(found_for(spark, sf, 20), tb.AS_OF)
    return rows.select("rank", "fact_id", r6("score", "score"), "age_in_days", "session_label")


@registered
def context_lines(spark, sf):
    found = found_for(spark, sf, 2 * cx.CONTEXT_FACTS).where(F.col("rank") <= cx.CONTEXT_FACTS)
    return cx.lines(found, tb.AS_OF).select("rank", "line")


def _block(spark, sf):
    found = found_for(spark, sf, 2 * cx.CONTEXT_FACTS).where(F.col("rank") <= cx.CONTEXT_FACTS)
    return cx.blocks(tb.queries(spark, sf), found, tb.AS_OF)


@registered
def context_block(spark, sf):
    return _block(spark, sf).select("block")


@registered
def injection_block(spark, sf):
    return cx.injections(_block(spark, sf)).select("block")


@registered
def search_report(spark, sf):
    return cx.reports(tb.queries(spark, sf), found_for(spark, sf, 5)).select("report")


@registered
def tier_counts(spark, sf):
    found = rt.fused_rank(asked_facts(spark, sf), tb.vectors(spark, sf), tb.queries(spark, sf), LIMIT, tb.AS_OF)
    return found.groupBy(F.trim(fm.tier(F.col("score"))).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@registered
def format_age(spark, sf):
    age = fm.age_in_days(F.col("created_at"), tb.timestamp(tb.AS_OF))
    return all_facts(spark, sf).select("fact_id", fm.age_label(age).alias("age_label"))


@registered
def format_age_cli(spark, sf):
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return tb.read(spark, sf, "events").select("event_id", fm.elapsed_label(F.greatest(seconds, F.lit(0))).alias("age_label"))


@registered
def format_bytes(spark, sf):
    size = F.octet_length("text").cast("long") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(1_000_000)
    return tb.read(spark, sf, "documents").select("doc_id", fm.bytes_label(size).alias("size_label"))


@registered
def confidence_map(spark, sf):
    levels = tb.read(spark, sf, "labels").select(F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low").otherwise("none").alias("level"))
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", fm.confidence_of(F.col("level")).alias("confidence"), "n")


@registered
def tags_parse(spark, sf):
    parsed = F.from_json(F.to_json("tags"), "array<string>")
    return all_facts(spark, sf).select(
        "fact_id", F.when(parsed.isNotNull(), F.size(parsed)).cast("long").alias("n_tags"), F.try_element_at(parsed, F.lit(1)).alias("first_tag")
    )


@registered
def excerpts(spark, sf):
    return all_facts(spark, sf).select(
        "fact_id", tx.excerpt(F.col("content"), 80, "...").alias("excerpt80"), F.length(tx.excerpt(F.col("content"), 200)).cast("long").alias("excerpt200_chars")
    )


# --- status ----------------------------------------------------------------------------------------------


@registered
def status(spark, sf):
    return st.status(tb.facts(spark, sf))


@registered
def health_status_counts(spark, sf):
    return st.status_counts(tb.facts(spark, sf))


@registered
def health_models(spark, sf):
    return st.model_counts(tb.facts(spark, sf))


@registered
def health_zero_vectors(spark, sf):
    return st.zero_vectors(tb.vectors(spark, sf))


@registered
def health(spark, sf):
    return st.health(tb.facts(spark, sf), tb.vectors(spark, sf))


# --- markdown and exchanges ------------------------------------------------------------------------------


@registered
def markdown_sections(spark, sf):
    docs = tb.read(spark, sf, "documents")
    page = F.concat(F.lit("intro\n## A\n"), "text", F.lit("\n### sub\n## B\n  short \n## C\nend of "), "source", F.lit(" ................\n"))
    rows = md.sections_of(docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(page).alias("text")))
    return rows.select("doc_id", long("section_no"), F.length("section").cast("long").alias("section_chars"))


def _exchanges(spark, sf):
    return of_user(tb.exchanges(spark, sf))


@registered
def exchange_scan(spark, sf):
    return tb.exchanges(spark, sf).orderBy(F.desc("timestamp")).select("session_id", "turn", "timestamp")


@registered
def format_exchange(spark, sf):
    return tb.exchanges(spark, sf).select("session_id", "turn", "content_hash")


@registered
def ingest_dedup(spark, sf):
    rows = tb.exchanges(spark, sf).drop("embedding")
    doubled = rows.unionByName(rows.where("session_id % 3 = 0").withColumn("turn", F.col("turn") + 1000))
    return st.deduplicate(doubled, rows.where("session_id % 5 = 1")).select("session_id", "turn", "content_hash", "skipped")


@registered
def exchange_status(spark, sf):
    return ex.status(tb.exchanges(spark, sf))


@registered
def exchange_search(spark, sf):
    found = ex.search(_exchanges(spark, sf), tb.queries(spark, sf), LIMIT, tb.AS_OF)
    return found.select("rank", "session_id", "turn", r6("final_score", "final_score"))


@registered
def pgvector_knn(spark, sf):
    found = ex.nearest(_exchanges(spark, sf), tb.queries(spark, sf), 50)
    return found.select("fact_id.session_id", "fact_id.turn", r6("distance", "distance"), "rank")


def _wrapped(turns: DataFrame) -> DataFrame:
    text = F.col("text")
    return turns.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[MEMORY]\nold\n[/MEMORY]\n \t"), text, F.lit(" [MEMORY]x[/MEMORY]\n"))).otherwise(text))


@registered
def last_user_message(spark, sf):
    found = cx.last_user_messages(_wrapped(tb.read(spark, sf, "conversations")))
    return found.select("conv_id", "turn", F.sha2("message", 256).alias("text_hash"))


def _prompts(turns: DataFrame) -> DataFrame:
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    envelope = F.concat(F.lit('Sender (untrusted metadata):\n```json\n{"id": 1}\n```\n\n[10:00] [chat] '), "text")
    return first.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "text only").when(F.col("conv_id") % 3 == 1, envelope).otherwise(F.col("text")).alias("prompt"))


@registered
def resolve_query(spark, sf):
    turns = tb.read(spark, sf, "conversations")
    found = cx.resolved_queries(_prompts(turns), turns.where("conv_id % 2 = 0"))
    return found.select("conv_id", F.sha2("query", 256).alias("query_hash"), "source_step")


@registered
def strip_blocks(spark, sf):
    turns = _wrapped(tb.read(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", F.sha2(tx.strip_blocks(F.col("text")), 256).alias("stripped_hash"))


@registered
def strip_envelope(spark, sf):
    turns = tb.read(spark, sf, "conversations")
    prompt = F.concat(F.when(F.col("turn") % 2 == 0, 'SENDER (untrusted metadata) :\n```json\n{"a": [1]}\n```\n').otherwise(""), F.lit("[12:01] [general]\n"), "text")
    return turns.select("conv_id", "turn", F.sha2(tx.strip_envelope(prompt), 256).alias("stripped_hash"))
