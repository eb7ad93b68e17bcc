"""Hybrid retrieval for many users and queries in one plan.

Keyword scores (BM25) and exact nearest vectors each rank the facts of a query's user; reciprocal ranks are
added, boosted and decayed by age, and the best are reranked by keyword overlap. ``queries`` has the columns
query_id, user_id, text, embedding and is taken to be small (it is what users ask, not what is stored).
Vectors and contents stay out of the shuffles: facts are scored where they are read, and only ids and numbers
move until the pool of candidates is cut.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.functions import text as tx
from reminis.functions import vectors as vx
from reminis.operators.ranking import ranked, top
from reminis.sources.tables import timestamp

# Fixed values of the scoring.
K1, B = 1.5, 0.75
RRF_K, BOOST = 30, 2.0
POOL, SCORE_SHARE, OVERLAP_SHARE = 100, 0.7, 0.3
#: Queries that are sent to every task; more of them are joined by a shuffle.
SMALL_QUERIES = 1_000
#: Rows of candidates (ids and numbers) that are sent to every task.
SMALL_POOL = 1_000_000


def live(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("deleted_at").isNull())


def small(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def at_hand(queries: DataFrame) -> tuple[DataFrame, bool]:
    """The queries as a local table, and True, where they are counted to be so few; else as they are. The plan reads
    queries in many places: a local table is neither scanned nor joined again in each."""
    rows = queries.limit(SMALL_QUERIES + 1).toArrow()
    if rows.num_rows > SMALL_QUERIES:
        return queries, False
    return queries.sparkSession.createDataFrame(rows, queries.schema), True


def tokens_of(facts: DataFrame, *also: str) -> DataFrame:
    """user_id, fact_id, created_at, tokens, dl of live facts, and the columns ``also``."""
    rows = live(facts).select("user_id", "fact_id", "created_at", *also, tx.tokenize(F.col("content")).alias("tokens"))
    return rows.withColumn("dl", F.size("tokens"))


def carried(docs: DataFrame) -> list[str]:
    """Columns that go along with a fact's scores."""
    return [c for c in docs.columns if c not in ("user_id", "fact_id", "created_at", "tokens", "dl")]


def corpus_stats(docs: DataFrame) -> DataFrame:
    """user_id, n_docs, total_len, avgdl."""
    sums = docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("dl").cast("long")).alias("total_len"))
    return sums.withColumn("avgdl", F.col("total_len") / F.col("n_docs"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, user_id, term, qtf."""
    words = queries.select("query_id", "user_id", F.explode(tx.tokenize(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "user_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def term_hits(docs: DataFrame, terms: DataFrame, bounded: bool = True) -> DataFrame:
    """user_id, fact_id, term, tf, dl of the facts that hold a queried term."""
    asked = small(terms.select("user_id", "term").distinct(), bounded)
    words = docs.select("user_id", "fact_id", "dl", F.explode("tokens").alias("term"))
    return words.join(asked, ["user_id", "term"]).groupBy("user_id", "fact_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def inverse_frequency(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """user_id, term, df, idf, avgdl."""
    df = hits.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n_docs").cast("double")
    return df.join(stats, "user_id").select("user_id", "term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avgdl")


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, user_id, terms: each query's distinct terms and how often it has them."""
    words = tx.tokenize(F.col("text"))
    term = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.size(F.filter(words, lambda w: w == t)).alias("qtf")))
    return queries.select("query_id", "user_id", term.alias("terms"))


def asked_tokens(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``docs`` of the users who ask, with the tokens alone that one of the user's (few) queries has; ``dl`` stays."""
    asked = queries.groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list(tx.tokenize(F.col("text"))))).alias("__asked"))
    rows = docs.join(F.broadcast(asked), "user_id").withColumn("__asked", F.array_intersect("tokens", "__asked"))
    kept = F.filter("tokens", lambda w: F.array_contains("__asked", w))
    return rows.withColumn("tokens", F.when(F.size("__asked") > 0, kept).otherwise(F.slice("tokens", 1, 0))).drop("__asked")


def matched(docs: DataFrame, queries: DataFrame, bounded: bool = True) -> DataFrame:
    """query_id, fact_id, created_at, dl, hits (term, qtf, tf) of every live fact for each query of its user.
    Terms are counted where the facts are read; nothing is shuffled."""
    both = (asked_tokens(docs, queries) if bounded else docs).join(small(terms_of(queries), bounded), "user_id")
    # Absent terms, most of them, are found out first; neither look at the tokens runs a lambda for each.
    found = F.transform(
        F.filter("terms", lambda t: F.array_contains("tokens", t.term)),
        lambda t: F.struct(t.term.alias("term"), t.qtf.alias("qtf"), (F.size("tokens") - F.size(F.array_remove("tokens", t.term))).alias("tf")),
    )
    return both.select("query_id", "fact_id", "created_at", *carried(docs), "dl", found.alias("hits"))


def bm25_scores(docs: DataFrame, queries: DataFrame, bounded: bool = True) -> DataFrame:
    """query_id, fact_id, created_at, bm25 of every live fact; zero without a queried term."""
    rows = matched(docs, queries, bounded)
    # One read counts facts, lengths (under the null term) and the facts of each term.
    terms = F.explode(F.array_append("hits.term", F.lit(None).cast("string"))).alias("term")
    counts = rows.select("query_id", "dl", terms).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dl").cast("long")).alias("len"))
    whole = F.col("term").isNull()
    known = counts.groupBy("query_id").agg(  # a row for each query, of its few terms
        F.collect_list(F.when(~whole, F.struct("term", "n"))).alias("dfs"),
        F.max(F.when(whole, F.col("n"))).cast("double").alias("n_docs"),
        F.max(F.when(whole, F.col("len") / F.col("n"))).alias("avgdl"),
    )
    idf = F.transform("dfs", lambda t: F.struct(t.term, F.log((F.col("n_docs") - t.n + 0.5) / (t.n + 0.5) + 1)))
    known = known.select("query_id", F.map_from_entries(idf).alias("idfs"), "avgdl")

    def part(sum_, hit):
        tf = hit.tf.cast("double")
        return sum_ + hit.qtf * F.col("idfs")[hit.term] * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))

    scored = rows.join(small(known, bounded), "query_id", "left")
    bm25 = F.when(F.size("hits") > 0, F.aggregate("hits", F.lit(0.0), part)).otherwise(F.lit(0.0))
    return scored.select("query_id", "fact_id", "created_at", *carried(docs), F.round(bm25, 9).alias("bm25"))


def bm25_rank(docs: DataFrame, queries: DataFrame, bounded: bool = True) -> DataFrame:
    """``bm25_scores`` with rank; of equal scores the newest comes first, then the smallest id."""
    # Within a bucket of scores days would break the order, so scores above zero have one day.
    buckets = {
        "__score": F.when(F.col("bm25") > 0, F.floor(F.col("bm25") * 4)).otherwise(F.lit(-1)),
        "__day": F.when(F.col("bm25") > 0, F.lit("1970-01-01").cast("date")).otherwise(F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date"))),
    }
    order = [F.desc("bm25"), F.desc("created_at"), F.asc("fact_id")]
    return ranked(bm25_scores(docs, queries, bounded), ["query_id"], buckets, order, "rank")


def distances(vectors: DataFrame, queries: DataFrame, bounded: bool = True) -> DataFrame:
    """query_id, user_id, vec_id, distance of each vector to each query's, scored where vectors are read."""
    asked = queries.select("query_id", "user_id", F.col("embedding").alias("__q"), vx.norm(F.col("embedding")).alias("__qn"))
    own = vectors.select("*", vx.norm(F.col("embedding")).alias("__n"))
    keys = [c for c in ("user_id",) if c in vectors.columns]
    both = own.join(small(asked, bounded), keys) if keys else own.join(F.broadcast(asked))
    distance = F.round(vx.cosine_distance(F.col("embedding"), F.col("__q"), F.col("__n"), F.col("__qn")), 9) + F.lit(0.0)  # no negative zero
    return both.select(*[c for c in both.columns if not c.startswith("__") and c != "embedding"], distance.alias("distance"))


def embedded(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, fact_id, vec_id, embedding of live facts that have a vector."""
    owners = live(facts).where(F.col("vec_rowid").isNotNull()).select("user_id", "fact_id", F.col("vec_rowid").alias("vec_id"))
    return vectors.join(owners, "vec_id").select("user_id", "fact_id", "vec_id", "embedding")


def vector_rank(facts: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, bounded: bool = True) -> DataFrame:
    """query_id, user_id, fact_id, distance, rank of each query's ``k`` nearest facts; NaN is farthest."""
    scored = distances(embedded(facts, vectors), queries, bounded)
    return top(scored, ["query_id"], [F.asc("distance"), F.asc("vec_id"), F.asc("fact_id")], k, "rank").drop("vec_id")


def fused(by_words: DataFrame, by_vectors: DataFrame, k: int = RRF_K, also: tuple[str, ...] = (), how: str = "full_outer", bounded: bool = False) -> DataFrame:
    """query_id, fact_id, bm25_rank, vec_rank, rrf: the sum of reciprocal ranks; a missing one adds nothing. Columns
    ``also`` of the first go along. Where keywords rank every fact, a left join of (few) near ones shuffles nothing."""
    words = by_words.select("query_id", "fact_id", *also, F.col("rank").alias("bm25_rank"))
    near = small(by_vectors.select("query_id", "fact_id", F.col("rank").alias("vec_rank")), bounded)

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))

    return words.join(near, ["query_id", "fact_id"], how).withColumn("rrf", part("bm25_rank") + part("vec_rank"))


def reach(limit: int) -> int:
    """Vectors that are ranked for a limit."""
    return max(3 * limit, 50)


def fused_rank(
    facts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, as_of: datetime, bounded: bool | None = None, keep: int | None = None
) -> DataFrame:
    """query_id, fact_id, score, rank after boost and decay; ``keep`` bounds the ranks that are returned. Without
    ``bounded`` the queries are counted."""
    if bounded is None:
        queries, bounded = at_hand(queries)
    docs = tokens_of(facts, "decay_rate")
    near = vector_rank(facts, vectors, queries, reach(limit), bounded)
    few_near = bounded and SMALL_QUERIES * reach(limit) <= SMALL_POOL
    rrf = fused(bm25_rank(docs, queries, bounded), near, also=("created_at", "decay_rate"), how="left", bounded=few_near)
    asked = queries.select("query_id", tx.intent(F.col("text")).alias("intent"))
    age = fm.age_in_days(F.col("created_at"), timestamp(as_of))
    factor = BOOST * fm.decay(fm.adaptive_lambda(F.col("intent"), F.col("decay_rate")), age)
    rows = rrf.join(small(asked, bounded), "query_id")
    scored = rows.select("query_id", "fact_id", "bm25_rank", "vec_rank", F.round(F.col("rrf") * factor, 9).alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), F.asc("fact_id")]
    if keep is not None:
        return top(scored, ["query_id"], order, keep, "rank")
    level = F.when(F.col("score") > 0, F.floor(F.log10(F.greatest("score", F.lit(1e-9))) * 8)).otherwise(F.lit(-1000))
    return ranked(scored, ["query_id"], {"__level": level}, order, "rank")


def hybrid_search(
    facts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, as_of: datetime, bounded: bool | None = None
) -> DataFrame:
    """query_id, rank, fact columns and final_score of each query's best facts. Without ``bounded`` the queries are
    counted."""
    if bounded is None:
        queries, bounded = at_hand(queries)
    pool = fused_rank(facts, vectors, queries, limit, as_of, bounded, keep=POOL + limit)
    return reranked(facts, pool, queries, limit, bounded)


def reranked(facts: DataFrame, pool: DataFrame, queries: DataFrame, limit: int, bounded: bool) -> DataFrame:
    """The best of a pool (query_id, fact_id, score, rank) by keyword overlap, with the facts' columns."""
    contents = live(facts).select("fact_id", "content", "source_session_id", "source_session_label", "created_at", "tags")
    asked = queries.select("query_id", tx.rerank_tokens(F.col("text")).alias("__words"))
    rows = contents.join(small(pool, bounded and SMALL_QUERIES * (POOL + limit) <= SMALL_POOL), "fact_id").join(small(asked, bounded), "query_id")
    share = tx.overlap(F.col("content"), F.col("__words"))
    blended = F.when((F.col("rank") <= POOL) & share.isNotNull(), F.round(SCORE_SHARE * F.col("score") + OVERLAP_SHARE * share, 9)).otherwise(F.col("score"))
    rows = rows.withColumn("final_score", blended).withColumn("__pool", (F.col("rank") <= POOL).cast("int")).withColumnRenamed("rank", "__before")
    order = [F.desc("__pool"), F.desc("final_score"), F.asc("__before")]
    found = top(rows, ["query_id"], order, limit, "rank")
    return found.select(
        "query_id", "rank", "fact_id", "content", "source_session_id", "source_session_label", "created_at", "tags", "final_score"
    )


def bm25_only_search(facts: DataFrame, queries: DataFrame, limit: int, as_of: datetime, bounded: bool | None = None) -> DataFrame:
    """Without any vector: keyword order is kept, the limit is applied before decay, and neither the query's
    intent nor overlap counts. Without ``bounded`` the queries are counted."""
    if bounded is None:
        queries, bounded = at_hand(queries)
    docs = tokens_of(facts)
    first = top(
        bm25_scores(docs, queries, bounded), ["query_id"], [F.desc("bm25"), F.desc("created_at"), F.asc("fact_id")], limit, "rank"
    ).select("query_id", "rank", "fact_id", "bm25")
    return keyword_results(facts, first, limit, as_of, bounded)


def keyword_results(facts: DataFrame, first: DataFrame, limit: int, as_of: datetime, bounded: bool) -> DataFrame:
    """Results of keywords alone (query_id, rank, fact_id, bm25), decayed in the order that they have."""
    contents = live(facts).select("fact_id", "content", "source_session_id", "source_session_label", "created_at", "tags", "decay_rate")
    age = fm.age_in_days(F.col("created_at"), timestamp(as_of))
    score = F.round(F.col("bm25") * BOOST * fm.decay(fm.decay_lambda(F.col("decay_rate")), age), 9)
    return contents.join(small(first, bounded and SMALL_QUERIES * limit <= SMALL_POOL), "fact_id").select(
        "query_id", "rank", "fact_id", "content", "source_session_id", "source_session_label", "created_at", "tags", score.alias("final_score")
    )


def search(facts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, as_of: datetime) -> DataFrame:
    """Hybrid for users that have a fact with a vector, keywords alone for the others."""
    queries, bounded = at_hand(queries)
    having = live(facts).where(F.col("vec_rowid").isNotNull()).select("user_id").distinct()
    with_vectors = queries.join(having, "user_id", "left_semi")
    without = queries.join(having, "user_id", "left_anti")
    return hybrid_search(facts, vectors, with_vectors, limit, as_of, bounded).unionByName(bm25_only_search(facts, without, limit, as_of, bounded))
