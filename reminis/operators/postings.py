"""A stored keyword index of facts, and searches that read it instead of the facts.

The index has segments, one for each ingest, until ``compact`` makes one of them. A segment holds

* ``terms``: for each live fact its terms with their counts, from which segments are merged; no search reads it, and no sort
  or window has these wide rows;
* ``docs``: for each live fact its length, and its places in the order of recency (newest first, then by id) among its user's
  facts and among those of its decay rate;
* ``postings``: for each user and term the facts that have it, by place. Files are dealt by a hash of user and term and
  sorted, so a search reads the directories and row groups of its terms;
* ``heads``: for each user, term and block of ``BLOCK`` places how many facts have the term, and what bounds their scores:
  the largest count and the smallest length, and one of the block's entries (that of the largest count);
* ``counts``: for each user and rate how many facts there are, and their length.

A search scores the facts that have a term of the query from their postings. All other facts score zero and stand in order
of recency after them, so the rank of any of these follows from its place and the number of hits before it; and
of each decay rate, where places, ages and scores fall together, only the newest can reach the pool. So no fact is tokenised
and nothing is made for each query and fact. Where the index has one segment and no fact was deleted since, places are read;
else they are counted anew among the users who ask, from ids and dates alone, and given to the postings.

A search for keywords alone skips blocks: a block counts if the sum of its terms' bounds reaches the ``limit``-th best of
the entries that the blocks name. (Facts deleted since may be among those entries: then all blocks are read.)
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from reminis.functions import formats as fm
from reminis.functions import text as tx
from reminis.operators import retrieval as rt
from reminis.operators.ranking import top
from reminis.operators.store import storage_bytes
from reminis.sources.tables import timestamp
from reminis.sources.versions import Versions

BLOCK = 128
#: Levels of keyword scores in one. Scores have nine places, so a level has less than a million of them, whatever the facts.
LEVELS = 1024
#: Facts for each bucket of postings, and the most buckets.
BUCKET_FACTS, MOST_BUCKETS = 50_000, 1024
#: Facts that one task numbers.
TASK_FACTS = 50_000
#: Entries of postings that one task makes or writes, those of which one task makes heads, and facts of which one task makes postings.
TASK_ENTRIES, TASK_HEADS, JOIN_FACTS = 1_000_000, 500_000, 20_000
#: Hits whose ranks are found with one group for each query; more are split into groups that the order follows.
FEW_HITS = 200_000
#: Blocks that are named in a scan's filter; more are joined.
FEW_BLOCKS = 1_000


def _recency() -> list:
    return [F.col("created_at").desc_nulls_last(), F.col("fact_id").asc()]


# --- writing ---------------------------------------------------------------------------------------------


def with_terms(facts: DataFrame) -> DataFrame:
    """user_id, fact_id, created_at, rate, dl, terms (term, tf; by term) of live facts."""
    rows = rt.live(facts).select("user_id", "fact_id", "created_at", F.col("decay_rate").alias("rate"), "content")
    cores = facts.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)  # few large files are no reason for few tasks
    rows = rows.withColumn("words", F.array_sort(tx.tokenize(F.coalesce("content", F.lit(""))))).drop("content")
    rows = rows.withColumn("dl", F.size("words"))
    begins = "if(dl = 0, slice(sequence(0, 1), 1, 0), filter(sequence(0, dl - 1), i -> i = 0 or words[i] <> words[i - 1]))"
    rows = rows.withColumn("begins", F.expr(begins))
    terms = "transform(begins, (b, k) -> struct(words[b] as term, coalesce(get(begins, k + 1), dl) - b as tf))"
    return rows.select("user_id", "fact_id", "created_at", "rate", "dl", F.expr(terms).alias("terms"))


def placed(rows: DataFrame, part: str, backwards: bool = False, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``pos`` and ``pos_rate``: their places from 0 in the order of recency among the user's, and among those
    of the user and rate. ``part`` is a column that the order follows (or runs against): rows are numbered within each of
    its values and the sizes of those before are added, so that a user with many facts is not one group. ``tasks``: how many
    number them, where it isn't left to the session."""
    out = rows if tasks is None else rows.repartitionByRange(tasks, part)  # serves both windows
    kinds = ((["user_id"], "pos"), (["user_id", "rate"], "pos_rate"))
    for keys, name in kinds:
        out = out.withColumn(f"__{name}", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*_recency())) - 1)
    for keys, name in kinds:
        sizes = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*keys).orderBy(F.desc(part) if backwards else F.asc(part)).rowsBetween(Window.unboundedPreceding, -1)
        bases = sizes.select(*[F.col(k).alias(f"__{k}") for k in [*keys, part]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, part]]
        out = out.join(bases, same).withColumn(name, (F.col("__base") + F.col(f"__{name}")).cast("long")).drop(*bases.columns, f"__{name}")
    return out


def tasks_for(many: int) -> int:
    """Tasks that number ``many`` facts."""
    return max(1, min(-(-many // TASK_FACTS), 20_000))


def spread(rows: DataFrame, path: str, many: int) -> DataFrame:
    """``rows`` sorted by user and recency over ranges, as a stored table with the range's number."""
    rows.repartitionByRange(tasks_for(many), F.col("user_id"), *_recency()).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def postings_of(terms: DataFrame, places: DataFrame, buckets: int, many: int, entries: int = 0) -> DataFrame:
    """bucket, user_id, term, pos, block, pos_rate, fact_id, created_at, rate, tf, dl. Facts with their terms pass by a table of
    the places of ``JOIN_FACTS`` facts or so, fewer where they have more than ``TASK_ENTRIES`` of all ``entries``; they are not sorted."""
    parts = max(terms.sparkSession.sparkContext.defaultParallelism, -(-many // JOIN_FACTS), -(-entries // TASK_ENTRIES))
    both = terms.repartition(parts, "row").join(places.select("row", "pos", "pos_rate").repartition(parts, "row").hint("shuffle_hash"), "row")
    words = both.select("user_id", "fact_id", "created_at", "rate", "dl", "pos", "pos_rate", F.inline("terms"))
    return words.select(
        bucket_of(buckets).alias("bucket"), "user_id", "term", "pos", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "pos_rate",
        "fact_id", "created_at", "rate", "tf", "dl",
    )


def by_files(spark: SparkSession, path: str, schema: StructType, parts: int) -> DataFrame:
    """The table that ``parts`` tasks wrote under ``path``, read by about as many. A scan packs files up to a size, and the many
    small rows of large splits are held until they are dealt out; so it has a session with a smaller one."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max(storage_bytes(spark, path) // parts, 2**20)))
    session.conf.set("spark.sql.files.openCostInBytes", "65536")
    return session.read.schema(schema).parquet(path)


def heads_of(postings: DataFrame, parts: int) -> DataFrame:
    """bucket, user_id, term, block, n, max_tf, min_dl, best: the entry of the largest count (of the shortest fact), tf above
    and 2 ** 31 - dl below 32 bits. Entries are dealt to ``parts`` ranges of blocks and counted there: rare terms make about as
    many heads as entries, so a table of them for each file, or each of the session's shuffle partitions, grows with the facts."""
    keys = ["bucket", "user_id", "term", "block"]
    best = F.shiftleft(F.col("tf").cast("long"), 32) + (F.lit(2**31) - F.col("dl"))
    return postings.repartitionByRange(parts, *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max(best).alias("best")
    )


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("user_id", "term"), F.lit(buckets)).cast("int")


@dataclass
class KeywordIndex:
    """The index under ``path``, as of the version that it was opened at."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[int, ...] = ()
    buckets: int = 1
    schemas: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        version, content = Versions(spark, path).current()
        return cls(spark, path, version, tuple(content.get("segments", ())), content.get("buckets", 1), content.get("schemas", {}))

    @classmethod
    def build(cls, facts: DataFrame, path: str) -> KeywordIndex:
        """A new index of the live facts in place of what is there."""
        old = cls.open(facts.sparkSession, path)
        return old._published(with_terms(facts), ())

    def add(self, facts: DataFrame) -> KeywordIndex:
        """The index with a segment of new facts."""
        return self._published(with_terms(facts), self.segments)

    def compact(self, deleted: DataFrame | None = None) -> KeywordIndex:
        """One segment of all facts but the deleted ones, made from their stored terms."""
        stored = self._table("terms" if "terms" in self.schemas else "docs")  # docs had them once
        return self._published(self._without(stored, deleted).select("user_id", "fact_id", "created_at", "rate", "dl", "terms"), ())

    def _published(self, rows: DataFrame, kept: tuple[int, ...]) -> KeywordIndex:
        """A segment of ``rows`` is written, then published. Another writer's version in between is an error: its facts
        would be lost."""
        number = self.version + 1
        staging = f"{self.path}/staging/{number}-{id(self)}"
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{self.path}/terms/seg={number}")
        terms = self.spark.read.schema(rows.schema).parquet(f"{self.path}/terms/seg={number}")
        many, entries = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
        buckets = self.buckets if kept else max(1, min(many // BUCKET_FACTS, MOST_BUCKETS))
        ranges = spread(terms.drop("terms"), f"{staging}/ranges", many)
        docs = placed(ranges, "part", tasks=tasks_for(many)).drop("part").sortWithinPartitions("user_id", "pos")
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/seg={number}")
        docs = self.spark.read.parquet(f"{self.path}/docs/seg={number}")
        docs.groupBy("user_id", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("len")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/seg={number}")
        parts = max(buckets, self.spark.sparkContext.defaultParallelism, entries // TASK_ENTRIES)
        posts = postings_of(terms, docs, buckets, many, entries)
        keys = ["bucket", "user_id", "term"]
        rows = posts.repartitionByRange(parts, *keys, "pos").sortWithinPartitions(*keys, "pos")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/seg={number}")
        stored = by_files(self.spark, f"{self.path}/postings/seg={number}", posts.schema, parts)
        rows = heads_of(stored, max(parts, entries // TASK_HEADS)).sortWithinPartitions(*keys, "block")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/heads/seg={number}")
        counts = self.spark.read.parquet(f"{self.path}/counts/seg={number}")
        schemas = {name: json.loads(StructType([*df.schema, StructField("seg", IntegerType())]).json()) for name, df in (("terms", terms), ("docs", docs), ("counts", counts), ("postings", posts), ("heads", heads_of(posts, parts)))}
        content = {"segments": [*kept, number], "buckets": buckets, "schemas": schemas}
        if not Versions(self.spark, self.path).publish(number, content):
            raise RuntimeError(f"another writer has published version {number} of {self.path}")
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)
        return KeywordIndex(self.spark, self.path, number, (*kept, number), buckets, schemas)

    # --- reading -----------------------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/seg={s}" for s in self.segments]
        return self.spark.read.schema(StructType.fromJson(self.schemas[name])).option("basePath", f"{self.path}/{name}").parquet(*paths)

    @cached_property
    def docs(self) -> DataFrame:
        return self._table("docs")

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @cached_property
    def heads(self) -> DataFrame:
        return self._table("heads")

    @cached_property
    def counts(self) -> DataFrame:
        return self._table("counts")

    def _alive(self, deleted: DataFrame | None) -> DataFrame:
        return self.docs if deleted is None else self.docs.join(deleted.select("user_id", "fact_id").distinct(), ["user_id", "fact_id"], "left_anti")

    def clean(self, deleted: DataFrame | None) -> bool:
        """Whether stored places are those of today."""
        return len(self.segments) == 1 and deleted is None

    def placed_docs(self, users: DataFrame, deleted: DataFrame | None) -> DataFrame:
        """user_id, fact_id, created_at, rate, pos, pos_rate of the facts of ``users``."""
        own = self._alive(deleted).join(F.broadcast(users), "user_id", "left_semi")
        if self.clean(deleted):
            return own.select("user_id", "fact_id", "created_at", "rate", "pos", "pos_rate")
        rows = own.select("user_id", "fact_id", "created_at", "rate", F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date")).alias("day"))
        return placed(rows, "day", backwards=True).drop("day")

    def sizes(self, users: DataFrame, deleted: DataFrame | None) -> DataFrame:
        """user_id, n, len: how many facts the users have, and the sum of their lengths."""
        if self.clean(deleted):
            return self.counts.join(F.broadcast(users), "user_id", "left_semi").groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        own = self._alive(deleted).join(F.broadcast(users), "user_id", "left_semi")
        return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").cast("long").alias("len"))

    def of_terms(self, table: DataFrame, terms: set[tuple[str, str]], deleted: DataFrame | None = None) -> DataFrame:
        """The rows of (user, term) in ``postings`` or ``heads``, and perhaps of some more pairs of the users and terms. Their
        names reach the scan."""
        users, words = sorted({u for u, _ in terms if u is not None}), sorted({t for _, t in terms})
        rows = table.where(F.col("term").isin(words) & F.col("user_id").isin(users))
        if self.buckets > 1:
            local = self.spark.createDataFrame(sorted((u, t) for u, t in terms if u is not None), "user_id string, term string")
            rows = rows.where(F.col("bucket").isin(sorted({r.bucket for r in local.select(bucket_of(self.buckets).alias("bucket")).collect()})))
        return self._without(rows, deleted)

    def _without(self, rows: DataFrame, deleted: DataFrame | None) -> DataFrame:
        return rows if deleted is None else rows.join(deleted.select("user_id", "fact_id").distinct(), ["user_id", "fact_id"], "left_anti")

    def frequencies(self, terms: set[tuple[str, str]], deleted: DataFrame | None) -> DataFrame:
        """user_id, term, n: how many facts have each term."""
        if deleted is None:
            return self.of_terms(self.heads, terms).groupBy("user_id", "term").agg(F.sum("n").alias("n"))
        return self.of_terms(self.postings, terms, deleted).groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n"))

    def terms_of(self, asked: list[tuple], queries: DataFrame, deleted: DataFrame | None) -> list[tuple]:
        """Of the terms of few queries (query_id, user_id, term, qtf) those that facts have, with what scores need of them
        (df, n_docs, avgdl). Facts, and those that have the terms, are counted in one job."""
        found = self.frequencies({(user, term) for _, user, term, _ in asked}, deleted).withColumn("len", F.lit(None).cast("long"))
        sizes = self.sizes(queries.select("user_id").distinct(), deleted).select("user_id", F.lit(None).cast("string").alias("term"), "n", "len")
        known = {(r.user_id, r.term): r for r in found.unionByName(sizes).collect()}
        out = []
        for query, user, term, qtf in asked:
            size, own = known.get((user, None)), known.get((user, term))
            if size and own:
                out.append((query, user, term, qtf, own.n, size.n, size.len / size.n))
        return out

    def terms_of_many(self, queries: DataFrame, deleted: DataFrame | None) -> DataFrame:
        """As ``terms_of``, for queries that are too many to be held: all by joins."""
        asked = rt.query_terms(queries)
        pairs = asked.select("user_id", "term").distinct()
        if deleted is None:
            df = self.heads.join(pairs, ["user_id", "term"]).groupBy("user_id", "term").agg(F.sum("n").alias("df"))
        else:
            df = self._without(self.postings.join(pairs, ["user_id", "term"]), deleted).groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
        both = asked.join(df, ["user_id", "term"]).join(self.sizes(queries.select("user_id").distinct(), deleted), "user_id")
        return both.select("query_id", "user_id", "term", "qtf", "df", F.col("n").alias("n_docs"), (F.col("len") / F.col("n")).alias("avgdl"))


_TERMS = "query_id {}, user_id string, term string, qtf long, df long, n_docs long, avgdl double"
_IDF = "ln((cast(n_docs as double) - df + 0.5D) / (df + 0.5D) + 1)"


def _part(tf: str, dl: str) -> str:
    return f"qtf * {_IDF} * (cast({tf} as double) * {rt.K1 + 1}D) / (cast({tf} as double) + {rt.K1}D * ({1 - rt.B}D + {rt.B}D * {dl} / avgdl))"


def hits_of(entries: DataFrame, terms: DataFrame, bounded: bool = True) -> DataFrame:
    """query_id, user_id, fact_id, created_at, rate, pos, pos_rate, bm25 of the facts that have a term of the query."""
    both = entries.join(rt.small(terms, bounded), ["user_id", "term"])
    own = [F.max(c).alias(c) for c in ("created_at", "rate", "pos", "pos_rate")]
    # Decimals add up to the same in any order: ``candidates`` reads hits more than once and joins them on their scores.
    score = F.sum(F.expr(_part("tf", "dl")).cast("decimal(38, 18)")).cast("double")
    return both.groupBy("query_id", "user_id", "fact_id").agg(*own, F.round(score, 9).alias("bm25"))


def chosen_blocks(heads: DataFrame, terms: DataFrame, limit: int, bounded: bool = True) -> DataFrame:
    """query_id, user_id, seg, block of the blocks that can have one of the ``limit`` best facts: each block has a fact with at
    least the score of the entry that it names for a term, so the ``limit``-th best of these is reached by ``limit`` facts."""
    both = heads.join(rt.small(terms, bounded), ["user_id", "term"])
    least = F.expr(_part("(best div 4294967296)", "(2147483648 - best % 4294967296)"))
    bounds = both.groupBy("query_id", "user_id", "seg", "block").agg(F.sum(F.expr(_part("max_tf", "min_dl"))).alias("most"), F.max(least).alias("least"))
    bar = top(bounds.select("query_id", "least"), ["query_id"], [F.desc("least")], limit, "nth").groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == limit, F.min("least")).otherwise(F.lit(0.0)).alias("bar")
    )
    # Scores are rounded to nine places before they are ranked, hence the margin.
    return bounds.join(rt.small(bar, bounded), "query_id").where(F.col("most") + 1e-8 >= F.col("bar")).select("query_id", "user_id", "seg", "block")


def few_candidates(entries: DataFrame, terms: DataFrame, docs: DataFrame, wanted: DataFrame, near: DataFrame) -> DataFrame:
    """As ``candidates``, for few hits: one shuffle gathers a query's hits, its near facts, and of each decay rate the
    newest facts up to ``wanted`` (query_id, user_id, cut: what is to be kept, and as many more as there are hits)."""
    blocks = wanted.withColumn("block", F.explode(F.expr(f"sequence(0L, (cut - 1) div {BLOCK})")))
    text = f"""
WITH parts AS (
  SELECT /*+ BROADCAST(t) */ t.query_id, e.fact_id, e.created_at, e.rate, e.pos, {_part("tf", "dl")} AS part, 1 AS hit, CAST(NULL AS BIGINT) AS vec_rank
  FROM {{entries}} e JOIN {{terms}} t ON e.user_id = t.user_id AND e.term = t.term
  UNION ALL
  SELECT /*+ BROADCAST(b) */ b.query_id, d.fact_id, d.created_at, d.rate, d.pos, 0D, 0, CAST(NULL AS BIGINT)
  FROM {{docs}} d JOIN {{blocks}} b ON d.user_id = b.user_id AND d.pos_rate div {BLOCK} = b.block WHERE d.pos_rate < b.cut
  UNION ALL
  SELECT /*+ BROADCAST(n) */ n.query_id, d.fact_id, d.created_at, d.rate, d.pos, 0D, 0, n.rank FROM {{docs}} d JOIN {{near}} n ON d.user_id = n.user_id AND d.fact_id = n.fact_id
),
facts AS (
  SELECT query_id, fact_id, max(created_at) AS created_at, max(rate) AS rate, max(pos) AS pos, round(sum(part), 9) AS bm25, max(hit) AS hit, max(vec_rank) AS vec_rank
  FROM (SELECT /*+ REPARTITION(query_id) */ * FROM parts) GROUP BY query_id, fact_id
)
SELECT query_id, fact_id, created_at, rate, bm25, vec_rank, if(hit = 1,
    row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, bm25 DESC, created_at DESC, fact_id),
    sum(hit) OVER (PARTITION BY query_id) + pos + 1 - sum(hit) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS bm25_rank
FROM facts
"""
    return entries.sparkSession.sql(text, entries=entries, terms=terms, docs=docs, blocks=blocks, near=near)


def dealt(hits: DataFrame) -> DataFrame:
    """``hits`` with ``stretch``, a range of ``TASK_FACTS`` places, and ``nth``, their number among those of one score and stretch."""
    rows = hits.withColumn("stretch", F.floor(F.col("pos") / TASK_FACTS).cast("long"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "bm25", "stretch").orderBy("pos")))


def candidates(hits: DataFrame, docs: DataFrame, queries: DataFrame, near: DataFrame, keep: int) -> DataFrame:
    """query_id, fact_id, created_at, rate, bm25, vec_rank, bm25_rank: the hits, the near facts (query_id, user_id, fact_id,
    rank), and of each decay rate the ``keep`` newest facts without a hit (and some more), with the ranks that they have among
    all facts. Hits of one score follow each other by place; they are numbered within ranges of ``TASK_FACTS`` places. Sums over the
    ranges of a score, the scores of a level and the levels of a query tell how many stand before, so neither a query's hits nor
    those of one score are one group. Hits are counted within blocks of places in the same way."""
    asked = queries.select("query_id", "user_id")
    rates = docs.select("user_id", "rate").distinct()
    text = f"""
WITH sizes AS (SELECT query_id, floor(bm25 * {LEVELS}) AS level, bm25, stretch, max(nth) AS n FROM {{dealt}} GROUP BY query_id, bm25, stretch),
scores AS (SELECT query_id, level, bm25, sum(n) AS n FROM sizes GROUP BY query_id, level, bm25),
levels AS (SELECT query_id, level, sum(n) AS n FROM scores GROUP BY query_id, level),
of_levels AS (SELECT query_id, level, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM levels),
of_scores AS (
  SELECT s.query_id, s.bm25, l.base + coalesce(sum(s.n) OVER (PARTITION BY s.query_id, s.level ORDER BY s.bm25 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM scores s JOIN of_levels l ON s.query_id = l.query_id AND s.level = l.level
),
bases AS (
  SELECT z.query_id, z.bm25, z.stretch, s.base + coalesce(sum(z.n) OVER (PARTITION BY z.query_id, z.bm25 ORDER BY z.stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM sizes z JOIN of_scores s ON z.query_id = s.query_id AND z.bm25 = s.bm25
),
ranked AS (SELECT d.*, base + nth AS bm25_rank FROM {{dealt}} d JOIN bases b ON d.query_id = b.query_id AND d.bm25 = b.bm25 AND d.stretch = b.stretch),
total AS (SELECT query_id, sum(n) AS n_hits FROM levels GROUP BY query_id),
by_rate AS (SELECT query_id, rate, pos_rate div {BLOCK} AS block, count(*) AS n FROM {{hits}} GROUP BY query_id, rate, pos_rate div {BLOCK}),
-- hits that may stand among the newest facts of a rate: those of blocks before which too few facts have no hit
cuts AS (
  SELECT query_id, rate, sum(if(block * {BLOCK} - before < {keep}, n, 0)) AS extra
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id, rate ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM by_rate)
  GROUP BY query_id, rate
),
wanted AS (
  SELECT q.query_id, q.user_id, r.rate, {keep} + coalesce(c.extra, 0) AS cut
  FROM {{asked}} q JOIN {{rates}} r ON q.user_id = r.user_id LEFT JOIN cuts c ON c.query_id = q.query_id AND c.rate <=> r.rate
),
newest AS (
  SELECT w.query_id, d.user_id, d.fact_id, d.created_at, d.rate, d.pos
  FROM (SELECT *, explode(sequence(0L, (cut - 1) div {BLOCK})) AS block FROM wanted) w
  JOIN {{docs}} d ON d.user_id = w.user_id AND d.rate <=> w.rate AND d.pos_rate div {BLOCK} = w.block WHERE d.pos_rate < w.cut
),
close AS (
  SELECT n.query_id, d.user_id, d.fact_id, d.created_at, d.rate, d.pos FROM {{near}} n JOIN {{docs}} d ON d.user_id = n.user_id AND d.fact_id = n.fact_id
),
zeros AS (
  SELECT * FROM (SELECT DISTINCT * FROM (SELECT * FROM newest UNION ALL SELECT * FROM close)) z
  WHERE NOT EXISTS (SELECT 1 FROM {{hits}} h WHERE h.query_id = z.query_id AND h.fact_id = z.fact_id)
),
by_block AS (SELECT query_id, pos div {BLOCK} AS block, count(*) AS n FROM {{hits}} GROUP BY query_id, pos div {BLOCK}),
within AS (
  SELECT *, pos div {BLOCK} AS block, sum(hit) OVER (PARTITION BY query_id, pos div {BLOCK} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own
  FROM (SELECT query_id, fact_id, pos, 1 AS hit FROM {{hits}} UNION ALL SELECT query_id, fact_id, pos, 0 AS hit FROM zeros)
),
edges AS (SELECT query_id, block, n FROM by_block UNION ALL SELECT DISTINCT query_id, block, 0 FROM within WHERE hit = 0),
earlier AS (
  SELECT query_id, block, max(before) AS before FROM (
    SELECT query_id, block, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY block RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM edges)
  GROUP BY query_id, block
),
counted AS (SELECT w.query_id, w.fact_id, e.before + w.own AS before FROM within w JOIN earlier e ON w.query_id = e.query_id AND w.block = e.block WHERE w.hit = 0),
every AS (
  SELECT query_id, fact_id, created_at, rate, bm25, bm25_rank FROM ranked
  UNION ALL
  SELECT z.query_id, z.fact_id, z.created_at, z.rate, 0D, coalesce(t.n_hits, 0) + z.pos + 1 - c.before
  FROM zeros z JOIN counted c ON z.query_id = c.query_id AND z.fact_id = c.fact_id LEFT JOIN total t ON t.query_id = z.query_id
)
SELECT e.query_id, e.fact_id, e.created_at, e.rate, e.bm25, n.rank AS vec_rank, e.bm25_rank FROM every e LEFT JOIN {{near}} n ON n.query_id = e.query_id AND n.fact_id = e.fact_id
"""
    return hits.sparkSession.sql(text, hits=hits, dealt=dealt(hits), docs=docs, asked=asked, rates=rates, near=near)


# --- searching -------------------------------------------------------------------------------------------


@dataclass
class Asked:
    """What a search reads from the index for its queries. ``room`` has, for few queries, how many hits each has at most,
    and is None where the hits are many."""

    index: KeywordIndex
    queries: DataFrame
    bounded: bool
    deleted: DataFrame | None
    terms: DataFrame
    room: dict | None = None
    named: set = field(default_factory=set)

    @classmethod
    def of(cls, index: KeywordIndex, queries: DataFrame, deleted: DataFrame | None = None) -> Asked:
        # What is asked of the queries' texts is found out as they are counted.
        rows = queries.withColumns({"intent": tx.intent(F.col("text")), "__terms": tx.tokenize(F.col("text"))}).limit(rt.SMALL_QUERIES + 1).toArrow()
        if rows.num_rows > rt.SMALL_QUERIES:
            return cls(index, queries.withColumn("intent", tx.intent(F.col("text"))), False, deleted, index.terms_of_many(queries, deleted))
        asked = [(q, u, term, n) for q, u, words in zip(*(rows.column(c).to_pylist() for c in ("query_id", "user_id", "__terms"))) for term, n in Counter(words or ()).items()]
        local = index.spark.createDataFrame(rows.drop_columns(["__terms"]), StructType([*queries.schema, StructField("intent", StringType())]))
        found = index.terms_of(asked, local, deleted)
        terms = index.spark.createDataFrame(found, _TERMS.format(queries.schema["query_id"].dataType.simpleString()))
        room = {(q, u): 0 for q, u in zip(rows.column("query_id").to_pylist(), rows.column("user_id").to_pylist())}
        for q, u, _, _, df, _, _ in found:
            room[q, u] += df
        named = {(user, term) for _, user, term, *_ in found}
        return cls(index, local, True, deleted, terms, room if sum(room.values()) <= FEW_HITS else None, named)

    def rows(self, table: DataFrame) -> DataFrame:
        """The rows of the queries' terms in a table of the index."""
        if self.bounded:
            return self.index.of_terms(table, self.named)
        return table.join(self.terms.select("user_id", "term").distinct(), ["user_id", "term"])

    def entries(self) -> DataFrame:
        return self.index._without(self.rows(self.index.postings), self.deleted)

    def hits(self) -> DataFrame:
        return hits_of(self.entries(), self.terms, self.bounded)

    def best_hits(self, limit: int) -> DataFrame:
        """The hits of the blocks that can have one of the ``limit`` best."""
        if self.deleted is not None:
            return self.hits()
        entries, blocks = self.entries(), chosen_blocks(self.rows(self.index.heads), self.terms, limit, self.bounded)
        if self.bounded:
            rows = blocks.limit(FEW_BLOCKS + 1).collect()
            if len(rows) <= FEW_BLOCKS:  # then their numbers reach the scan
                entries = entries.where(F.col("block").isin(sorted({r.block for r in rows})))
                blocks = self.index.spark.createDataFrame(rows, blocks.schema)
        kept = entries.join(rt.small(blocks.select("user_id", "seg", "block").distinct(), self.bounded), ["user_id", "seg", "block"], "left_semi")
        return hits_of(kept, self.terms, self.bounded)

    def docs(self) -> DataFrame:
        return self.index.placed_docs(self.queries.select("user_id").distinct(), self.deleted)

    def candidates(self, near: DataFrame, keep: int) -> DataFrame:
        entries, docs = self.entries(), self.docs()
        if not self.index.clean(self.deleted):  # places of postings are those of their segment, as it was written
            now = docs.select("user_id", "fact_id", "pos", "pos_rate")
            entries = entries.drop("pos", "pos_rate").join(now, ["user_id", "fact_id"])
        if self.room is None:
            return candidates(hits_of(entries, self.terms, self.bounded), docs, self.queries, near, keep)
        kind = self.queries.schema["query_id"].dataType.simpleString()
        wanted = self.index.spark.createDataFrame([(*key, keep + n) for key, n in self.room.items()], f"query_id {kind}, user_id string, cut long")
        return few_candidates(entries, self.terms, docs, wanted, near)


def pool(asked: Asked, near: DataFrame, keep: int, as_of: datetime) -> DataFrame:
    """query_id, fact_id, bm25_rank, vec_rank, score, rank of each query's ``keep`` best facts after boost and decay; ``near``
    are its nearest (query_id, user_id, fact_id, rank)."""
    rows = asked.candidates(near, keep)
    rows = rows.join(rt.small(asked.queries.select("query_id", "intent"), asked.bounded), "query_id")
    rrf = F.expr(f"coalesce(1D / ({float(rt.RRF_K)}D + bm25_rank), 0D) + coalesce(1D / ({float(rt.RRF_K)}D + vec_rank), 0D)")
    age = fm.age_in_days(F.col("created_at"), timestamp(as_of))
    factor = rt.BOOST * fm.decay(fm.adaptive_lambda(F.col("intent"), F.col("rate")), age)
    scored = rows.select("query_id", "fact_id", "bm25_rank", "vec_rank", F.round(rrf * factor, 9).alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), F.asc("fact_id")]
    return top(scored, ["query_id"], order, keep, "rank")


def held(rows: DataFrame, bounded: bool) -> DataFrame:
    """The pool of few queries as a local table: at most POOL + limit rows of numbers for each of them."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema) if bounded else rows


def hybrid_search(
    index: KeywordIndex, facts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, as_of: datetime, deleted: DataFrame | None = None
) -> DataFrame:
    """As ``retrieval.hybrid_search``, with the keyword part from the index. ``deleted``: facts (user_id, fact_id) that were
    deleted since the index has them."""
    asked = Asked.of(index, queries, deleted)
    near = rt.vector_rank(facts, vectors, asked.queries, rt.reach(limit), asked.bounded).select("query_id", "user_id", "fact_id", "rank")
    found = held(pool(asked, near, rt.POOL + limit, as_of), asked.bounded)
    return rt.reranked(facts, found, asked.queries, limit, asked.bounded)


def bm25_only_search(index: KeywordIndex, facts: DataFrame, queries: DataFrame, limit: int, as_of: datetime, deleted: DataFrame | None = None) -> DataFrame:
    """As ``retrieval.bm25_only_search``: blocks that cannot have one of the first ``limit`` are not read."""
    asked = Asked.of(index, queries, deleted)
    hits = asked.best_hits(limit).select("query_id", "user_id", "fact_id", "created_at", "bm25")
    docs = asked.docs().join(rt.small(asked.queries.select("query_id", "user_id"), asked.bounded), "user_id")
    # A term of ``limit`` facts leaves no room for facts without a hit; else the newest follow, of which some may be hits.
    room = asked.terms.groupBy("query_id").agg(F.sum("df").alias("n"), F.max("df").alias("most"))
    docs = docs.join(rt.small(room, asked.bounded), "query_id", "left").where((F.coalesce("most", F.lit(0)) < limit) & (F.col("pos") < limit + F.coalesce("n", F.lit(0))))
    newest = docs.select("query_id", "user_id", "fact_id", "created_at", F.lit(0.0).alias("bm25"))
    both = hits.unionByName(newest).groupBy("query_id", "fact_id").agg(F.first("created_at").alias("created_at"), F.max("bm25").alias("bm25"))
    first = held(top(both, ["query_id"], [F.desc("bm25"), F.desc("created_at"), F.asc("fact_id")], limit, "rank").drop("created_at"), asked.bounded)
    return rt.keyword_results(facts, first, limit, as_of, asked.bounded)


def search(
    index: KeywordIndex, facts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, as_of: datetime, deleted: DataFrame | None = None
) -> DataFrame:
    """As ``retrieval.search``: hybrid for users that have a fact with a vector, keywords alone for the others."""
    queries, _ = rt.at_hand(queries)
    having = rt.live(facts).where(F.col("vec_rowid").isNotNull()).select("user_id").distinct()
    parts = [(hybrid_search, (index, facts, vectors), "left_semi"), (bm25_only_search, (index, facts), "left_anti")]
    both = [find(*own, queries.join(having, "user_id", how).select(queries.columns), limit, as_of, deleted) for find, own, how in parts]
    return both[0].unionByName(both[1])
