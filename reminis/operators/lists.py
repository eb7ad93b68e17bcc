"""Nearest vectors from lists stored by centroid: approximate by probing the nearest lists, exact by bounds.

``build`` finds centroids by k-means on a bounded sample (``SAMPLE`` vectors, those of the smallest hashes of the id), and
stores every vector in the list of its nearest centroid, in a folder of its own, with its distance from the centroid
(``reach``). Directions count, so vectors are scaled to length one, where the Euclidean distance e and the cosine distance d
have e * e = 2 d. A vector without a direction (null, empty, all zeros) is in list -1.

``search`` ranks the vectors of the ``probes`` lists whose centroids are nearest to a query, in cells (``cells``); lists that
none of few queries wants are not read. ``exact`` reads these first; the k-th distance
found there is a bar that the k nearest cannot exceed. By the triangle inequality a vector lies no nearer to the query than
its reach and the centroid's distance differ, and a list no nearer than the centroid's distance less the longest reach. So
lists beyond the bar are not read, vectors beyond it not compared, and the result is that of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminis.functions import vectors as vx
from reminis.operators import cells
from reminis.operators import retrieval as rt
from reminis.operators.cells import directions
from reminis.operators.ranking import top
from reminis.sources.versions import Versions

#: Vectors that the centroids are fitted on, and the most centroids: together they bound what a task and the driver hold.
SAMPLE, MOST_LISTS = 50_000, 1024
SEED, STEPS = 11, 10
#: What rounding may take from a distance of unit vectors.
MARGIN = 1e-5


def _unit(vectors: DataFrame) -> DataFrame:
    """The vectors that have a direction, with ``unit``: that direction."""
    length = vx.norm(F.col("embedding"))
    return vectors.withColumn("__length", length).where(F.col("__length") > 0).withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.col("__length"))).drop("__length")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0))


@dataclass
class VectorLists:
    """The stored lists under ``path``: ``centres`` in order, and the longest reach of each list."""

    spark: SparkSession
    path: str
    folder: str
    centres: np.ndarray
    longest: np.ndarray

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorLists | None:
        version, content = Versions(spark, path).current()
        if not version:
            return None
        rows = spark.read.parquet(f"{path}/{content['folder']}/centres").orderBy("list").collect()
        return cls(spark, path, content["folder"], np.array([r.centre for r in rows]).reshape(len(rows), -1), np.array([r.longest for r in rows]))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorLists:
        """Lists of ``vectors`` (vec_id, embedding; other columns go along), in place of what is there; as many as the square
        root of the number of vectors, if no number is given."""
        spark, versions = vectors.sparkSession, Versions(vectors.sparkSession, path)
        number = versions.current()[0] + 1
        folder = f"lists-{number}"
        sample = _unit(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
        many = vectors.count()
        k = max(1, min(lists or int(many**0.5), MOST_LISTS))
        found = sample.count()
        centres = np.array(KMeans(k=min(k, found), maxIter=STEPS, seed=SEED).fit(sample).clusterCenters()) if found > 1 else np.zeros((0, 0))
        names, at = vectors.columns, vectors.columns.index("embedding")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nearest, reach = np.full(len(batch), -1, np.int32), np.full(len(batch), np.nan)
                if len(centres) and len(batch):
                    own = directions(batch.column(at), centres.shape[1])
                    there = ~np.isnan(own).any(1)
                    away = apart(own[there], centres)
                    nearest[there] = away.argmin(1)
                    reach[there] = away.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach), pa.array(nearest)], names=[*names, "reach", "list"])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", reach double, list int"
        rows = vectors.mapInArrow(assign, shape)
        # A list of many vectors is written by several tasks: its vectors are dealt by their ids.
        rows.repartition(F.col("list"), F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("list").parquet(f"{path}/{folder}/vectors")
        stored = spark.read.schema(shape).parquet(f"{path}/{folder}/vectors")
        longest = {r.list: r.longest for r in stored.groupBy("list").agg(F.max("reach").alias("longest")).collect()}
        rows = [(i, c.tolist(), longest.get(i, -1.0)) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "list int, centre array<double>, longest double").coalesce(1).write.parquet(f"{path}/{folder}/centres")
        if not versions.publish(number, {"folder": folder, "shape": shape}):
            raise RuntimeError(f"another writer has published version {number} of {path}")
        return cls(spark, path, folder, centres, np.array([x[2] for x in rows]))

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(Versions(self.spark, self.path).current()[1]["shape"]).parquet(f"{self.path}/{self.folder}/vectors")

    def away(self, queries: DataFrame) -> DataFrame:
        """query_id, list, away (the centroid's distance from the query), bound (no vector of the list is nearer), nth (1 for
        the nearest). A query without a direction has no rows."""
        centres, longest = self.centres, self.longest

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(centres) or not len(batch):
                    continue
                own = directions(batch.column(1), centres.shape[1])
                there = np.flatnonzero(~np.isnan(own).any(1))
                away = apart(own[there], centres)
                nth = away.argsort(1, kind="stable").argsort(1) + 1
                lists = np.tile(np.arange(len(centres), dtype=np.int32), len(there))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(there, len(centres)))), pa.array(lists), pa.array(away.ravel()),
                        pa.array(np.maximum(away - longest, 0).ravel()), pa.array(nth.ravel()),
                    ],
                    names=["query_id", "list", "away", "bound", "nth"],
                )

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "embedding").mapInArrow(measure, f"query_id {kind}, list int, away double, bound double, nth long")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """``queries`` (query_id, embedding) with ``mark``: a bit for each list, set for the ``probes`` nearest. A query without a
        direction has none."""
        centres = self.centres

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.zeros((len(batch), max(1, -(-len(centres) // 64)) * 64), np.uint8)
                if len(centres) and len(batch):
                    own = directions(batch.column(1), centres.shape[1])
                    there = np.flatnonzero(~np.isnan(own).any(1))
                    near = apart(own[there], centres).argsort(1, kind="stable")[:, :probes]
                    bits[np.repeat(there, near.shape[1]), near.ravel()] = 1
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], names=["query_id", "embedding", "mark"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "embedding").mapInArrow(mark, f"query_id {kind}, embedding {queries.schema['embedding'].dataType.simpleString()}, mark array<bigint>")

    def of(self, wanted: DataFrame, bounded: bool) -> DataFrame:
        """The vectors of the lists in ``wanted`` (query_id, list, ...), once for each query that wants the list. Lists that few
        queries want are named, so that no other folder is read."""
        rows = self.vectors()
        if bounded:
            rows = rows.where(F.col("list").isin(sorted({r.list for r in wanted.select("list").distinct().collect()})))
        return rows.join(rt.small(wanted, bounded), "list")


def search(index: VectorLists, queries: DataFrame, limit: int, probes: int) -> DataFrame:
    """query_id, vec_id, distance, rank among the vectors of the ``probes`` lists nearest to each query (query_id, embedding).
    A query without a direction finds nothing."""
    queries, bounded = rt.at_hand(queries.select("query_id", "embedding"))
    rows = index.vectors()
    if bounded:  # lists that none of few queries wants are not read
        wanted = index.away(queries).where(F.col("nth") <= probes).select("list").distinct().collect()
        rows = rows.where(F.col("list").isin(sorted({r.list for r in wanted})))
    else:  # vectors without a direction are in none of the lists that are probed
        rows = rows.where("list >= 0")

    def allowed(mark, marks):
        own = marks[:, 0]
        return (mark[own >> 6] >> (own & 63)) & 1 == 1

    rows = rows.select("vec_id", "embedding", F.array(F.col("list").cast("long")).alias("mark"))
    return cells.search(rows, index.probed(queries, probes), allowed, limit, 9, rows.count(), queries.count())


def _scored(rows: DataFrame, queries: DataFrame, bounded: bool) -> DataFrame:
    asked = queries.select("query_id", F.col("embedding").alias("__q"), vx.norm(F.col("embedding")).alias("__qn"))
    both = rows.join(rt.small(asked, bounded), "query_id")
    distance = F.round(vx.cosine_distance(F.col("embedding"), F.col("__q"), vx.norm(F.col("embedding")), F.col("__qn")), 9) + F.lit(0.0)
    return both.withColumn("distance", distance).drop("__q", "__qn")


def compared(index: VectorLists, owners: DataFrame, queries: DataFrame, k: int, probes: int, bounded: bool) -> DataFrame:
    """query_id, user_id, vec_id, fact_id, distance of the vectors that are compared in the second round of ``exact``."""
    away = index.away(queries)
    users = queries.select("query_id", "user_id")

    def owned(wanted: DataFrame) -> DataFrame:
        return index.of(wanted, bounded).join(rt.small(users, bounded), "query_id").join(owners, ["user_id", "vec_id"])

    first = top(_scored(owned(away.where(F.col("nth") <= probes).select("query_id", "list")), queries, bounded), ["query_id"], [F.asc("distance")], k, "nth")
    bar = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(2 * F.max("distance")) + MARGIN).otherwise(F.lit(float("inf"))).alias("bar"))
    bar = users.join(bar, "query_id", "left").select("query_id", F.coalesce("bar", F.lit(float("inf"))).alias("bar"))
    if bounded:
        bar = bar.sparkSession.createDataFrame(bar.toArrow(), bar.schema)
    lists = away.join(rt.small(bar, bounded), "query_id").where(F.col("bound") <= F.col("bar")).select("query_id", "list", "away", "bar")
    # vectors without a direction come last: they count where too few others were found
    none = bar.where(F.col("bar") == float("inf")).select("query_id", F.lit(-1).alias("list"), F.lit(None).cast("double").alias("away"), "bar")
    rows = owned(lists.unionByName(none)).where(F.coalesce(F.abs(F.col("away") - F.col("reach")) <= F.col("bar"), F.lit(True)))
    return _scored(rows, queries, bounded).select("query_id", "user_id", "vec_id", "fact_id", "distance")


def exact(index: VectorLists, owners: DataFrame, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """query_id, user_id, fact_id, distance, rank: as ``retrieval.vector_rank``. ``owners``: vec_id, user_id, fact_id of the
    facts that have a vector. Queries without a direction, to which all vectors are equally far, are compared with all."""
    queries, bounded = rt.at_hand(queries)
    aimless = F.coalesce(vx.norm(F.col("embedding")), F.lit(0.0)) == 0
    order = [F.asc("distance"), F.asc("vec_id"), F.asc("fact_id")]
    own = compared(index, owners, queries.where(~aimless), k, probes, bounded)
    plain = rt.distances(index.vectors().select("vec_id", "embedding").join(owners, "vec_id"), queries.where(aimless), bounded)
    both = own.unionByName(plain.select(own.columns))
    return top(both, ["query_id"], order, k, "rank").drop("vec_id")
