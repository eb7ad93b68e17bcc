"""Approximate nearest vectors by locality-sensitive hashing, an option beside the exact search.

Vectors are unit length, where Euclidean distance orders as cosine distance does. Spark's model gives the buckets. Its own join
makes a row for each table and pair of a bucket, with both vectors, before it ranks; here the pairs that share a bucket are
compared in cells (``cells``) and never shuffled.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reminis.functions import vectors as vx
from reminis.operators import cells

BUCKET, TABLES, SEED = 0.8, 12, 11


def _unit(df: DataFrame, key: str) -> DataFrame:
    length = vx.norm(F.col("embedding"))
    scaled = F.transform("embedding", lambda x: x.cast("double") / F.nullif(length, F.lit(0.0)))
    return df.where(F.size("embedding") > 0).where(length > 0).select(key, "embedding", array_to_vector(scaled).alias("features"))


def search(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, vec_id, distance (cosine), rank among the candidates that share a bucket with the query."""
    own, asked = _unit(vectors, "vec_id"), _unit(queries, "query_id")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=BUCKET, numHashTables=TABLES, seed=SEED).fit(own)

    def marked(rows: DataFrame, key: str) -> DataFrame:
        marks = [vector_to_array(F.element_at("hashes", i + 1))[0].cast("int") for i in range(TABLES)]
        return model.transform(rows).select(key, "embedding", F.array(*marks).alias("mark"))

    def allowed(mark, marks):
        return (marks == mark).any(1)

    return cells.search(marked(own, "vec_id"), marked(asked, "query_id"), allowed, limit, 6, vectors.count(), queries.count())
