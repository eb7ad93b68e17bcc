"""Connected components of an edge list by alternating large-star and small-star rounds.

Every step is an aggregation with map-side combine or an equi-join that Spark can split where a node is hot;
no component is gathered in one task. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b of an ordered type. Returns (node, root) for every node that is not its
    component's smallest; an empty edge list gives no rows."""
    now = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    size = _size(now)
    while size[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, size = size, _size(after)
        now = after
        if before == size:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
