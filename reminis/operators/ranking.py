"""Ranks over groups of any size.

``row_number`` over one window puts a whole group into one task. ``ranked`` splits groups into buckets whose
order the sort order follows, numbers rows within buckets, and adds the sizes of the buckets before; a window
over a group sees its buckets alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], buckets: dict[str, Column], order: list[Column], name: str) -> DataFrame:
    """``df`` with a 1-based row number among the rows of equal ``keys``. ``buckets`` are columns that come in
    descending order before ``order``; nulls are not allowed in them."""
    parts = [*keys, *buckets]
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    numbered = df.withColumns(buckets).withColumn("__nth", within)
    # Both uses of the numbered rows read one exchange, so rows are made and shuffled once.
    sizes = numbered.groupBy(*parts).agg(F.max("__nth").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(*[F.desc(b) for b in buckets]).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*parts, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    return numbered.join(bases, parts).withColumn(name, (F.col("__base") + F.col("__nth")).cast("long")).drop("__base", "__nth", *buckets)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered; Spark keeps no more of a group in each task."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, number.cast("long")).where(F.col(name) <= k)
