"""Markdown notes as facts: daily notes and a memory file, cut into second-level sections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminis.functions import text as tx
from reminis.operators import store as st

#: Shorter sections hold nothing worth keeping.
LEAST_CHARS = 20
DAILY = r"^\d{4}-\d{2}-\d{2}\.md$"
# Confidence of facts from the memory file and from daily notes.
FILE_CONFIDENCE, DAILY_CONFIDENCE = 0.9, 0.85


def sections_of(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but text, with section_no (from 0) and section, of those long enough."""
    others = [c for c in pages.columns if c != "text"]
    rows = pages.select(*others, F.posexplode(tx.sections(F.col("text"))).alias("section_no", "section"))
    rows = rows.withColumn("section", tx.trim(F.col("section")))
    return rows.where(F.length("section") >= LEAST_CHARS)


def read_notes(spark: SparkSession, directory: str) -> DataFrame:
    """name, text of the daily notes of a directory, by name: the oldest day comes first."""
    files = spark.read.text(f"{directory}/*.md", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return files.where(F.col("name").rlike(DAILY)).orderBy("name")


def seed(spark: SparkSession, directories: list[str], memory_files: list[str], user: str, as_of: datetime, facts: DataFrame) -> DataFrame:
    """New facts from the first existing memory file and the first existing directory of daily notes; none for a
    user who has live facts already."""
    jvm = spark.sparkContext._jvm

    def exists(path: str) -> bool:
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    parts = []
    for path in [p for p in memory_files if exists(p)][:1]:
        pages = spark.read.text(path, wholetext=True).select(F.lit("MEMORY.md").alias("name"), F.col("value").alias("text"))
        parts.append(sections_of(pages).withColumn("confidence", F.lit(FILE_CONFIDENCE)).withColumn("session", F.lit("memory-file")))
    for path in [p for p in directories if exists(p)][:1]:
        pages = read_notes(spark, path)
        parts.append(sections_of(pages).withColumn("confidence", F.lit(DAILY_CONFIDENCE)).withColumn("session", F.regexp_replace("name", r"\.md$", "")))
    empty = facts.limit(0)
    if not parts:
        return empty
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    known = facts.where((F.col("user_id") == user) & F.col("deleted_at").isNull()).select(F.lit(1).alias("__any")).limit(1)
    new = rows.join(F.broadcast(known), how="left_anti").select(
        F.xxhash64("name", "section_no", "section").alias("fact_id"), F.lit(user).alias("user_id"), F.col("section").alias("content"),
        F.col("session").alias("source_session_id"), F.array(F.lit("seed"), "name").alias("tags"), "confidence",
    )
    return st.ingest(new, as_of)
