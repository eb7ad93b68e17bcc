"""From raw documents to packed training sequences, in stages that each take and return whole tables.

Every stage is a function of (session, documents, table folder) and works on all rows that the one before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminis.llm import near_copies, packing, quality, toxicity
from reminis.llm.common import materialize, read_table


def fitted(fit_on: Callable, ready: Callable, spark: SparkSession, docs: DataFrame, sf_dir: str) -> object | None:
    """A model of the labelled rows of ``docs``; None where these don't have both classes. Labels are sampled among those of
    ``docs``, so that samples are filled. The documents of ``sf_dir`` may be gone once the first stage is written, and no stage
    of a run needs them: they are read, where they are there, only for rows of another table, which no label knows."""
    labels = read_table(spark, sf_dir, "labels")
    model = fit_on(docs, labels, found=True)
    if ready(model):
        return model
    if labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").isEmpty():
        try:
            model = fit_on(read_table(spark, sf_dir, "documents"), labels, found=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return model if ready(model) else None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; all of them where there is nothing to fit it on."""
    model = fitted(quality.fit_on, lambda m: m.weight.any(), spark, docs, sf_dir)
    if model is None:
        return docs
    return quality.score(docs, model, "__quality").where(F.col("__quality") >= 0.5).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score under 0.5; all of them where there is nothing to fit them on."""
    model = fitted(toxicity.fit_on, lambda m: m.model is not None, spark, docs, sf_dir)
    if model is None:
        return docs
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: verified 5-word Jaccard similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: SQL cannot express the learned stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
