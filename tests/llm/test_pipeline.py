"""The stages in turn, on the smallest tables and on edge cases."""

import corpus_pipeline
from pyspark.sql import functions as F

from reminis.llm import quality, toxicity
from test_near_copies import brute_force


def test_stages_keep_their_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "best-fit packing"]
    good = corpus_pipeline.keep_good(spark, docs, sf)
    scores = quality.score(docs, quality.fit_on(docs, labels))
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect() if r.score >= 0.5}
    clean = corpus_pipeline.drop_toxic(spark, good, sf)
    scores = toxicity.score(good, toxicity.fit_on(good, labels))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.collect() if r.score < 0.5}
    kept = corpus_pipeline.drop_near_copies(spark, clean, sf)
    groups, _ = brute_force({r.doc_id: r.text for r in clean.collect()})  # 5 words, a similarity of 0.8
    assert {r.doc_id for r in kept.collect()} == set(groups.values())
    packed = corpus_pipeline.pack(spark, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_on_edge_cases(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 20000, "en", "s", 100000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            docs.count()
        assert before.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    extra = spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)).withColumn("fp", F.lit("f")).withColumn("component_id", F.lit(0))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, sf).columns == extra.columns
