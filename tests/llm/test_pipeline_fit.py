"""The pipeline's classifiers on inputs whose ids have no labels."""

import corpus_pipeline


def test_clean_documents_without_labels_stay(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_toxic):
        expected = {x.doc_id + 1000000 for x in stage(spark, docs, sf).collect()}  # fitted on the same documents
        found = {x.doc_id for x in stage(spark, strange, sf).collect()}
        assert found == expected and 0 < len(found) < docs.count()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = spark.createDataFrame([(i, 0, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    bad.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_toxic):
        assert stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_later_stages_need_no_documents_table(spark, sf, tmp_path):
    """The folder has all tables but documents once the first stage is written."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_toxic):
        expected = {x.doc_id for x in stage(spark, docs, sf).collect()}
        assert {x.doc_id for x in stage(spark, docs, str(tmp_path)).collect()} == expected and 0 < len(expected) < docs.count()
    strange = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "doc_id", "left_anti")
    for rows in (strange, clean):  # no label, or one class: nothing to fit on
        assert corpus_pipeline.drop_toxic(spark, rows, str(tmp_path)).count() == rows.count()
