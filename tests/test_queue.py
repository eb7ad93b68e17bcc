"""The stream of pending facts by rows."""



from reminis.functions.embed import HashingEmbedder
from reminis.sources.tables import evolve
from reminis.streaming import pipelines as pl
from reminis.streaming import queue as qu


def write(spark, path, name, ids, status="pending"):
    rows = [(i, f"text {i}", status if i % 10 else "done") for i in ids]
    evolve(spark.createDataFrame(rows, "fact_id long, content string, embed_status string")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def batches(spark, path, folder, rows=8):
    """The ids of each batch of a query that runs until nothing is left, from its checkpoint."""
    seen = []

    def keep(batch, number):
        seen.append((number, [r.fact_id for r in batch.orderBy("fact_id").collect()]))

    query = qu.queued_facts(spark, path, rows).writeStream.foreachBatch(keep).option("checkpointLocation", folder).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return [ids for _, ids in seen if ids]


def test_one_file_of_many_facts_gives_small_batches_in_order(spark, tmp_path):
    path, folder = str(tmp_path / "facts"), str(tmp_path / "checkpoint")
    write(spark, path, "a", [i for i in range(1, 112) if i % 10][:100])
    found = batches(spark, path, folder)
    assert [len(b) for b in found] == [8] * 12 + [4]
    assert sum(found, []) == [i for i in range(1, 112) if i % 10][:100]
    assert batches(spark, path, folder) == []  # a restart repeats none
    write(spark, path, "b", range(200, 212))  # 200 and 210 are done
    write(spark, path, "c", [301])
    assert batches(spark, path, folder) == [[201, 202, 203, 204, 205, 206, 207, 208], [209, 211, 301]]


def test_a_batch_spans_files_and_an_empty_table_waits(spark, tmp_path):
    path, folder = str(tmp_path / "facts"), str(tmp_path / "checkpoint")
    assert batches(spark, path, folder) == []
    for i in range(5):
        write(spark, path, f"{i}", [10 * i + 1, 10 * i + 2, 10 * i])
    assert batches(spark, path, folder, rows=4) == [[1, 2, 11, 12], [21, 22, 31, 32], [41, 42]]


def test_embedding_reads_the_queue(spark, tmp_path):
    path, out = str(tmp_path / "facts"), str(tmp_path / "out")
    write(spark, path, "a", range(1, 30))
    query = pl.start_embedding(qu.queued_facts(spark, path), HashingEmbedder(), out, str(tmp_path / "checkpoint"), idle_seconds=0.1)
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{out}/status").count() == 27 and len(sizes) >= 4


def test_offsets_tell_batches(spark, tmp_path):
    path = str(tmp_path / "facts")
    write(spark, path, "a", range(1, 30))
    reader = qu.QueueReader({"path": f"file:{path}", "rows": "5"})
    first = reader.latestOffset()
    second = reader.latestOffset()
    rows = [x for p in reader.partitions(first, second) for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert rows == [6, 7, 8, 9, 11]
    again = qu.QueueReader({"path": path, "rows": "5"})
    again.partitions(second, second)
    assert again.partitions(first, second)[0].__dict__ == reader.partitions(first, second)[0].__dict__
    assert again.latestOffset()["row"] == 16
