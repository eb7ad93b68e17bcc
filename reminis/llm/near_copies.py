"""Near-dedup on word shingles: one document of each group of near copies stays.

Two texts are linked where the Jaccard similarity of their sets of shingles of ``WORDS`` words is at least
``SIMILARITY``; a group is a component of links. Texts with the same set are one node (``fp``, a 64-bit hash of the
set). Candidates come from two searches. One is operator 6: texts whose SimHash fingerprints the Gray-order index
links, directly or by others, are one bucket. 64 bits cannot show all: texts of similarity 0.8 differ in ten of them,
further than an index reaches. So MinHash adds ``BANDS`` keys of ``ROWS`` minima each; a pair of similarity 0.8
shares none with a chance of 4 in 10,000. Every pair that shares a bucket or key is verified on the sets themselves unless links already
connect it, so what is passed on is a spanning forest of true links. Keys with the same members are one bucket.

A crowd, a bucket of over ``hot`` members, never meets in one task and is not compared chunk by chunk either: it is dealt
into chunks of ``hot`` members, and the member with the smallest hash is in each of them, so each set is shipped once. After
the components of those links, only members outside the crowd's largest component go on, and meet all others: with f of
them and c in the largest component, f * ceil(c / hot) + c * ceil(f / hot) sets are shipped for that, about 2 c where few
are left and none where all are linked. So no pair of unlinked members is left out, whatever its chunks.

The survivor of a group is the row with the smallest id (null ids come last), then the smallest set hash, then the
smallest text. It is found by id and set together, so rows that share an id are told apart.

Defined cases: texts without words (null, empty, white space) have the same set; fewer words than a shingle make
one shingle of all of them; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, mix64, utf8_of
from .components import connected_components
from .minhash import _A, _B, SIMILARITY, WORDS, shingles
from .simhash import fingerprints_of, near_components

BANDS = 20
ROWS = 5
HOT = 1024


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of shingles one after another, where each begins, and a hash of each set."""
    x, begin = shingles(data, offsets, words)
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    first = np.append(True, (x[1:] != x[:-1]) | (row[1:] != row[:-1]))
    x, row = x[first], row[first]
    begin = np.searchsorted(row, np.arange(len(begin)))
    return x, begin, mix64(np.add.reduceat(mix64(x + np.uint64(0x9E3779B97F4A7C15)), begin))


def band_keys(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The keys of each set: sets x BANDS."""
    out = np.empty((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * _A[k] + _B[k], begin))
        out[:, band] = key
    return out


def forest(sets: list[np.ndarray], similarity: float, label: np.ndarray | None = None) -> np.ndarray:
    """For each set the first member of its component under links of at least that similarity. Every pair is
    compared unless links found before connect it; ``label`` has the first members that are known so far."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), np.int64)
    label = np.arange(len(sets)) if label is None else label.copy()
    for i in range(len(sets) - 1):
        fits = np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9
        others = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & fits)
        if not len(others):
            continue
        mark[codes[starts[i] : starts[i] + sizes[i]]] = 1
        n = sizes[others]
        begin = np.cumsum(n) - n
        shared = np.add.reduceat(mark[codes[np.repeat(starts[others] - begin, n) + np.arange(int(n.sum()))]], begin)
        mark[codes[starts[i] : starts[i] + sizes[i]]] = 0
        linked = others[shared >= similarity * (n + sizes[i] - shared) - 1e-9]
        joined = np.unique(np.append(label[linked], label[i]))
        label[np.isin(label, joined)] = joined[0]
    return label


def with_set(docs: DataFrame, words: int, column: str) -> DataFrame:
    """``docs`` with the hash of each text's set."""
    at = docs.columns.index("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(at))
            found = [distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)[2] for a, b in blocks(data, offsets)]
            fp = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, column])

    return docs.mapInArrow(compute, docs.select("*").schema.add(column, "long"))


def _chunk(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), chunks).cast("int")


def dealt_once(members: DataFrame, hot: int) -> DataFrame:
    """(bucket, fp, comp) from ``members`` (g, n, fp): each once in its bucket or, of a crowd, in one of its chunks, and a
    crowd's first member in all of them. Nothing is known of components: ``comp`` is ``fp``."""
    chunks = F.ceil(F.col("n") / hot).cast("int")
    lead = members.where(F.col("n") > hot).groupBy("g", "n").agg(F.min("fp").alias("fp"))
    lead = lead.withColumns({"own": _chunk(chunks), "at": F.explode(F.sequence(F.lit(0), chunks - 1))}).where("at != own")
    rows = members.withColumn("at", _chunk(chunks)).select("g", "at", "fp").union(lead.select("g", "at", "fp"))
    return rows.select(F.xxhash64("g", "at").alias("bucket"), "fp", F.col("fp").alias("comp"))


def dealt_rest(members: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """(bucket, fp, comp) of the crowds whose members are not all of one component: those outside the largest one meet each
    other and all of the largest."""
    crowds = members.where(F.col("n") > hot).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    crowds = crowds.select("g", "n", "fp", F.coalesce("root", "fp").alias("comp"))
    sizes = crowds.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("g").agg(F.max(F.struct("size", "comp")).alias("l")).select("g", F.col("l.comp").alias("main"), "l.size")
    both = crowds.join(largest, "g").where("size < n").withColumn("lone", F.col("comp") != F.col("main"))
    few, many = F.ceil((F.col("n") - F.col("size")) / hot).cast("int"), F.ceil(F.col("size") / hot).cast("int")
    lone = both.where("lone").withColumn("own", _chunk(few))
    among = lone.withColumn("other", F.explode(F.sequence(F.lit(0), few - 1)))
    among = among.select(F.xxhash64("g", F.lit("rest"), F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp", "comp")
    out = lone.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1))).select("g", "own", "other", "fp", "comp")
    of_main = both.where("not lone").withColumns({"own": F.explode(F.sequence(F.lit(0), few - 1)), "other": _chunk(many)})
    met = out.union(of_main.select("g", "own", "other", "fp", "comp"))
    return among.union(met.select(F.xxhash64("g", F.lit("main"), "own", "other").alias("bucket"), "fp", "comp"))


def components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(fp, least) of every distinct set with the smallest id that has it, and (node, root) of those sets that
    are not the smallest of their component."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in blocks(data, offsets):
                x, begin, fp = distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                keys = band_keys(x, begin).view(np.int64)
                print_ = fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64)), pa.array(print_), lists], names=["doc_id", "fp", "print", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(0))
            for a, b in blocks(data, offsets):
                x, begin, fp = distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                raw = [s.tobytes() for s in np.split(x, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(raw, pa.binary())], names=["fp", "shingles"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            fps = np.array([x[1] for x in held], np.int64)
            _, first, which = np.unique(np.array([x[2] for x in held], np.int64), return_index=True, return_inverse=True)
            known = first[which]
            label = forest([np.frombuffer(x[3], np.uint64) for x in held], similarity, known)
            child = np.flatnonzero(label != known)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[label[child]])], names=["a", "b"])

        for batch in batches:
            for *row, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if held and held[-1][0] != row[0]:
                    yield found()
                held.append((*row, raw.as_py()))
        if held:
            yield found()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = materialize(slim.mapInArrow(signed, "doc_id long, fp long, print long, keys array<long>"), "signatures")
    distinct = materialize(keyed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("print").alias("print"), F.first("keys").alias("keys")), "sets")
    linked = near_components(distinct.select(F.col("print").alias("fp")).distinct()).select(F.col("node").alias("print"), "root")
    near = distinct.join(linked, "print", "left").select("fp", F.xxhash64(F.coalesce("root", "print")).alias("key"))
    entries = distinct.select("fp", F.explode("keys").alias("key")).union(near)
    crowds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x")).where("n > 1")
    buckets = crowds.select("key", "n", F.xxhash64("n", "x").alias("g"))
    members = materialize(entries.join(buckets, "key").select("g", "n", "fp").distinct(), "members")
    wanted = members.select("fp").distinct().join(distinct.select("fp", "least"), "fp")
    # the texts of the wanted sets, by id; then the sets themselves
    same = (F.coalesce("doc_id", F.lit(0)) == F.coalesce("least", F.lit(0))) & (F.col("doc_id").isNull() == F.col("least").isNull())
    texts = slim.join(wanted.select("least").distinct(), same, "left_semi").select("text")
    shipped = materialize(texts.mapInArrow(sets, "fp long, shingles binary").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(shipped, "fp").select("bucket", "fp", "comp", "shingles")
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(links, "a long, b long")

    roots = connected_components(compared(dealt_once(members, hot)))
    if not members.where(F.col("n") > hot).isEmpty():
        edges = materialize(compared(dealt_rest(members, roots, hot)), "crowds")
        if not edges.isEmpty():
            roots = connected_components(edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return distinct.select("fp", "least"), roots


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The survivor of each group. Columns are those of ``docs``."""
    distinct, roots = components(docs, words, similarity)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.coalesce("least", F.lit(0)).alias("id"), "fp")).alias("s")
    kept = of.groupBy("root").agg(first).select(F.col("s.none").alias("__none"), F.col("s.id").alias("__id"), F.col("s.fp").alias("__fp"))
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]))
    return (
        with_set(docs, words, "__fp")
        .withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
        .groupBy("__none", "__id", "__fp").agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
        .join(kept, ["__none", "__id", "__fp"], "left_semi")
        .select("__row.*")
    )
