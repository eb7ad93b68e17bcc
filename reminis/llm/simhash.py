"""SimHash fingerprints and the components of those within a few differing bits.

A fingerprint bit is set where more than half of the shingles' XXH64 values set it. Links are found without
comparing all pairs: of ``bits`` + w blocks of bits, two fingerprints that differ in at most ``bits`` places
agree on at least w whole blocks, so every choice of w blocks is a table and linked fingerprints share a bucket of some
table. w is the smallest number (1, so five tables, up to some eight million fingerprints) whose buckets have about
``hot`` / 2 evenly spread members at most. Within a bucket a Gray-order index does the search: fingerprints
sorted by Gray rank stand in groups whose members share most bits; the shared bits move up into the group's
node as a mask and a pattern, a child keeps only what its parent lacks, and differences accumulate on the way
down, so that a whole group is pruned once the sum exceeds the limit.

Each bucket passes on a spanning forest of its links, never the links themselves. Buckets of over
``hot`` members are dealt out as pairs of chunks, so that no bucket, however common, meets in one task and
none of its links is lost. Distinct fingerprints alone are compared; copies follow by their fingerprint.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all of them; repeated rows have their own result rows;
a null id is never a component's name (a component of null ids alone has none); an empty table gives no rows;
columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, blocks, materialize, read_table, utf8_of, words_of
from .components import connected_components

WORDS = 4
BITS = 4
SEED = 42
FAN = 4
HOT = 2048


# --- fingerprints ----------------------------------------------------------------------------------------


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint (uint64) of each text."""
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    data = LOWER[data]
    starts, stops, row = words_of(data, offsets)
    if not len(starts):
        return out
    lengths = stops - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    inside = np.flatnonzero(~SPACE[data])
    joined[inside + np.repeat(at - starts, lengths)] = data[inside]
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    shingles = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    begin = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    word = np.repeat(first - begin, shingles) + np.arange(total)
    last = word + np.repeat(np.minimum(words, n) - 1, shingles)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(text[a:b], seed) for a, b in zip(at[word].tolist(), (at[last] + lengths[last]).tolist())], np.uint64
    )
    # Eight planes of every eighth bit, added up as bytes over at most 255 shingles at a time.
    steps = -(-shingles // 255)
    chunk = np.repeat(begin - 255 * (np.cumsum(steps) - steps), steps) + 255 * np.arange(int(steps.sum()))
    ones = np.uint64(0x0101010101010101)
    sums = np.stack([np.add.reduceat((hashes >> np.uint64(j)) & ones, chunk) for j in range(8)], axis=1)
    counts = sums.view(np.uint8).reshape(-1, 8, 8).astype(np.int64)
    full = np.flatnonzero(shingles)
    totals = np.add.reduceat(counts, (np.cumsum(steps) - steps)[full], axis=0)
    bits = (2 * totals > shingles[full][:, None, None]).transpose(0, 2, 1).reshape(-1, 64)  # byte, then bit in it
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) of every text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            found = [fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed) for a, b in blocks(data, offsets)]
            fp = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, docs.select("doc_id").schema.add("fp", "long"))


# --- the index -------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over the codes of many buckets, each bucket's codes in Gray order; level 0 are the codes, and the
    last level has one node for each bucket. ``masks`` hold only the shared bits that no node above has, ``patterns``
    their values. ``visited`` counts the nodes that searches looked at."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None, fan: int = FAN):
        group = np.zeros(len(codes), np.int64) if group is None else group
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(codes)]
        size = np.diff(np.append(first, len(codes)))
        self.codes, self.owner, self.width, self.visited = codes, np.repeat(np.arange(len(first)), size), size, 0
        ones, zeros, self.ends, self.children = [codes], [codes], [np.arange(len(codes)) + 1], [None]
        while len(self.children) == 1 or (size > 1).any():
            nodes = -(-size // fan)
            owner = np.repeat(np.arange(len(size)), nodes)
            place = fan * (np.arange(len(owner)) - np.repeat(np.cumsum(nodes) - nodes, nodes))
            begin, count = first[owner] + place, np.minimum(fan, size[owner] - place)
            ones.append(np.bitwise_or.reduceat(ones[-1], begin) if len(begin) else codes[:0])
            zeros.append(np.bitwise_and.reduceat(zeros[-1], begin) if len(begin) else codes[:0])
            self.ends.append(self.ends[-1][begin + count - 1])
            self.children.append((begin, count))
            first, size = np.cumsum(nodes) - nodes, nodes
        shared = [~(x ^ y) for x, y in zip(ones, zeros)]
        self.patterns, self.masks = zeros, shared[-1:]
        for own, above, (_, count) in zip(shared[-2::-1], shared[:0:-1], self.children[:0:-1]):
            self.masks.insert(0, own & ~np.repeat(above, count))

    def later_links(self, first: int, last: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), first <= i < last, i < j, of one bucket's codes within ``bits`` differences."""
        query = np.arange(first, last)
        node, sums, level = self.owner[query], np.zeros(len(query), np.int64), len(self.masks) - 1
        while True:
            reach = self.ends[level][node] > query + 1
            query, node, sums = query[reach], node[reach], sums[reach]
            self.visited += len(node)
            sums = sums + np.bitwise_count((self.codes[query] ^ self.patterns[level][node]) & self.masks[level][node])
            near = sums <= bits
            query, node, sums = query[near], node[near], sums[near]
            if not level:
                return query, node
            begin, count = (x[node] for x in self.children[level])
            node = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            query, sums, level = np.repeat(query, count), np.repeat(sums, count), level - 1

    def batches(self, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
        """Ranges of queries whose buckets have about ``limit`` codes in all."""
        work, a = np.cumsum(self.width[self.owner]), 0
        while a < len(work):
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + limit, "right")))
            yield a, b
            a = b


def merge_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``label`` (smallest member of each group) hold for the links a-b as well."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(group: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (positions) that connect what the links within each group connect. ``group`` is sorted, and
    within a group codes stand in Gray order."""
    label = np.arange(len(codes))
    index = GrayIndex(codes, group)
    for first, last in index.batches():
        merge_links(label, *index.later_links(first, last, bits))
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def block_keys(column: str, blocks: int, whole: int):
    """An array column: for each choice of ``whole`` of the blocks of bits, its number and the bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), whole)):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("t"), F.col(column).bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    return F.array(*keys)


def near_components(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(node, root) for the fingerprints of ``distinct`` (a column fp, without repeats)."""
    many, whole = distinct.count(), 1
    while many > hot / 2 * 2 ** (64 * whole / (bits + whole)):
        whole += 1
    tables = distinct.select("fp", F.explode(block_keys("fp", bits + whole, whole)).alias("key")).select("fp", "key.t", "key.k")
    crowded = tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    chunks = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = (
        tables.join(crowded.select("t", "k", chunks.alias("m")), ["t", "k"], "left")
        .fillna(1, ["m"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(
            F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp",
        )
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def found(group: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            own = np.append(False, group[1:] == group[:-1])
            own |= np.append(own[1:], False)  # one fingerprint alone has no link
            group, codes = group[own], codes[own]
            order = np.lexsort((gray_rank(codes), group))
            group, codes = group[order], codes[order]
            child, root = forest(group, codes, bits)
            return pa.RecordBatch.from_arrays([pa.array(codes[child].view(np.int64)), pa.array(codes[root].view(np.int64))], names=["a", "b"])

        for batch in batches:
            group = np.concatenate([rest[0], batch.column(0).to_numpy()])
            codes = np.concatenate([rest[1], batch.column(1).to_numpy().view(np.uint64)])
            if not len(group):
                continue
            cut = int(np.searchsorted(group, group[-1]))  # the last bucket may go on in the next batch
            rest = (group[cut:], codes[cut:])
            if cut:
                yield found(group[:cut], codes[:cut])
        if len(rest[0]):
            yield found(*rest)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(links, "a long, b long")
    return connected_components(edges)


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = near_components(distinct.select("fp"), bits, hot)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
