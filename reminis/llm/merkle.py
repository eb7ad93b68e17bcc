"""A Merkle manifest of a dataset: every row a leaf, a ternary tree for each source, and one over the sources.

Nodes are hex digests; every ``FAN`` consecutive nodes of a level become the SHA-256 of their concatenation (a last group
may have fewer, even one), until one is left. Leaves of a source ascend by id, sources by name.

Trees grow in rounds. Nodes are numbered within their tree and dealt into aligned blocks of ``FAN ** LEVELS``; a task reads
a block after another, and a round ends with one node for each block, which is a leaf of the next round, until each tree has
one node. Going down again, a block's proofs come from a fractal traversal (``Traversal``): the block's levels are cut into
layers of ``LAYER`` levels, and of each layer only the subtree that the current leaf lies in, and the next one, which grows
by a leaf at each step, are kept. So the successive proofs of a block are made with a bounded number of inner nodes, and
each is completed with the proof of its block, made in the round above. No proof is stored or shuffled below that.

A proof is the digests of a node's siblings, level by level, left to right; ``places`` has two characters a level: the
node's place among the group, and the group's size.

Defined cases: a null value counts as ``-`` in a leaf; rows of one id stand in the order of their leaves; equal rows have
leaves (and proofs) of their own; a null id comes first, a null source too (it is not the empty one); a source of one
row is its leaf, a table of one source has its subroot's root: itself; an empty table gives no rows; other columns than the
five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, read_table

# Nodes that become one, and the fields of a leaf.
FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block, and of a layer of the traversal.
LEVELS, LAYER = 5, 2
#: Rows that one task numbers or proves.
TASK_ROWS = 20_000
#: Rows of places that are sent to every task; more are joined by a shuffle.
SMALL = 100_000


def joint(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a row: each field as ``-`` if null, else its bytes' count, a colon and the value."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(columns[name]) for name in FIELDS]), 256)


# --- one block -------------------------------------------------------------------------------------------


def height(nodes: int) -> int:
    """Levels from ``nodes`` leaves to one root."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


class Subtree:
    """The part of a block's tree under one node of level ``top``, of which the levels from ``bottom`` on are kept. It grows
    by one leaf a step: full groups become nodes at once, open ones when the last leaf has come."""

    def __init__(self, leaves: list[str], bottom: int, top: int, number: int):
        self.leaves, self.bottom, self.top = leaves, bottom, top
        self.next, self.stop = number * FAN**top, min((number + 1) * FAN**top, len(leaves))
        self.base = [self.next // FAN**level for level in range(top)]
        self.open: list[list[str]] = [[] for _ in range(top + 1)]
        self.kept: list[list[str]] = [[] for _ in range(top)]

    def add(self, level: int, node: str) -> None:
        while True:
            self.open[level].append(node)
            if self.bottom <= level < self.top:
                self.kept[level].append(node)
            if level == self.top or len(self.open[level]) < FAN:
                return
            node, self.open[level], level = joint(self.open[level]), [], level + 1

    def step(self) -> None:
        if self.next >= self.stop:
            return
        self.next += 1
        self.add(0, self.leaves[self.next - 1])
        if self.next == self.stop:
            for level in range(self.top):
                if self.open[level]:
                    group, self.open[level] = self.open[level], []
                    self.add(level + 1, joint(group))

    def grown(self) -> Subtree:
        while self.next < self.stop:
            self.step()
        return self

    @property
    def root(self) -> str:
        return self.open[self.top][0]

    def group(self, level: int, node: int) -> tuple[list[str], int]:
        """The group of a node of a kept level, and the node's place in it."""
        first = node - node % FAN - self.base[level]
        return self.kept[level][first : first + FAN], node % FAN


class Traversal:
    """The proofs of a block's leaves, one after another. ``existing`` has a subtree for each layer, the current leaf's;
    ``desired`` the following one of each layer but the top, which is full when the leaf leaves the existing one."""

    def __init__(self, leaves: list[str], levels: int, layer: int = LAYER):
        self.leaves, self.levels, self.layer = leaves, levels, layer
        self.layers = [(bottom, min(bottom + layer, levels)) for bottom in range(0, levels, layer)]
        self.existing = [Subtree(leaves, *layer, 0).grown() for layer in self.layers]
        self.desired = [Subtree(leaves, *layer, 1) for layer in self.layers[:-1]]

    @property
    def root(self) -> str:
        return self.existing[-1].root if self.existing else self.leaves[0]

    def __iter__(self) -> Iterator[tuple[list[str], str]]:
        """(siblings, places) of each leaf."""
        for i in range(len(self.leaves)):
            for k, (bottom, top) in enumerate(self.layers[:-1]):
                if i and i % FAN**top == 0:
                    self.existing[k] = self.desired[k]
                    self.desired[k] = Subtree(self.leaves, bottom, top, i // FAN**top + 1)
                self.desired[k].step()
            siblings, places = [], []
            for level in range(self.levels):
                group, place = self.existing[level // self.layer].group(level, i // FAN**level)
                siblings += group[:place] + group[place + 1 :]
                places.append(f"{place}{len(group)}")
            yield siblings, "".join(places)


def folded(node: str, siblings: list[str], places: str) -> str:
    """The root that follows from a node and its proof."""
    used = 0
    for place, size in zip(places[::2], places[1::2]):
        place, others = int(place), int(size) - 1
        group = siblings[used : used + others]
        used += others
        node = joint([*group[:place], node, *group[place:]])
    return node


# --- numbering -------------------------------------------------------------------------------------------


def parts_of(rows: int) -> int:
    return max(1, min(-(-rows // TASK_ROWS), 50_000))


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` (a column ``tree`` without nulls among them) with their number from 0 within the tree, by ``order``, and
    the tree's size n. No tree is gathered: rows are sorted over ranges, counted in each, and the counts are added up.
    Rows that ``order`` does not tell apart are numbered as they were read, so that they, too, spread over ranges."""
    kept = materialize(rows.withColumn("read", F.monotonically_increasing_id()), f"{tag}-rows")
    many = kept.count()
    keys = ["tree", *[F.asc_nulls_first(c) for c in order], "read"]
    schema = StructType([*kept.schema, StructField("part", IntegerType()), StructField("nth", LongType())])
    at = kept.columns.index("tree")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for tree in batch.column(at).to_pylist():
                nth = nth + 1 if tree == last else 0
                last = tree
                numbers.append(nth)
            columns = [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    placed = materialize(kept.repartitionByRange(parts_of(many), *keys).sortWithinPartitions(*keys).mapInArrow(place, schema), f"{tag}-placed")
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(
        counts.select("tree", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("tree")).alias("n")),
        f"{tag}-bases",
    )
    few = bases.limit(SMALL + 1).count() <= SMALL
    both = placed.join(F.broadcast(bases) if few else bases, ["tree", "part"])
    return both.withColumn("number", F.col("base") + F.col("nth")).drop("part", "nth", "base", "read")


# --- rounds ----------------------------------------------------------------------------------------------


class Shape(NamedTuple):
    """Levels of a block, and of a layer of its traversal."""

    levels: int = LEVELS
    layer: int = LAYER

    @property
    def size(self) -> int:
        return FAN**self.levels

    def levels_of(self, n: int) -> int:
        """Levels of the blocks of a tree of n nodes: all that it has, where it is one block."""
        return self.levels if n > self.size else height(n)


def with_block(nodes: DataFrame, shape: Shape, *also: str) -> DataFrame:
    block = F.floor(F.col("number") / shape.size).cast("long").alias("block")
    return nodes.select("tree", block, "number", "n", "node", *also)


def in_blocks(rows: DataFrame, many: int) -> DataFrame:
    """Whole blocks in each task, one after another, each in order."""
    return rows.repartition(parts_of(many), "tree", "block").sortWithinPartitions("tree", "block", "number")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block; a block has at most FAN ** LEVELS of them, and what leads it."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, key=lambda row: (row["tree"], row["block"])):
        yield list(block)


def next_round(nodes: DataFrame, shape: Shape) -> DataFrame:
    """tree, number, n, node: the roots of the blocks."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            first, levels = block[0], shape.levels_of(block[0]["n"])
            root = Subtree([x["node"] for x in block], levels, levels, 0).grown().root
            size = -(-first["n"] // shape.size)
            yield pa.RecordBatch.from_pylist([{"tree": first["tree"], "number": first["block"], "n": size, "node": root}], schema=made)

    made = pa.schema([("tree", pa.string()), ("number", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
    return in_blocks(with_block(nodes, shape), nodes.count()).mapInArrow(climb, "tree string, number long, n long, node string")


def rounds_of(leaves: DataFrame, shape: Shape, tag: str) -> list[DataFrame]:
    """The leaves and the nodes of each round above, down to one for each tree."""
    rounds = [leaves]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(materialize(next_round(rounds[-1], shape), f"{tag}-round"))
    return rounds


def proofs(rounds: list[DataFrame], above: DataFrame, shape: Shape, tag: str) -> DataFrame:
    """tree, number, siblings, places of the nodes of the first round; ``above``: the same of the last one's, whose nodes are
    the trees' roots, with what these are part of."""
    for nodes in rounds[-2::-1]:
        above = materialize(proved(nodes, above, shape).select("tree", "number", "siblings", "places"), f"{tag}-proofs")
    return above


def proved(nodes: DataFrame, above: DataFrame, shape: Shape, *also: str) -> DataFrame:
    """tree, number, node, siblings, places, folded and the columns ``also`` of ``nodes``; ``above`` has the proofs of the
    blocks (number), and leads them. ``folded`` is the root that follows from ``claimed``, where that is one of ``also``, or
    from the node."""
    lead = above.select("tree", F.col("number").alias("block"), F.lit(-1).cast("long").alias("number"), "siblings", "places")
    rows = in_blocks(with_block(nodes, shape, *also).unionByName(lead, allowMissingColumns=True), nodes.count())
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    columns = "tree string, number long, node string, siblings string, places string, folded string" + "".join(f", {c} {kinds[c]}" for c in also)
    made = nodes.sparkSession.createDataFrame([], columns).toArrow().schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, *block in blocks_of(batches):
            upper = [lead["siblings"][i : i + 64] for i in range(0, len(lead["siblings"]), 64)]
            out = []
            for row, (siblings, places) in zip(block, Traversal([x["node"] for x in block], shape.levels_of(block[0]["n"]), shape.layer)):
                siblings, places = siblings + upper, places + lead["places"]
                row = {c: row[c] for c in ("tree", "number", "node", *also)}
                out.append(row | {"siblings": "".join(siblings), "places": places, "folded": folded(row.get("claimed") or row["node"], siblings, places)})
            yield pa.RecordBatch.from_pylist(out, schema=made)

    return rows.mapInArrow(walk, columns)


# --- the manifest ----------------------------------------------------------------------------------------


def manifest(docs: DataFrame, claimed: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """doc_id, source, leaf, subroot, root, siblings, places, folded of every row of ``docs``. ``claimed`` is the text that a
    reader holds instead of the row's own (none: the row's): ``folded`` is the root that follows from it, which is the
    manifest's root where nothing has changed."""
    own = {name: F.col(name) for name in FIELDS}
    # null comes first, and is not the empty name
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(
        "doc_id", "source", tree.alias("tree"), leaf(own).alias("node"),
        (leaf(own) if claimed is None else leaf(own | {"text": claimed})).alias("claimed"),
    )
    leaves = materialize(numbered(rows, ["doc_id", "node"], "leaves"), "leaves")
    rounds = rounds_of(leaves, shape, "source")
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    tops = materialize(numbered(subroots, ["name"], "sources"), "sources")
    upper = rounds_of(tops, shape, "root")
    found = upper[-1].first()
    none = upper[-1].select("tree", "number", F.lit("").alias("siblings"), F.lit("").alias("places"))
    of_sources = proofs(upper, none, shape, "root").join(tops.select("tree", "number", "name", F.col("node").alias("subroot")), ["tree", "number"])
    of_sources = materialize(of_sources.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("number"), "siblings", "places", "subroot"), "of-sources")
    # the first round is proved last, and straight into the result
    above = proofs(rounds[1:], of_sources.drop("subroot"), shape, "source") if len(rounds) > 1 else of_sources.drop("subroot")
    done = proved(leaves, above, shape, "doc_id", "source", "claimed")
    few = of_sources.limit(SMALL + 1).count() <= SMALL
    subroot = of_sources.select("tree", "subroot")
    done = done.join(F.broadcast(subroot) if few else subroot, "tree")
    return done.select("doc_id", "source", F.col("node").alias("leaf"), "subroot", F.lit(found.node if found else None).alias("root"), "siblings", "places", "folded")


def proofs_of(spark: SparkSession, sf_dir: str, shape: Shape = Shape()) -> DataFrame:
    """The proofs of all documents, held against texts of which those with an even crc32 of the id lost their line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(read_table(spark, sf_dir, "documents"), tampered, shape)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs_of(spark, sf_dir)


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
