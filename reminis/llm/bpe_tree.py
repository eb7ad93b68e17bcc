"""Byte-level BPE by monoid tree reduction.

The encoding of a text is the join of the encodings of its halves, down to leaves of ``leaf`` characters. An
element of the monoid is the list of pieces (matches of the split pattern) of a stretch of text with their
ids. Joining two neighbours re-encodes a window round the boundary, which grows until the pieces outside it
are provably those of the whole stretch:

* to the left, matching runs left to right and looks at most ``LOOK`` characters beyond a piece's end, so a
  piece that ends ``LOOK`` or more before the boundary is final;
* to the right, matching from a place depends on the text from that place on alone (the pattern has no
  look-behind), so from the first place at which the window and the right element both begin a piece, the
  right element's pieces are final. While there is none, the window doubles.

Within a piece that the boundary cuts, the ids of its halves are joined in the same way, by ``join_tokens``: a window
of ids on both sides is merged anew and grows until the ids at its edges and those outside stay apart when they are
merged as a pair. That proves the whole: take the first merge in time that would cross an edge between neighbouring
ids; until then the bytes of the two ids have merged as they would alone, so the pair alone would cross it as well.
So an endless piece costs windows, not a merge of all of it at each level; matching the split pattern is linear. (A run
of one character is the exception: its ids move along with the boundary, and windows grow until they meet again.)

Decoding concatenates the bytes of halves up the tree.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, read_table, utf8_of
from .pieces import PieceEncoder, code_point_offsets, load_ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 1024
#: Characters that decide a piece's end: the longest alternative that may fail, an apostrophe and two letters.
LOOK = 3
#: Pairs of ids that a worker remembers.
PAIRS = 1 << 18

Element = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts of pieces, sizes in ids, ids


class TreeEncoder:
    """Encodes texts up a binary tree; ``leaves`` encodes many short stretches at once."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.encoder, self.leaf = PieceEncoder(path), leaf
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.merge = self.encoder.merge
        self.tokens = {rank: token for token, rank in load_ranks(path).items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring ids stay as they are when their bytes are merged anew."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two stretches of one piece as those of both together."""
        if not len(left) or not len(right):
            return left if len(left) else right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.tokens[x] for x in (*left[len(left) - i :].tolist(), *right[:j].tolist())))
            wider = i < len(left) and not self.apart(int(left[-i - 1]), window[0])
            longer = j < len(right) and not self.apart(window[-1], int(right[j]))
            if not wider and not longer:
                return np.concatenate([left[: len(left) - i], np.array(window, np.uint32), right[j:]])
            i, j = i * (1 + wider), j * (1 + longer)

    def encode_block(self, text: str, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the texts that lie at ``offsets`` (code points) in ``text``."""
        cuts, firsts = [0], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            firsts.append(len(cuts) - 1)
            parts = 1
            while (b - a) > parts * self.leaf:
                parts *= 2
            if b > a:
                cuts += [a + (b - a) * k // parts for k in range(1, parts + 1)]
        firsts.append(len(cuts) - 1)
        bounds = np.array(cuts, np.int64)
        starts, ids, sizes = self.encoder.encode(text, bounds)
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        piece = np.searchsorted(starts, bounds)
        leaves = [
            (starts[i:j], sizes[i:j], ids[x:y])
            for i, j, x, y in zip(piece[:-1].tolist(), piece[1:].tolist(), ends[piece[:-1]].tolist(), ends[piece[1:]].tolist())
        ]
        return [
            self._reduce(text, cuts, leaves, a, b)[2] if b > a else np.zeros(0, np.uint32)
            for a, b in zip(firsts[:-1], firsts[1:])
        ]

    def _reduce(self, text: str, cuts: list[int], leaves: list[Element], a: int, b: int) -> Element:
        """Leaves a to b as one element; halves first. The depth is the logarithm of the number of leaves."""
        if b - a == 1:
            return leaves[a]
        middle = (a + b) // 2
        return self.join(
            text, self._reduce(text, cuts, leaves, a, middle), self._reduce(text, cuts, leaves, middle, b), cuts[middle], cuts[b]
        )

    def join(self, text: str, left: Element, right: Element, boundary: int, end: int) -> Element:
        """The element of the stretch that ``left`` (up to ``boundary``) and ``right`` (up to ``end``) make."""
        if not len(left[0]) or not len(right[0]):  # the empty stretch is the identity
            return right if len(right[0]) else left
        starts = left[0]
        keep = max(0, int(np.searchsorted(starts, boundary - LOOK, "right")) - 1)  # those before it end in time
        begin = int(starts[keep])
        reach = 4
        while True:
            stop = int(right[0][reach]) if reach < len(right[0]) else end
            found, at = [], begin
            for piece in self.pattern.findall(text[begin:stop]):
                found.append((at, piece))
                at += len(piece)
            if stop == end:
                meet = end
            else:
                final = {x for x, _ in found if x <= stop - LOOK and x >= boundary}
                meet = next((x for x in right[0][: reach + 1].tolist() if x in final), -1)
                if meet < 0:
                    reach *= 2
                    continue
            ends = [np.append(0, np.cumsum(side[1])) for side in (left, right)]

            def ids_of(x: int, piece: str) -> np.ndarray:
                """The ids of a piece from place x on: known from one side, joined from both, or merged."""
                y = x + len(piece)
                if x < boundary < y:
                    if x == int(starts[-1]) and y == (int(right[0][1]) if len(right[0]) > 1 else end):
                        return self.join_tokens(left[2][ends[0][-2] :], right[2][: ends[1][1]])
                else:
                    side, last = (0, boundary) if y <= boundary else (1, end)
                    own = (left, right)[side][0]
                    k = int(np.searchsorted(own, x))
                    if k < len(own) and own[k] == x and y == (int(own[k + 1]) if k + 1 < len(own) else last):
                        return (left, right)[side][2][ends[side][k] : ends[side][k + 1]]
                return np.array(self.merge(piece.encode()), np.uint32)

            window = [(x, ids_of(x, piece)) for x, piece in found if x < meet]
            k = int(np.searchsorted(right[0], meet)) if meet < end else len(right[0])
            return (
                np.concatenate([starts[:keep], np.array([x for x, _ in window], np.int64), right[0][k:]]),
                np.concatenate([left[1][:keep], np.array([len(i) for _, i in window], np.int64), right[1][k:]]),
                np.concatenate([left[2][: ends[0][keep]], *(i for _, i in window), right[2][ends[1][k] :]]).astype(np.uint32),
            )


def decode(ids: list[int], tokens: dict[int, bytes], leaf: int = LEAF) -> bytes:
    """Bytes of ids: those of the first half, then those of the second."""
    if len(ids) <= leaf:
        return b"".join([tokens[i] for i in ids])
    middle = len(ids) // 2
    return decode(ids[:middle], tokens, leaf) + decode(ids[middle:], tokens, leaf)


def encode_documents(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary: the bytes that the ids decode to) of every text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(path, leaf)
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in blocks(data, offsets):
                part = data[offsets[a] : offsets[b]]
                points = code_point_offsets(part, offsets[a : b + 1] - offsets[a])
                found = encoder.encode_block(part.tobytes().decode(), points)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(ends), flat),
                        pa.array([decode(ids.tolist(), tokens) for ids in found], pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids; bytes that are not UTF-8 become replacement characters."""
    path = path or public_tokenizers.path(VOCABULARY)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            found = [decode(ids or [], tokens).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(read_table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_bpe_tree": op5_bpe_tree}
