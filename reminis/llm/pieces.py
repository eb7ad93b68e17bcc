"""Byte-level BPE over whole blocks of text: vectorised pre-tokenisation and a table of known pieces.

``segment`` finds the matches of ``public_tokenizers.PATTERN`` for all texts of a block at once, from a table
of character classes; the rules of the pattern become array operations. ``PieceEncoder`` looks the pieces up
in a hash table of those seen before, compares their bytes (a piece whose hash is another's is encoded by itself)
and runs the merges only for new ones. Pieces of over ``LONGEST`` bytes are never kept, and the table is emptied
when it holds ``max_pieces``: both bound a worker's memory and change no result.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from .common import HashTable, byte_hashes, chunks_of, same_bytes

LONGEST = 256
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
# The characters of the Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    kinds = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[list(WHITE_SPACE)] = BLANK
    return kinds


def segment(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the texts that lie at ``offsets`` in ``points`` (code points)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)  # a text begins, or the block ends
    first[offsets] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # White space before something else: all but its last character is a piece; the last one begins the next
    # piece where it is a plain space, and is a piece where it is not.
    blank = kind == BLANK
    last = np.flatnonzero(blank[:-1] & start[1:n] & ~first[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # Contractions, at an apostrophe that begins a piece.
    at = np.flatnonzero((points == 0x27) & start[:n])
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    one = np.isin(points[at + 1], [ord(c) for c in "stmd"])
    rest = at[~one]
    rest = rest[rest + 2 < n]
    rest = rest[~first[rest + 2]]
    pair = points[rest + 1].astype(np.int64) << 32 | points[rest + 2]
    two = rest[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for found, length in ((at[one], 2), (two, 3)):
        start[found + 1] = False
        start[found + length] = True
    return np.flatnonzero(start[:n])


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder:
    """Encodes blocks of texts by the ranks of a tiktoken file."""

    def __init__(self, path: str, max_pieces: int = 1 << 20):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={}
        )
        self.merge = self.encoding._core_bpe.encode_single_piece
        self.hashes = byte_hashes
        self.max_pieces = max_pieces
        self._empty()

    def _empty(self) -> None:
        self.known = HashTable(16)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0
        self.at, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.bytes, self.n_bytes = np.zeros(1 << 20, np.uint8), 0

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        while size > len(array):
            array = np.resize(array, 2 * len(array))
        return array

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        found = [self.merge(piece) for piece in pieces]
        n, sizes = self.known.n, np.array([len(x) for x in found], np.int64)
        lengths = np.array([len(x) for x in pieces], np.int64)
        self.known.insert(keys)
        new = slice(n, n + len(found))
        self.begin, self.size = self._grown(self.begin, new.stop), self._grown(self.size, new.stop)
        self.at, self.length = self._grown(self.at, new.stop), self._grown(self.length, new.stop)
        self.ids = self._grown(self.ids, self.n_ids + int(sizes.sum()))
        self.bytes = self._grown(self.bytes, self.n_bytes + int(lengths.sum()) + 8)
        self.size[new], self.begin[new] = sizes, self.n_ids + np.cumsum(sizes) - sizes
        self.length[new], self.at[new] = lengths, self.n_bytes + np.cumsum(lengths) - lengths
        flat, raw = np.array([i for x in found for i in x], np.uint32), np.frombuffer(b"".join(pieces), np.uint8)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.bytes[self.n_bytes : self.n_bytes + len(raw)] = raw
        self.n_ids, self.n_bytes = self.n_ids + len(flat), self.n_bytes + len(raw)

    def encode(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text``: texts one after another; ``offsets``: where each begins, in code points, and the end.

        Returns the starts of the pieces, the ids of all of them and the number of ids of each piece."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = segment(points, offsets)
        if not len(starts):
            return starts, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.known.n > self.max_pieces:
            self._empty()
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) if len(data) != len(points) else None
        begin = starts if first is None else first[starts]
        lengths = np.diff(np.append(begin, len(data)))
        keys = self.hashes(data, begin, begin + lengths)
        at = self.known.find(keys)
        new = np.flatnonzero((at < 0) & (lengths <= LONGEST))
        if len(new):
            fresh, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            n = self.known.n
            where = new[where]
            self._learn(fresh, [raw[a : a + b] for a, b in zip(begin[where].tolist(), lengths[where].tolist())])
            at[new] = n + back
        known = (at >= 0) & (self.length[at] == lengths)
        there = np.flatnonzero(known)
        own = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        known[there] = same_bytes(chunks_of(data), begin[there], own, self.at[at[there]], lengths[there])
        sizes = np.where(known, self.size[at], 0)
        alone = {i: np.array(self.merge(raw[begin[i] : begin[i] + lengths[i]]), np.uint32) for i in np.flatnonzero(~known).tolist()}
        for i, ids in alone.items():
            sizes[i] = len(ids)
        ends = np.cumsum(sizes)
        from_table = np.repeat(np.where(known, self.begin[at], 0) - ends + sizes, sizes) + np.arange(ends[-1])
        flat = self.ids[np.minimum(from_table, len(self.ids) - 1)]
        for i, ids in alone.items():
            flat[ends[i] - sizes[i] : ends[i]] = ids
        return starts, flat, sizes


def code_point_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets as code point offsets."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return leads[offsets]
