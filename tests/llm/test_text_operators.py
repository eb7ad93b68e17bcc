"""Per-document operators against libraries and plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as hs

from reminis.llm import bpe_tree, media, minhash, packing, pieces
from reminis.llm.common import HashTable, byte_hashes, utf8_of, words_of

AWKWARD = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Sing", "1", "½", "é", "日本", "!", "\x1c", "<|endoftext|>", "’", "don't", "　", "🙂"]
TEXTS = hs.lists(hs.lists(hs.one_of(hs.sampled_from(AWKWARD), hs.text(max_size=3)), max_size=25).map("".join), min_size=1, max_size=8)
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def encoders():
    found = {}
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = public_tokenizers.path(name)
        found[name] = (path, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces.load_ranks(path), special_tokens={}))
    return found


def offsets_of(texts):
    return np.cumsum([0, *map(len, texts)])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_equal_tiktoken(encoders, texts):
    path, library = encoders["byte_bpe_50k.tiktoken"]
    encoder = pieces.PieceEncoder(path)
    offsets = offsets_of(texts)
    starts, ids, sizes = encoder.encode("".join(texts), offsets)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in texts]


def test_piece_table_is_bounded(encoders):
    path, library = encoders["byte_bpe_50k.tiktoken"]
    encoder = pieces.PieceEncoder(path, max_pieces=5)
    for i in range(10):
        text = f"word{i} other{i} x{i}"
        assert encoder.encode(text, np.array([0, len(text)]))[1].tolist() == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(TEXTS, hs.integers(1, 9))
def test_tree_equals_tiktoken(encoders, texts, leaf):
    path, library = encoders["byte_bpe_multi_50k.tiktoken"]
    found = bpe_tree.TreeEncoder(path, leaf).encode_block("".join(texts), offsets_of(texts))
    assert [x.tolist() for x in found] == [library.encode_ordinary(t) for t in texts]
    tokens = {rank: token for token, rank in pieces.load_ranks(path).items()}
    assert [bpe_tree.decode(x.tolist(), tokens, 3) for x in found] == [t.encode() for t in texts]


def test_op5_on_edge_cases(spark, encoders):
    _, library = encoders["byte_bpe_multi_50k.tiktoken"]
    texts = {1: None, 2: "", 3: "x" * 5000, 4: "It's 12 o'clock\n\n  now", 5: "a b " * 3000}
    rows = bpe_tree.encode_documents(spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(4, texts[4], None)], SCHEMA)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    again = bpe_tree.decode_documents(bpe_tree.encode_documents(spark.createDataFrame([(4, texts[4], "x")], SCHEMA))).first()
    assert again.text == texts[4]
    assert bpe_tree.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segmentation_of_hashes():
    data, offsets = utf8_of(__import__("pyarrow").array(["ab  cd", "", None, "ab"]))
    starts, stops, row = words_of(data, offsets)
    assert row.tolist() == [0, 0, 3]
    h = byte_hashes(data, starts, stops)
    assert h[0] == h[2] != h[1]
    big = np.frombuffer((b"word " * 700_000), np.uint8)
    starts, stops, _ = words_of(big, np.array([0, len(big)]))
    assert len(set(byte_hashes(big, starts, stops).tolist())) == 1
    mixed = np.random.default_rng(0).permutation(len(starts))
    assert (byte_hashes(big, starts[mixed], stops[mixed]) == byte_hashes(big, starts, stops)[mixed]).all()
    mixed = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    for size in (6, 8, 9, 511, 513, 1000):
        assert len(set(byte_hashes(mixed, np.arange(0, 3990), np.arange(size, 3990 + size)).tolist())) == 3990
        assert byte_hashes(mixed[7:], np.array([0]), np.array([size]))[0] == byte_hashes(mixed, np.array([7]), np.array([7 + size]))[0]


def alternating(size):
    """A word whose polynomial hash modulo 2 ** 64 is its complement's, whatever the odd base, and the complement."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", range(6, 14))
def test_alternating_words_are_told_apart(encoders, bits):
    pair = alternating(1 << bits)
    for name, make in (("byte_bpe_50k.tiktoken", pieces.PieceEncoder), ("byte_bpe_multi_50k.tiktoken", bpe_tree.TreeEncoder)):
        path, library = encoders[name]
        encoder = make(path)
        for word in pair:
            found = encoder.encode(word, np.array([0, len(word)]))[1] if hasattr(encoder, "encode") else encoder.encode_block(word, np.array([0, len(word)]))[0]
            assert found.tolist() == library.encode_ordinary(word)
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    a, b = byte_hashes(data, np.array([0, 1 << bits]), np.array([1 << bits, 2 << bits]))
    assert a != b


def test_pieces_with_one_hash_are_told_apart(encoders):
    path, library = encoders["byte_bpe_50k.tiktoken"]
    encoder = pieces.PieceEncoder(path)
    encoder.hashes = lambda data, starts, stops: (stops - starts).astype(np.uint64)  # all of one length collide
    for text in ("abc abd été abc x", "xyz abd abc", " " + "q" * 300 + " " + "r" * 300):
        assert encoder.encode(text, np.array([0, len(text)]))[1].tolist() == library.encode_ordinary(text)


def test_hash_table():
    random = np.random.default_rng(1)
    keys = np.unique(random.integers(0, 1 << 63, 20000, dtype=np.uint64))
    table = HashTable(4)
    table.insert(keys[:7000])
    table.insert(keys[7000:])
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert (table.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2


@settings(max_examples=60, deadline=None)
@given(hs.dictionaries(hs.integers(1, 64), hs.integers(1, 40), max_size=20))
def test_plan_places_every_piece(counts):
    plan = packing.plan_bins(counts, 64)
    placed = Counter()
    for lengths, number in plan:
        assert sum(lengths) <= 64 and number > 0
        assert sum(3 * n > 64 for n in lengths) <= 2
        for n in lengths:
            placed[n] += number
    assert placed == Counter(counts)
    bins, least = sum(n for _, n in plan), -(-sum(k * n for k, n in counts.items()) // 64)
    assert bins >= least and bins <= 1.5 * least + 1 + sum(n for k, n in counts.items() if 2 * k > 64)


def test_packing_equals_brute_force(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "x", "9"]) for _ in range(r.randint(0, 900))), "en") for i in range(60)]
    texts += [(100, None, None), (101, "", ""), (101, "", ""), (None, "no id", "en"), (102, "long " * 5000, "en"), (103, "<|endoftext|>", "en"), (104, "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endof", "en"), (105, "text|> d's  ", "en")]
    rows = packing.pack(spark.createDataFrame(texts, SCHEMA)).collect()
    by_doc: dict = {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
    for i, text, _ in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[i], key=lambda x: x.piece)
        if i == 101:
            assert len(own) == 2
            continue
        assert [x.start for x in own] == list(np.cumsum([0] + [x.length for x in own])[:-1]) and sum(x.length for x in own) == len(ids)
        assert all(x.length == 1024 for x in own[1:])
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
    bins: dict = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * sum(x.length for x in rows) / 1024 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_minhash_next_documents(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 80))) for i in range(0, 400, 3)}
    texts[9], texts[12] = texts[6], None
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).repartition(7)
    ids = sorted(texts)
    for size in (7, 1024):
        dealt = minhash.with_next(docs, size).collect()
        assert sum(x.tail == 0 for x in dealt) == len(ids)
    rows = {x.doc_id: x for x in minhash.compare_with_next(docs).collect()}
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        changed = minhash.edited(text, after)
        assert rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and rows[i].n_chars == len(text)
        a, b = shingle_set(text), shingle_set(changed)
        assert abs(rows[i].near_edited - len(a & b) / len(a | b)) < 0.25
        if text == after:
            assert rows[i].near_next == 1
    assert rows[6].fingerprint == rows[9].fingerprint
    one = minhash.compare_with_next(spark.createDataFrame([(5, "a b c d", "x")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert minhash.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = minhash.compare_with_next(spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (None, "n", "x")], SCHEMA)).collect()
    assert len(twice) == 3 and {x.doc_id for x in twice} == {1, None}


def test_minhash_near_duplicates(spark):
    r = random.Random(6)
    base = [f"t{r.randint(0, 999)}" for _ in range(120)]
    texts = {1: base, 2: base[:110] + ["z"] * 10, 3: base, 4: base[:60], 5: [], 6: []}
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in texts.items()], SCHEMA)
    members, pairs = minhash.near_duplicates(docs)
    assert {(x.doc_id, x.rep) for x in members.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 5)}
    a, b = shingle_set(" ".join(texts[1])), shingle_set(" ".join(texts[2]))
    assert [(x.a, x.b, round(x.jaccard, 6)) for x in pairs.collect()] == [(1, 2, round(len(a & b) / len(a | b), 6))]
    unnamed = [(None, " ".join(base), "x"), (None, " ".join(texts[4]) + " end", "x")]  # a copy of 1; one that is near 4 and has no twin
    members, pairs = minhash.near_duplicates(docs.union(spark.createDataFrame(unnamed, SCHEMA)))
    assert sorted(((x.rep or 0) for x in members.collect() if x.doc_id is None)) == [0, 1]
    assert [(x.a, x.b) for x in pairs.collect()] == [(1, 2)]


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 40, b"\0\0"])
def test_images_keep_bytes(raw):
    image = media.encode_image(raw)
    payload, length = media.decode_image(image)
    assert length == len(raw) and payload == raw + bytes(len(payload) - len(raw)) and len(payload) % 64 == 0 and payload
    media.feature_of(payload)
    with pytest.raises((ValueError, zlib.error)):
        media.decode_image(image[:-20] + b"\1" + image[-19:])


def test_archives(spark, tmp_path):
    texts = [(1, "text one", "x"), (2, None, "x"), (2, "", "y"), (None, "no id", "z"), (3, "é" * 50000, "x")]
    path = f"file://{tmp_path}/archive"
    media.store(spark.createDataFrame(texts, SCHEMA).repartition(3), path)
    (tmp_path / "archive" / "archive-left-over.zip").write_bytes(b"junk of a failed task")
    for size in (50, 1 << 22):  # ranges cut members anywhere
        rows = media.load(spark, path, rangeBytes=size).collect()
        assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((str(i), len((t or "").encode())) for i, t, _ in texts)
        assert all(r.error is None for r in rows)
    media.store(spark.createDataFrame([(9, "more", "x")], SCHEMA), path)
    assert media.load(spark, path).count() == 6
    name, offset = next((r.archive, r.offset) for r in rows if r.doc_id == 1)
    raw = bytearray((tmp_path / "archive" / name).read_bytes())
    raw[offset + 60] ^= 0xFF  # one damaged member is one row with an error
    (tmp_path / "archive" / name).write_bytes(raw)
    bad = [r for r in media.load(spark, path, retries=1).collect() if r.error]
    assert [(r.doc_id, r.payload) for r in bad] == [(1, None)]
    empty = f"file://{tmp_path}/empty"
    media.store(spark.createDataFrame([], SCHEMA), empty)
    assert media.load(spark, empty).count() == 0


def test_query_columns_equal_plain_python(spark, tmp_path):
    texts = {1: "abc", 2: None, 3: "é" * 50000, 4: "abc", 5: "x" * 128, None: "no id"}
    path = f"file://{tmp_path}/archive"
    docs = spark.createDataFrame([(i, t, "en", "f", "p") for i, t in texts.items()], SCHEMA + ", feature string, payload string")
    media.store(docs.repartition(2), path, archiveBytes=300)
    rows = media.digests(media.load(spark, path, rangeBytes=100)).collect()
    assert len(rows) == len(texts) and len(list((tmp_path / "archive").glob("*.zip"))) > 2
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        image = media.encode_image(raw)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (x.tail_crc32, x.media_bytes, x.media_sha256) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert x.feature == media.feature_of(payload)
    media.store(docs.where("doc_id = 1"), path, mode="overwrite")
    assert [x.doc_id for x in media.load(spark, path).collect()] == [1]
    found = list((tmp_path / "archive").glob("*.zip"))
    assert len(found) == 1 and len(list((tmp_path / "archive").glob("manifest-*"))) == 1
    raw = bytearray(found[0].read_bytes())
    raw[60] ^= 0xFF
    found[0].write_bytes(raw)
    with pytest.raises(Exception, match="cannot be read"):
        media.digests(media.load(spark, path, retries=1)).collect()


def test_joins_within_a_piece_cost_windows(encoders):
    path, library = encoders["byte_bpe_multi_50k.tiktoken"]
    r = random.Random(4)
    free = ["".join(r.choice("aetrnsiolcd") for _ in range(60000)), "".join(r.choice("日本語éа") for _ in range(20000))]
    for text in ("x" * 60000, "ab" * 20000 + "z" * 9000, " " * 30000 + "end", *free):
        tree, merged = bpe_tree.TreeEncoder(path, 1024), []
        merge = tree.merge
        tree.merge = lambda raw: merged.append(len(raw)) or merge(raw)
        assert tree.encode_block(text, np.array([0, len(text)]))[0].tolist() == library.encode_ordinary(text)
        if text in free:  # a repeated character's ids move along, so its windows grow
            assert max(merged) < 500 and sum(merged) < len(text.encode())
