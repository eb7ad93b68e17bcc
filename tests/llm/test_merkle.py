"""The manifest against a tree that is built whole, level by level."""

import hashlib
import random
import zlib

import pytest

from reminis.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int"


def joint(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its proof: (siblings before, after) of each level."""
    nodes, members, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        groups = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for group in groups:
            for i in group:
                for m in members[i]:
                    proofs[m].append(([nodes[j] for j in group if j < i], [nodes[j] for j in group if j > i]))
        nodes, members = [joint(nodes[i] for i in g) for g in groups], [sum((members[i] for i in g), []) for g in groups]
    return nodes[0], proofs


def by_hand(rows):
    """Sorted results of the query."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: tree([leaf(r, r[4]) for r in own[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for r, proof in zip(own[s], trees[s][1]):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node = leaf(r, text)
            for left, right in proof + top:
                node = joint([*left, node, *right])
            siblings = [x for left, right in proof + top for x in left + right]
            out.append((r[0], leaf(r, r[4]), trees[s][0], root, joint(siblings), node, node == root))
    return sorted(map(repr, out))


def found(spark, tmp_path, rows, shape=merkle.Shape()):
    path = str(tmp_path)
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(x)) for x in merkle.proofs_of(spark, path, shape).select(names).collect())


@pytest.mark.parametrize("levels, layer, rows_a_task", [(5, 2, 20_000), (2, 1, 7), (3, 2, 40)])
def test_manifest_equals_whole_trees(spark, tmp_path, monkeypatch, levels, layer, rows_a_task):
    """Several rounds, hot and tiny sources, null, empty and non-ASCII values, repeated rows and ids."""
    monkeypatch.setattr(merkle, "TASK_ROWS", rows_a_task)
    r = random.Random(levels)
    rows = [(i, "hot" if i % 3 else f"s{i % 17}é", r.choice(["en", None]), r.choice([i, None]), r.choice(["a\nb", "x", "", None, "é\n\n"])) for i in range(300)]
    rows += [(None, None, None, None, None), (5, None, "en", 1, "t\n"), (6, "", "", 0, ""), (7, "", None, None, "\n"), *[(8, "twice", "en", 1, "same\n")] * 4, (9, "twice", "en", 1, "z")]
    assert found(spark, tmp_path, rows, merkle.Shape(levels, layer)) == by_hand(rows)


def test_small_tables(spark, tmp_path):
    for rows in ([], [(1, "a", "en", 3, "x\ny")], [(1, "a", "en", 3, "x"), (2, "b", None, None, None)], [(i, None, None, i, f"{i}") for i in range(4)]):
        assert found(spark, tmp_path, rows) == (by_hand(rows) if rows else [])


def test_traversal_keeps_few_nodes_and_proves_every_leaf():
    for n in [*range(1, 30), 80, 81, 82, 243]:
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        root, proofs = tree(leaves)
        walk = merkle.Traversal(leaves, merkle.height(n))
        assert walk.root == root
        for i, (siblings, places) in enumerate(walk):
            assert siblings == [x for left, right in proofs[i] for x in left + right]
            assert merkle.folded(leaves[i], siblings, places) == root
            held = sum(len(level) for s in walk.existing + walk.desired for level in s.kept + s.open)
            assert held <= 2 * len(walk.layers) * (sum(merkle.FAN**k for k in range(merkle.LAYER + 1)) + merkle.FAN * merkle.height(n))


def test_a_changed_leaf_is_found_out():
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20)]
    for siblings, places in merkle.Traversal(leaves, 3):
        assert merkle.folded(joint(["other"]), siblings, places) != tree(leaves)[0]
