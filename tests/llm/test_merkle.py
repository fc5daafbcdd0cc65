"""Merkle manifests against plain Python, at superblocks so low that several rounds are made."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cryptolode.llm import merkle

from .test_corpus_operators import DOCS, corpus


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = n_chars if n_chars is None else n_chars + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """The root, and each node's siblings as (is it to the left, digest or None)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            other = i ^ 1
            path.append((i % 2 == 1, level[other] if other < len(level) else None))
        at = [i // 2 for i in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees["" if r[2] is None else "=" + r[2]].append(r)
    names = sorted(trees, key=lambda t: t.encode())
    made = {}
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made[t] = plain_tree([plain_leaf(r) for r in trees[t]])
    root, over = plain_tree([made[t][0] for t in names])
    out = []
    for t, up in zip(names, over, strict=True):
        for r, path in zip(trees[t], made[t][1], strict=True):
            node = plain_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for left, other in path + up:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            proof = h(*[other or "" for _, other in path + up])
            out.append((r[0], plain_leaf(r), made[t][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 10])
def test_proofs_against_plain_python(spark, height):
    rows = [*corpus(), (8, "lone", "de", "a", 3), (9, "é", "ü", None, None), (2**62 + 1, None, "de", None, 2**40), (14, "x", "", "", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit("clash"), "nth": F.lit(0), "leaf": F.lit("clash"), "block": F.lit(1)})
    got = [tuple(r) for r in merkle.report(docs.repartition(3), height).collect()]
    want = expected(rows)
    # equal leaves of one tree may change places
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_leaf_and_an_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], DOCS)).collect() == []
    (row,) = merkle.report(spark.createDataFrame([(None, None, None, None, None)], DOCS)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("-----") and row.verified and row.proof_sha256 == h("")


def test_many_trees_make_a_tree_of_several_rounds(spark):
    rows = [(i, f"t{i}", f"l{i % 37}", "s", i) for i in range(90)]
    got = [tuple(r) for r in merkle.report(spark.createDataFrame(rows, DOCS), 2).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_a_change_moves_the_root_and_only_its_own_tree(spark):
    rows = [(i, f"t{i}", ["en", "fr"][i % 2], "s", i) for i in range(20)]
    changed = [r if r[0] != 4 else (4, "t4!", *r[2:]) for r in rows]
    one, two = (merkle.Manifest(spark.createDataFrame(x, DOCS), 2) for x in (rows, changed))
    assert one.root != two.root
    before, after = ({r.tree: r.digest for r in m.subroots.collect()} for m in (one, two))
    assert before["=fr"] == after["=fr"] and before["=en"] != after["=en"]
