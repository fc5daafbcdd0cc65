"""Top-k search where bounds drop nothing: few nodes, queries sent by portions, and every precision exact."""

import numpy as np
from pyspark.sql import functions as F

from cryptolode.llm import topk


def nodes(tree):
    return 1 + sum(map(nodes, tree.children))


def test_points_without_structure_are_one_leaf_and_clusters_are_not():
    rng = np.random.default_rng(1)
    points = np.floor(32 * rng.normal(size=(2000, 64)))
    assert nodes(topk.CoverTree(points, np.arange(2000))) == 1
    clustered = np.repeat(np.floor(900 * rng.normal(size=(4, 64))), 500, axis=0) + np.floor(4 * rng.normal(size=(2000, 64)))
    tree = topk.CoverTree(clustered, np.arange(2000))
    assert 4 <= nodes(tree) < 40 and sorted(np.concatenate([x.index for x in tree.leaves()])) == list(range(2000))


def brute(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    found = {}
    for q, own in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own))
            found[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return found


def test_queries_are_sent_once_a_portion(spark, monkeypatch):
    """Without structure every block is near; a block of queries goes to a few portions of blocks and not to each block."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)) / 5)]
    stored, real = {}, topk.materialize
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    wide = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    monkeypatch.setattr(topk, "materialize", lambda df, name: stored.setdefault(f"{name}{len(stored)}", real(df, name)))
    for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(wide)
    near, dealt = (next(df for name, df in stored.items() if name.startswith(x)) for x in ("near-blocks", "portions"))
    sent = dealt.select("query_block", "portion").distinct().count()
    assert near.count() > 50 and sent <= 2 * spark.sparkContext.defaultParallelism + near.select("query_block").distinct().count()


def test_every_precision_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "TILE", 64)
    rng = np.random.default_rng(3)
    rows = []
    for n, (dims, scale) in enumerate([(8, 0.5), (9, 3), (10, 100), (11, 1e4), (12, 1e6)]):  # single, at its edge, double, wide, unbounded
        rows += [(1000 * n + i, (scale * v).tolist()) for i, v in enumerate(rng.normal(size=(160, dims)))]
        rows += [(1000 * n + 200 + i, rows[-1][1]) for i in range(60)]  # ties
        rows += [(1000 * n + 50, (scale * rng.normal(size=dims)).tolist())]  # an id again
    rows += [(9001 + i, (v * (200 if i % 7 == 0 else 0.3)).tolist()) for i, v in enumerate(rng.normal(size=(150, 13)))]  # 16-bit integers and doubles in a block
    rows += [(9301, [1.0] * 14)]  # a length without queries
    queries = [(i, v) for i, v in rows if i % 50 == 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in queries:
        own = [int(np.floor(256 * x)) for x in v]
        scores = sorted((-sum(a * b for a, b in zip(own, o, strict=True)), i) for i, o in good if i != q and len(o) == len(own))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert all(abs(x[3]) < 2**63 for x in want) and sorted(got) == sorted(want)
