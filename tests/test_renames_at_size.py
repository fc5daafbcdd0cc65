"""Renames of sets large enough for several shared lines, in packed blocks and rounds, and what they shuffle."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from cryptolode.operators import graph, versions


def snapshots(rng, n, vocabulary=700):
    """Removed and added files of up to 200 lines, of which added ones keep a part of a removed one's."""
    common = [f"line {i}" for i in range(vocabulary)]
    removed = [(f"a/{i}", rng.sample(common, rng.randint(2, 200))) for i in range(n)]
    added = []
    for i in range(n):
        own = rng.choice(removed)[1]
        kept = rng.sample(own, max(1, int(len(own) * rng.uniform(0.3, 1))))
        added.append((f"b/{i}", kept + [f"line {rng.randrange(vocabulary)}" for _ in range(int(len(kept) * rng.uniform(0, 0.6)))] + [f"own {i} {k}" for k in range(rng.randint(0, 9))]))
    return [[(p, "\n".join(x)) for p, x in side] for side in (removed, added)]


def brute(removed, added, threshold):
    sets = [{p: set(t.split("\n")) for p, t in side} for side in (removed, added)]
    want = {}
    for p, own in sets[1].items():
        alike, q = min((-len(own & s) / len(own | s), q) for q, s in sets[0].items())
        if -alike >= threshold:
            want[p] = (q, round(-alike, 9))
    return want


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_larger_sets_meet_by_several_lines(spark, monkeypatch, threshold):
    removed, added = snapshots(random.Random(1), 150)
    removed += [("a/0 again", removed[0][1])]
    want = brute(removed, added, threshold)
    df = [spark.createDataFrame(x, "path string, text string") for x in (removed, added)]
    monkeypatch.setattr(versions, "LEAST", 1)
    for block, chunk, pairs in ((8_000_000, 2_000_000, 500_000), (1500, 400, 300)):
        monkeypatch.setattr(versions, "CHUNK", chunk)
        monkeypatch.setattr(versions, "PAIRS", pairs)
        got = {r.path: (r.source, round(r.similarity, 9)) for r in versions.renamed(*df, threshold, block).collect()}
        assert got == want and 10 < len(want) < 150


def test_what_rounds_have_sent_goes(spark, monkeypatch):
    """Sets in many small blocks: of what is shuffled, most is gone again by the end."""
    removed, added = snapshots(random.Random(2), 500, 300)
    df = [spark.createDataFrame(x, "path string, text string") for x in (removed, added)]
    monkeypatch.setattr(versions, "LEAST", 1, raising=False)
    context = spark.sparkContext._jsc.sc()
    sent = lambda: context.statusStore().executorList(False).apply(0).totalShuffleWrite()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {f.toString(): f.length() for f in (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size())) if f.getName().endswith(".data")}
    before, old = sent(), set(there())
    assert len(versions.renamed(*df, block=3000).collect()) > 50
    for _ in range(20):
        left = sum(n for f, n in there().items() if f not in old)
        if left < 0.4 * (sent() - before):
            break
        time.sleep(0.5)
    else:
        pytest.fail(f"{left} bytes of {sent() - before} are left")


def test_rounds_and_blocks():
    classes = [(c, 40 * c, int(2 ** (c / 8)) + 1, int(2 ** ((c + 1) / 8))) for c in range(30, 80)]
    dealt, blocks, inside = versions.cut(classes, 3000)
    assert sum(inside) == sum(x[1] for x in classes) and max(inside) <= 3000
    assert [x[0] for x in dealt] == [x[0] for x in classes] and all(0 <= first and first + parts <= len(blocks) for _, first, parts, _ in dealt)
    assert all(blocks[first][0] <= low and high <= blocks[first][1] for (_, _, low, high), (_, first, _, _) in zip(classes, dealt, strict=True))
    rounds = versions.rounds([blocks] * 2, [inside] * 2, 0.5)
    pairs = [p for r in rounds for p in r]
    assert len(rounds) > 1 and len(set(pairs)) == len(pairs)
    assert all(sum(inside[i] + inside[j] for i, j in r[:-1]) < versions.ROUND * 2 * sum(inside) for r in rounds)
    near = {(i, j) for i, a in enumerate(blocks) for j, b in enumerate(blocks) if 2 * a[1] >= b[0] and 2 * b[1] >= a[0]}
    assert set(pairs) == near
    assert versions.rounds([[], blocks], [[], inside], 0.5) == [] and versions.cut([], 5) == ([], [], [])


def test_numbers_in_few_bytes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2**k, 50) for k in range(1, 62, 3)] + [[0, 127, 128, 2**14 - 1, 2**14]])
    assert (versions.unsqueezed(versions.squeezed(x)) == x).all() and len(versions.squeezed(np.arange(128))) == 128
    assert len(versions.unsqueezed(b"")) == 0


def test_files_that_stay_are_not_shuffled(spark):
    """The bitmap is looked up before files are dealt by path, and the paths themselves decide."""
    files = spark.createDataFrame([(f"p{i}", "x") for i in range(400)], "path string, text string")
    paths = spark.createDataFrame([(f"p{i}",) for i in [*range(0, 400, 40), 0]], "path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = versions.only(files, paths)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.index("SortMergeJoin [path") < plan.index("BroadcastHashJoin [bucket")
        assert sorted(r.path for r in found.collect()) == sorted(f"p{i}" for i in range(0, 400, 40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_is_stored_for_now_goes(spark, tmp_path):
    with graph.stored_for_now(spark.range(9), "kept") as df:
        folder = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.agg(F.sum("id")).first()[0] == 36 and folder.split("/")[-1] in "".join(graph._stored)
    assert not Path(urlparse(folder).path).exists() and folder.split("/")[-1] not in "".join(graph._stored)


def test_no_files_and_odd_lines(spark):
    schema = "path string, text string"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("a", "x\r\ny  \r\n\r\n"), ("c", "z")], schema)
    other = spark.createDataFrame([("b", "x\ny\n")], schema)
    assert versions.renamed(none, some).collect() == [] and versions.renamed(some, none).collect() == []
    assert [tuple(r) for r in versions.renamed(some, other).collect()] == [("b", "a", 1.0)]
