"""Closures by doubling and by following, against breadth-first search; long chains, rings and hubs."""

import collections
import os
import random

import pytest

from cryptolode.operators import graph


def plain_closure(edges, hops=None):
    into = collections.defaultdict(set)
    for importer, importee in edges:
        if importer != importee:
            into[importee].add(importer)
    out = set()
    for node in list(into):
        frontier, seen, hop = {node}, {node}, 0
        while frontier and (hops is None or hop < hops):
            hop += 1
            frontier = {y for x in frontier for y in into[x]} - seen
            seen |= frontier
            out |= {(node, x, hop) for x in frontier}
    return out


def random_edges(seed, n=40, m=70):
    rng = random.Random(seed)
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    return [(f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(m)] + ring + [(f"h{i}", "hub") for i in range(9)] + [("hub", "r0"), ("f1", "f1")]


@pytest.mark.parametrize("hops", [None, 1, 3, 4])
def test_closure_against_search(spark, hops):
    edges = random_edges(hops or 0)
    df = spark.createDataFrame(edges, "importer string, importee string")
    want = plain_closure(edges, hops)
    assert {tuple(r) for r in graph.transitive_importers(df, hops=hops).collect()} == want
    seeds = spark.createDataFrame([("f1",), ("f2",), ("r0",), ("nowhere",), ("f1",)], "node string")
    assert {tuple(r) for r in graph.transitive_importers(df, seeds, hops).collect()} == {x for x in want if x[0] in ("f1", "f2", "r0")}


def test_a_long_chain_takes_few_rounds(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(59)]
    graph.drop_stored(spark)
    got = graph.transitive_importers(spark.createDataFrame(edges, "importer string, importee string"))
    rounds = sum(os.path.basename(p).startswith("reached-") for p in graph._stored)
    assert rounds <= 7 and {tuple(r) for r in got.collect()} == plain_closure(edges)
    folders = list(graph._stored)
    assert graph.drop_stored(spark) == len(folders) and not any(os.path.exists(p) for p in folders)


def test_no_edges(spark):
    none = spark.createDataFrame([], "importer string, importee string")
    assert graph.transitive_importers(none).count() == 0
    assert graph.transitive_importers(none, spark.createDataFrame([("a",)], "node string")).count() == 0


def test_folders_are_counted_once(spark):
    nodes = spark.createDataFrame([(x,) for x in ("a/x", "a/y", "a/y", "b/x", "top", "a/b/x")], "node string")
    assert {tuple(r) for r in graph.same_directory(nodes).collect()} == {("a/x", 1), ("a/y", 1), ("b/x", 0), ("top", 0), ("a/b/x", 0)}
