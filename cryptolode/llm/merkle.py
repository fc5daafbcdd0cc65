"""Merkle manifests of datasets by cogrouped subtree exchange.

Every row is a leaf; the leaves of a lang, by ascending doc_id, make a binary tree, and the roots of those trees, by
ascending lang, one more. A tree is cut into superblocks, whole subtrees of 2**HEIGHT leaves.

Up: each superblock is reduced to its top node in a task of its own; the tops are the nodes of the next round, which is cut
into superblocks in turn, until a node a tree is left. A round has a 2**HEIGHT-th of the nodes of the one before.
Down: the nodes that a superblock's leaves need from outside it (the siblings of all that stands above its top) are made
round by round, and each round's nodes are cogrouped with their outer nodes by superblock. That one exchange finishes the
local reduction, joins the inner and outer halves of every proof, and folds each leaf up to the root.

No group has more than 2**HEIGHT leaves and a few dozen outer nodes, whatever share of the rows a lang has. Texts are read
once and never shuffled: all that moves are digests. Places in a tree come from ranges of the order, see `numbered`.

Defined results: a null is hashed as `-` and so differs from an empty text; a null lang is a tree of its own, the first;
null ids are the first leaves of their tree and never tampered with; rows of equal doc_id follow by their leaves, equal rows
in any order (they are equal leaves, each with its own proof); a tree of one leaf is that leaf; an odd last node is hashed
alone; a text of any length is hashed whole; an empty table has no rows and no root; further columns are never looked at.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

#: A superblock has 2**HEIGHT leaves.
HEIGHT = 10
#: Where this divides the crc32 of an id, the report's tampering adds 1 to n_chars.
TAMPERED = 7
NODES = "tree string, block long, nth long, total long, digest string"
OUTER = "tree string, block long, height int, side string, digest string"
PROVEN = "doc_id string, leaf string, subroot string, proof string, folded string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(n_chars: Column) -> Column:
    """The leaf of a row of documents, with n_chars as given."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(framed, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the lang as a key that sorts as it does), doc_id, leaf, and forged: the leaf after tampering, if it differs."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    lang = F.col("lang").cast("string")
    tree = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars")).alias("leaf"), F.when(hit, leaf(F.col("n_chars") + 1)).alias("forged"))


def steps(total: int, height: int) -> int:
    """How many levels of a tree with so many nodes a superblock is reduced by."""
    return min(height, (int(total) - 1).bit_length())


def levels(nodes: list[str], count: int) -> list[list[str]]:
    """The nodes of a superblock, and those of each level above them."""
    out = [nodes]
    for _ in range(count):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(inner: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What a node of a superblock meets on its way to the top, level by level: the side of its sibling (`<` left, `>`
    right, `-` none) and the sibling."""
    out = []
    for level in inner[:-1]:
        other = at ^ 1
        out.append(("<" if at & 1 else ">", level[other]) if other < len(level) else ("-", ""))
        at >>= 1
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for side, other in path:
        node = digest(other, node) if side == "<" else digest(node, other)
    return node


def way(outer: pd.DataFrame) -> list[tuple[str, str]]:
    """Outer nodes in the order of their heights."""
    outer = outer.sort_values("height")
    return list(zip(outer["side"], outer["digest"], strict=True))


def top(height: int):
    """Reduces a superblock to its top node, which is a node of the next round."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        total = int(rows["total"].iloc[0])
        node = levels(rows["digest"].tolist(), steps(total, height))[-1][0]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1].tolist(), "nth": rows["block"].iloc[:1].tolist(), "total": [-(-total >> height)], "digest": [node]})

    return of


def pass_down(height: int):
    """What each node of a superblock, as the top of a superblock of the round below, needs from outside of that."""

    def of(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, path = nodes.sort_values("nth"), way(outer)
        inner, rows = levels(nodes["digest"].tolist(), steps(nodes["total"].iloc[0], height)), []
        for at, (tree, nth) in enumerate(zip(nodes["tree"], nodes["nth"], strict=True)):
            rows += [(tree, nth, h, side, other) for h, (side, other) in enumerate(siblings(inner, at) + path)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTER.split(", ")])

    return of


def to_trees(height: int):
    """What each tree, a leaf of the tree of trees, needs from outside; side `=` is its own root."""

    def of(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, path = nodes.sort_values("nth"), way(outer)
        inner, rows = levels(nodes["digest"].tolist(), steps(nodes["total"].iloc[0], height)), []
        for at, (tree, own) in enumerate(zip(nodes["of"], nodes["digest"], strict=True)):
            rows += [(tree, 0, h, side, other) for h, (side, other) in enumerate([("=", own), *siblings(inner, at), *path])]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTER.split(", ")])

    return of


def prove(height: int):
    """The proofs of a superblock's leaves, and what they fold to."""

    def of(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, path = rows.sort_values("nth"), way(outer)
        subroot = next(d for side, d in path if side == "=")
        path = [p for p in path if p[0] != "="]
        inner = levels(rows["leaf"].tolist(), steps(rows["total"].iloc[0], height))
        above, out = "".join(d for _, d in path), {"proof": [], "folded": []}
        for at, own in enumerate(rows["forged"].where(rows["forged"].notna(), rows["leaf"])):
            met = siblings(inner, at)
            out["proof"].append(digest(*[d for _, d in met], above))
            out["folded"].append(fold(own, met + path))
        return pd.DataFrame({"doc_id": rows["doc_id"].tolist(), "leaf": rows["leaf"].tolist(), "subroot": subroot} | out)

    return of


class Forest:
    """Trees over nodes (tree, nth, total, digest), one round after another; `tops` has one node a tree."""

    def __init__(self, nodes: DataFrame, height: int = HEIGHT) -> None:
        self.height, self.rounds, self.tops = height, [], nodes
        while True:
            cut = self.tops.select("tree", F.shiftright("nth", height).alias("block"), "nth", "total", "digest")
            self.rounds.append(materialize(cut, "merkle-nodes"))
            self.tops = self.rounds[-1].groupBy("tree", "block").applyInPandas(top(height), "tree string, nth long, total long, digest string")
            if self.rounds[-1].where(F.col("total") > 1 << height).isEmpty():
                break

    def outer(self, above: DataFrame) -> DataFrame:
        """above: OUTER rows of each tree as a whole (block 0), what is needed from outside of it. Those of each superblock
        of the leaves."""
        for level in reversed(self.rounds[1:]):
            above = level.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(pass_down(self.height), OUTER)
        return above


class Manifest:
    """The trees of a table: `leaves` (tree, doc_id, leaf, forged, nth, total), `subroots` (tree, digest), `root`."""

    def __init__(self, docs: DataFrame, height: int = HEIGHT) -> None:
        self.height = height
        self.leaves = numbered(leaves(docs), ["tree", "doc_id", "leaf"], "merkle-leaves", groups=1)
        self.leaves = materialize(self.leaves, "merkle-leaves")
        self.forest = Forest(self.leaves.withColumnRenamed("leaf", "digest"), height)
        self.subroots = materialize(self.forest.tops.select("tree", "digest"), "merkle-subroots")
        # the trees are the leaves of one more tree
        over = numbered(self.subroots, ["tree"], "merkle-trees").withColumn("of", F.col("tree")).withColumn("tree", F.lit(""))
        self.over = materialize(over, "merkle-trees")
        self.crown = Forest(self.over, height)
        found = self.crown.tops.first()
        self.root: str | None = found.digest if found else None

    def outer(self) -> DataFrame:
        """What each superblock of leaves needs from outside: its tree's root and the siblings of its top and of all above."""
        crown = self.crown.outer(self.over.sparkSession.createDataFrame([], OUTER))  # of each superblock of trees
        over = self.over.withColumn("block", F.shiftright("nth", self.height))
        trees = over.groupBy("tree", "block").cogroup(crown.groupBy("tree", "block")).applyInPandas(to_trees(self.height), OUTER)
        return self.forest.outer(materialize(trees, "merkle-outer"))

    def proofs(self) -> DataFrame:
        """A row per leaf: doc_id, leaf, subroot, proof (the siblings' digest, level by level), and folded: the root that
        the forged leaf, or else the leaf, comes to with those siblings."""
        # ids as text, since pandas has no whole numbers beside nulls
        blocks = self.leaves.withColumn("block", F.shiftright("nth", self.height)).withColumn("doc_id", F.col("doc_id").cast("string"))
        proven = blocks.groupBy("tree", "block").cogroup(self.outer().groupBy("tree", "block")).applyInPandas(prove(self.height), PROVEN)
        return proven.withColumn("doc_id", F.col("doc_id").cast("long"))


def report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    tree = Manifest(docs, height)
    return tree.proofs().select(
        "doc_id", "leaf", "subroot", F.lit(tree.root).cast("string").alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.lit(tree.root)).alias("verified"),
    )
