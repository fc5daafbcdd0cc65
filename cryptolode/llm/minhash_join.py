"""N-gram Jaccard similarity join by a MinHash LSH forest, with exact verification.

1. Every text becomes the set of its 5-word shingles and a signature of TREES x DEPTH MinHash values; texts with the same
   set are one node from here on.
2. A tree of the forest is the nodes sorted by its part of their signatures: a sorted prefix trie, whose subtrees are runs
   of rows. A pair of similarity s is found by prefixes of a depth with the chance 1 - (1 - s**depth)**TREES. The prefix
   that must match starts at full depth and is shortened, level by level, until that chance reaches the target recall for
   pairs at the threshold itself, the least similar that count; it is higher for all others. No corpus, and no sample of
   one, has a part in this. The runs of a prefix hold those of all longer ones.
   A sample (SAMPLE nodes, chosen by a hash, with PARTNERS partners each at most, verified exactly) serves a report alone,
   which is made where it is asked for: which bands of similarity a corpus has pairs in, and how long prefixes could be
   for those.
3. Within a run, signatures are compared; nodes that seem at least LIKELY similar are linked to the first of their kind
   (never pair by pair), and the links' connected components are the candidate groups. No pair of a run is left out: a
   long run is compared in blocks, without what is in one component already.
4. Groups are verified exactly: every pair of a group's sets is compared inside a task, a large group in pairs of blocks.
   Only each node's number of links and its group's representative leave the task.

Result: a row per row of docs with its class (connected component of links) and its number of links (other rows whose
similarity is at least the threshold). Verification compares all pairs of distinct sets of a group, since every row's
links are counted; a group of b blocks moves each of its sets (hashes of shingles, no texts) b times, so what is moved
stays below a fixed share of what is compared. Shingles are compared by 64-bit hashes of their words, see `hashing`.

Defined results: a text of fewer words than a shingle has one shingle, all its words; a text without words (null, empty)
is in no link and a class of its own; copies are linked; a repeated row counts as a partner; a very long text is a set of
its own size, in a block of its own if need be; class_id is the smallest doc_id of the class (null only if all are); an
empty table gives an empty result; further columns are ignored by `join` and kept by `keep_one`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_unique, materialize, select_rows
from .hashing import Words, batches_of, mix64

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 5
RECALL = 0.9999
#: Nodes whose signatures put their similarity below this are not linked: 4.5 standard deviations below the threshold.
LIKELY = 0.6
#: Nodes of a run that are compared with as many others at once; a node of a run takes some 50 bytes of memory.
RUN_BLOCK = 2048
#: The sample: nodes, partners of each that are verified, depth at which they are looked for, width of a band of similarity.
SAMPLE, PARTNERS, PROBE, BAND = 2000, 8, 2, 0.02
#: Nodes and shingles, about, of a block, which a task compares with as many others at once.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
_U = np.uint64
_DRAW = np.random.default_rng(77)
_TIMES = _DRAW.integers(0, 2**64, TREES * DEPTH, dtype=_U) | _U(1)
_PLUS = _DRAW.integers(0, 2**64, TREES * DEPTH, dtype=_U)
SIGNED = "doc_id long, digest binary, node binary, shingles long, signature binary, nibbles binary"


def digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 32))


def shingles(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes."""
    words = Words(texts)
    hashes, at = words.windows(k)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if 0 < b - a < k:
            out.append(words.whole(i))
        else:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, cut to 16 bits: a row for each (not empty) set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    for j in range(TREES * DEPTH):
        out[:, j] = mix64(np.minimum.reduceat(values * _TIMES[j] + _PLUS[j], starts)) & _U(0xFFFF)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, node (digest of the shingle set), its size, signature and its low four bits, packed."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(range(batch.num_rows), batch.column(2).to_pylist(), strict=True)
            for part in batches_of(rows, lambda r: len(r[1] or ""), 1_000_000):
                index = [i for i, _ in part]
                sets = shingles([t for _, t in part])
                full = [i for i, s in enumerate(sets) if len(s)]
                node: list[bytes | None] = [None] * len(sets)
                whole: list[bytes | None] = [None] * len(sets)
                low: list[bytes | None] = [None] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full])
                    nibbles = (values & 15).astype(np.uint8)
                    packed = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
                    big = values.astype(">u2")
                    for i, v, p in zip(full, big, packed, strict=True):
                        node[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        whole[i], low[i] = v.tobytes(), p.tobytes()
                own = batch.slice(index[0], len(index))
                sizes = pa.array([len(x) for x in sets], pa.int64())
                columns = [own.column(0), own.column(1), pa.array(node, pa.binary()), sizes, *(pa.array(x, pa.binary()) for x in (whole, low))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(signed, SIGNED)


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, replaced by its shingles' hashes."""
    for batch in batches:
        rows = zip(range(batch.num_rows), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
        for part in batches_of(rows, lambda r: len(r[1] or ""), 1_000_000):
            own = batch.slice(part[0][0], len(part))
            sets = pa.array([x.tobytes() for x in shingles([t for _, t in part])], pa.binary())
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], sets], [*batch.schema.names[:-1], "set"])


def components(adjacent: np.ndarray) -> np.ndarray:
    """For each vertex the first vertex of its component, from a symmetric boolean matrix."""
    label = np.arange(len(adjacent))
    adjacent = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def one_hot(nibbles: np.ndarray) -> np.ndarray:
    """Signatures' low four bits as rows of zeros and ones, whose products count the values in which two agree."""
    values = np.empty((len(nibbles), TREES * DEPTH), np.uint8)
    values[:, ::2], values[:, 1::2] = nibbles >> 4, nibbles & 15
    return (values[:, :, None] == np.arange(16, dtype=np.uint8)).reshape(len(values), -1).astype(np.float32)


def likeness(nibbles: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Estimated similarities of all pairs (with others, if given), from four bits of each value."""
    own = one_hot(nibbles)
    return (own @ (own if others is None else one_hot(others)).T / (TREES * DEPTH) - 1 / 16) * (16 / 15)


def run_components(nibbles: np.ndarray, block: int) -> np.ndarray:
    """For each node of a run the first of its component, where nodes that seem LIKELY similar are linked.

    Blocks are compared two by two. Two nodes in one component already need no comparison, so of two blocks only the nodes
    outside their most common component are compared with all of the other block.
    """
    n = len(nibbles)
    label = np.arange(n)

    def join(x: np.ndarray, y: np.ndarray) -> None:
        """Compare nodes x with nodes y, and put together what is similar."""
        if len(x) and len(y):
            i, j = np.nonzero(likeness(nibbles[x], nibbles[y]) >= LIKELY)
            first, other = contract(label[x[i]], label[y[j]])
            if len(other):
                to = np.arange(n)
                to[other] = first
                label[:] = to[label]

    for j in range(0, n, block):
        y = np.arange(j, min(j + block, n))
        if len(y) > 1:
            own = components(likeness(nibbles[y]) >= LIKELY)
            label[y] = y[own]
        for i in range(0, j, block):
            x = np.arange(i, i + block)
            values, counts = np.unique(label[np.concatenate([x, y])], return_counts=True)
            if len(values) > 1:
                common = values[counts.argmax()]
                apart = x[label[x] != common], y[label[y] != common]
                join(apart[0], y)
                join(x[label[x] == common], apart[1])
    return label


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' components again, as links of the first of each to its others."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        for of in (x, y, label[x], label[y]):
            np.minimum.at(new, of, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = ids[label] != ids
    return ids[label][far], ids[far]


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have one width, as a matrix of bytes."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = column.offset and int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return data[begin : begin + len(column) * width].reshape(-1, width)


class Runs:
    """Links found in runs of rows that share a tree and a prefix; rows come sorted by them."""

    #: Links that are contracted and sent at once.
    PORTION = 100_000

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.ids: list[np.ndarray] = []
        self.nibbles: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.found.append((a, b))
        self.waiting += len(a)

    def add(self, ids: np.ndarray, nibbles: np.ndarray) -> None:
        """More rows of the run."""
        self.ids.append(ids)
        self.nibbles.append(nibbles)

    def close(self) -> None:
        """The run ends."""
        if sum(map(len, self.ids)) > 1:
            ids, nibbles = np.concatenate(self.ids), np.concatenate(self.nibbles)
            order = np.argsort(ids)
            ids = ids[order]
            first = ids[run_components(nibbles[order], RUN_BLOCK)]
            far = first != ids
            self.link(first[far], ids[far])
        self.ids, self.nibbles = [], []

    def links(self) -> pa.RecordBatch:
        a, b = contract(*(np.concatenate(x) for x in zip(*self.found, strict=True))) if self.found else (np.zeros(0, np.int64),) * 2
        self.found, self.waiting = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def link_runs(depth: int):
    """Links of nodes whose prefixes of this depth match, from rows (tree, part, nid, nibbles) sorted by tree and part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, last = Runs(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "nid"))
            prefix = fixed(batch.column("part"), 2 * depth)
            nibbles = fixed(batch.column("nibbles"), TREES * DEPTH // 2)
            new = np.concatenate([[True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(ids))
            if last is not None and last != (int(tree[0]), prefix[0].tobytes()):
                runs.close()
            # runs inside the batch matter if they have two rows; the first and the last may go on beyond it
            chosen = (ends - at > 1) | (at == 0) | (ends == len(ids))
            for a, b in zip(at[chosen], ends[chosen], strict=True):
                if a:
                    runs.close()
                runs.add(ids[a:b], nibbles[a:b])
                if runs.waiting > Runs.PORTION:
                    yield runs.links()
            last = (int(tree[-1]), prefix[-1].tobytes())
        runs.close()
        yield runs.links()

    return of


def recall(depth: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """How often a pair meets in some tree at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(similarities: Iterable[float] = (THRESHOLD,)) -> int:
    """The longest prefix that finds pairs of all these similarities with the target recall, shortened from full depth."""
    worst = min(similarities, default=1.0)
    for depth in range(DEPTH, 0, -1):
        if recall(depth, worst) >= RECALL:
            return depth
    raise ValueError(f"{TREES} trees can't find pairs of a similarity of {worst} with a recall of {RECALL}")


def probe(sample: list[tuple[int, bytes]]):
    """Partners of sampled nodes (nid, signature) among rows (nid, signature): of each batch, the PARTNERS of each sampled
    node that come first by a hash of the two. A partner agrees in a prefix of PROBE values of a tree and seems LIKELY
    similar."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.array([i for i, _ in sample], np.int64)
        theirs = np.frombuffer(b"".join(v for _, v in sample), ">u2").astype(np.uint16).reshape(len(sample), TREES * DEPTH)
        prefix = lambda v: functools.reduce(lambda a, j: a * 65536 + v[:, j::DEPTH].astype(_U), range(PROBE), _U(0))
        short = prefix(theirs)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.ascontiguousarray(fixed(batch.column(1), 2 * TREES * DEPTH)).view(">u2").astype(np.uint16)
            for at in range(0, len(ids), RUN_BLOCK):
                own, mine = values[at : at + RUN_BLOCK], ids[at : at + RUN_BLOCK]
                keys = prefix(own)
                meet = chosen[:, None] != mine[None, :]
                meet &= functools.reduce(np.logical_or, (short[:, t][:, None] == keys[:, t][None, :] for t in range(TREES)))
                s, n = np.nonzero(meet)
                with_hash = mix64(chosen[s].astype(_U) * _TIMES[0] + mine[n].astype(_U))
                order = np.lexsort([with_hash, s])
                s, n, with_hash = s[order], n[order], with_hash[order]
                alike = np.concatenate([np.zeros(0, bool), *((theirs[s[i : i + 65536]] == own[n[i : i + 65536]]).mean(axis=1) >= LIKELY for i in range(0, len(s), 65536))])
                s, n, with_hash = s[alike], n[alike], with_hash[alike]
                nth = np.arange(len(s)) - np.searchsorted(s, s)
                s, n, with_hash = s[nth < PARTNERS], n[nth < PARTNERS], with_hash[nth < PARTNERS]
                yield pa.RecordBatch.from_arrays([pa.array(chosen[s]), pa.array(mine[n]), pa.array((with_hash >> _U(1)).astype(np.int64))], ["a", "b", "place"])

    return of


def similarity_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of pairs of sets."""
    for batch in batches:
        pairs = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        common = [(len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True)), (len(x) + len(y)) // 8) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([pa.array([n / (of - n) for n, of in common], pa.float64())], ["similarity"])


def forest_links(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Links (a, b) between nodes (nid, signature, nibbles) that match in a prefix of this depth (by default, that which
    finds pairs at the threshold)."""
    depth = depth or stop_depth()
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select("nid", "nibbles", "signature", tree.alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * depth})").alias("part"), "nid", "nibbles")
    dealt = rows.repartition("tree", "part").sortWithinPartitions("tree", "part")
    return dealt.mapInArrow(link_runs(depth), "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(id, root) of all nodes of links (a, b): root is the smallest id of the component.

    Alternating large and small stars: each step hangs a node's neighbours on the smallest of them. A node's smallest
    neighbour is stored before it is joined, so that the join is one of two stored tables, which adaptive execution splits
    where a hub holds many links (or broadcasts, if it is small). A round ends when its links are those of the round before.
    """

    def star(edges: DataFrame, key: str, other: str, name: str) -> DataFrame:
        least = materialize(edges.groupBy(key).agg(F.min(other).alias("m")), name)
        return edges.join(least, key)

    now = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "a", "b", "least").where("b > a").select(F.least("m", "a").alias("a"), "b").where("a < b")
        large = materialize(large, "large-stars")
        small = star(large, "b", "a", "least").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        seen = Observation()
        mass = (F.col("a") % 1_000_003) + F.xxhash64("a", "b") % 1_000_003
        now = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mass).alias("mass")), "stars")
        if (seen.get["n"], seen.get["mass"]) == state:
            break
        state = (seen.get["n"], seen.get["mass"])
    roots = now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:], or of all with all if split is 0."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    group = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    counts = np.bincount(group)
    shared = counts[group] > 1
    column = (np.cumsum(counts > 1) - 1)[group[shared]]
    owner = owner[shared]
    a, b = (split, len(sets) - split) if split else (len(sets), len(sets))
    out = np.zeros((a, b), np.float32)
    width = 8192
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if i < j:
            dense = np.zeros((len(sets), int(column[j - 1] - column[i]) + 1), np.float32)
            dense[owner[i:j], column[i:j] - column[i]] = 1
            out += dense[:split] @ dense[split:].T if split else dense @ dense.T
    return out


VERIFIED = "nid long, links long, root long, whole boolean"


def verify(table: pa.Table) -> pa.Table:
    """All pairs of a unit: of one block of a group, or of two blocks with each other. whole: the unit is all of its group."""
    names = [x.split()[0] for x in VERIFIED.split(", ")]
    block = np.array(table.column("block").to_pylist())
    order = np.argsort(block, kind="stable")
    block = block[order]
    ids, copies = (np.array(table.column(c).to_pylist(), np.int64)[order] for c in ("nid", "copies"))
    packed = table.column("set").to_pylist()
    sets = [np.frombuffer(packed[i], _U) for i in order]
    within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    split = 0 if within else int((block == block[0]).sum())
    if not within and split == len(block):
        return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.bool_())], names=names)
    sizes = np.array([len(s) for s in sets])
    inter = overlaps(sets, split)
    whole = (sizes[:split, None] + sizes[None, split:] if split else sizes[:, None] + sizes[None, :]) - inter
    similar = inter >= THRESHOLD * whole - 1e-6
    n = len(ids)
    adjacent = np.zeros((n, n), dtype=bool)
    if split:
        adjacent[:split, split:], adjacent[split:, :split] = similar, similar.T
    else:
        adjacent = similar
        np.fill_diagonal(adjacent, False)
    links = adjacent @ copies if n else np.zeros(0, np.int64)
    least = np.argsort(ids)
    root = np.empty(n, np.int64)
    root[least] = ids[least][components(adjacent[np.ix_(least, least)])]
    kept = (links > 0) | (root != ids)
    whole_group = pa.array([table.column("blocks")[0].as_py() == 1] * int(kept.sum()), pa.bool_())
    return pa.table([pa.array(ids[kept]), pa.array(links[kept].astype(np.int64)), pa.array(root[kept]), whole_group], names=names)


class JaccardJoin:
    """The join's tables: `rows` (doc_id, digest, node), and `classes` (node, class_id, n_links, copies, keep_id,
    keep_digest)."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.rows = materialize(sign(docs), "signatures")
        lead = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
        grouped = self.rows.where("node is not null").groupBy("node").agg(
            F.count("*").alias("copies"), F.min(lead).alias("lead"), F.min("shingles").alias("shingles"), F.min("signature").alias("signature"), F.min("nibbles").alias("nibbles")
        )
        self.nodes = materialize(grouped.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        groups = connected(forest_links(self.nodes))
        checked = materialize(self._verified(groups), "verified")
        linked = checked.groupBy("nid").agg(F.sum("links").alias("links"))
        # a group of one block is settled; the parts of the others are put together
        roots, parts = checked.where("whole").select("nid", "root"), checked.where("not whole and nid <> root")
        if not parts.isEmpty():
            joined = connected(parts.select(F.col("root").alias("a"), F.col("nid").alias("b")))
            roots = roots.unionByName(joined.withColumnRenamed("id", "nid"))
        each = self.nodes.select("nid", "node", "lead", "copies").join(linked, "nid", "left").join(roots, "nid", "left")
        each = materialize(each.withColumn("root", F.coalesce("root", "nid")), "roots")
        best = materialize(each.groupBy("root").agg(F.min("lead").alias("best"), F.count("*").alias("members")), "best")
        total = self.nodes.count()
        classes = join_unique(each, best, "root", "members", total).select(
            "node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("best.doc_id").alias("class_id"), F.col("best.digest").alias("keep_digest"), F.col("lead.digest").alias("digest"),
        )
        self.classes = materialize(classes, "classes")

    def _texts(self) -> DataFrame:
        return self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest("text").alias("digest"))

    @functools.cached_property
    def depth(self) -> int:
        """The longest prefix that finds pairs like the sample's; a report on the corpus, which decides nothing."""
        return stop_depth(self.bands)

    @functools.cached_property
    def bands(self) -> list[float]:
        """Of each band of similarity in which the sample has pairs, the least similarity of one."""
        chosen = self.nodes.select("nid", "signature").orderBy(F.xxhash64("node")).limit(SAMPLE)
        sample = [(r.nid, bytes(r.signature)) for r in chosen.collect()]
        met = self.nodes.select("nid", "signature").mapInArrow(probe(sample), "a long, b long, place long") if sample else None
        if met is None:
            return []
        nth = F.row_number().over(W.partitionBy("a").orderBy("place", "b"))
        pairs = materialize(met.withColumn("nth", nth).where(F.col("nth") <= PARTNERS).select("a", "b"), "sample-pairs")
        either = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        wanted = self.nodes.join(F.broadcast(either), "nid").select("nid", F.col("lead.doc_id").alias("id"), F.col("lead.digest").alias("own"))
        # SAMPLE * (PARTNERS + 1) nodes at most, so that their texts are found without a shuffle of all
        found = self._texts().join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own"))).dropDuplicates(["nid"])
        sets = materialize(found.select("nid", "text").mapInArrow(shingle_sets, "nid long, set binary"), "sample-sets")
        left, right = (sets.select(F.col("nid").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        exact = pairs.join(left, "a").join(right, "b").select("set_a", "set_b").mapInArrow(similarity_of, "similarity double").where(F.col("similarity") >= THRESHOLD - 1e-9)
        bands = exact.groupBy(F.floor((F.col("similarity") - THRESHOLD) / BAND)).agg(F.min("similarity").alias("least"))
        return sorted(r.least for r in bands.collect())

    def report_recall(self) -> dict[float, float]:
        """The recall in each band of similarity at the depth at which the forest stops."""
        return {s: recall(stop_depth(), s) for s in self.bands}

    def _verified(self, groups: DataFrame) -> DataFrame:
        members = groups.withColumnRenamed("id", "nid").join(self.nodes.select("nid", "copies", "shingles", "lead"), "nid")
        members = materialize(members, "members")
        sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        # two stored tables, so that a group of a third of all nodes is split by adaptive execution
        members = members.join(materialize(sizes, "group-sizes"), "root")
        block = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
        wanted = members.select("nid", "root", "copies", "blocks", block.alias("block"), F.col("lead.doc_id").alias("id"), F.col("lead.digest").alias("own"))
        found = self._texts().join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own")))
        # a repeated row is there several times
        found = found.dropDuplicates(["nid"]).select("root", "blocks", "block", "nid", "copies", "text")
        sets = materialize(found.mapInArrow(shingle_sets, "root long, blocks int, block int, nid long, copies long, set binary"), "sets")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        units = sets.withColumn("other", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "nid", "copies", "set")
        return units.groupBy("root", "i", "j").applyInArrow(verify, VERIFIED)

    def report(self) -> DataFrame:
        own = self.rows.where("node is not null").select("doc_id", "node")
        total = own.count()
        linked = join_unique(own, self.classes.select("node", "copies", "class_id", "n_links"), "node", "copies", total)
        alone = self.rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return linked.select("doc_id", "class_id", "n_links").unionByName(alone)

    def kept(self) -> DataFrame:
        """The rows of docs that stay, one of each class: the one with the smallest doc_id."""
        stay = self.classes.where("digest = keep_digest").select("class_id", "digest")
        times = self.rows.where("node is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
        stay = times.join(stay, F.col("doc_id").eqNullSafe(F.col("class_id")) & (times["digest"] == stay["digest"])).select("doc_id", times["digest"], "copies")
        alone = self.rows.where("node is null").select("doc_id", "digest").distinct().withColumn("copies", F.lit(1).cast("long"))
        return select_rows(self.docs, stay.unionByName(alone), digest("text"))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, n_links."""
    return JaccardJoin(docs).report()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, when one of each class does."""
    return JaccardJoin(docs).kept()
