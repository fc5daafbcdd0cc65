"""Exact top-k inner-product search by dual cover trees.

Vectors are dealt to their nearest pivot (pivots are a bounded sample), a pivot's vectors to rings of like distance from
it, and a ring too large for a block by a hash; queries likewise, by pivots of their own, so there are as few blocks of
queries as their number allows and each block of data is sent once to each of those that it may serve. A task indexes a
block of queries and blocks of data each in a cover tree and searches both together: a pair of nodes is dropped if the
largest product that their centres and covering radii allow is below the worst kth score of the node's queries. Leaves that
are left are multiplied as matrices, and whole blocks where too few pairs of leaves can be dropped to save time. Points that
lie too far apart for a node to have far fewer children than points stay one leaf. Queries are first searched in the block
of data nearest to theirs; then pairs of blocks are dropped by the same bound on their centres and radii, and the rest are
searched. A block of queries is sent, and k rows of each come back, once for each portion of its blocks of data.

Components are floor(256 * x), so scores are integers and exact: in single or double precision where that holds all of
them, in unbounded integers elsewhere; a component or a score beyond 64 bits is taken as the nearest long. Vectors move as
16-bit integers where they fit.

Defined results: vectors that are null or empty or hold a null or non-finite component take no part, nor do rows without
a vec_id; only vectors of one length are compared; a row with the query's own vec_id is no candidate; query rows that
repeat both id and vector are one query; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

SCALE = 256
#: Pivots at most, and the rows of a block of data and of queries, about.
PIVOTS, BLOCK, QUERY_BLOCK = 1024, 4096, 131072
#: Components, about, of the vectors of a block of queries, and of a portion of blocks of data.
QUERY_NUMBERS, PORTION_NUMBERS = 2**23, 2**24
#: Points of a leaf (a node has fewer children than 4/LEAF of its points), and how much smaller the radii of children are
#: than their node's.
LEAF, BASE = 256, 1.3
#: Products that are made at once; the share of a pair of blocks' products above which none are dropped by bounds.
TILE, WORTH = 2**20, 0.25
#: Block summaries of either side that are compared at once.
TOGETHER = 512
#: Whole numbers up to these are exact in single and in double precision.
SINGLE, EXACT = 2**24, 2**53
MOST = 2**63 - 1


def scaled(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """vec_id and v: the scaled vectors that take part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col(ident).isNotNull() & F.col(vector).isNotNull() & (F.size(F.col(vector)) > 0) & ~F.coalesce(bad, F.lit(True))
    return rows.where(ok).select(F.col(ident).cast("long").alias("vec_id"), scaled(vector).alias("v"))


def packed(v: np.ndarray) -> pa.Array:
    """Vectors of one length, one a row, as binary: of 16-bit integers if all fit, else of doubles."""
    v = np.ascontiguousarray(v, np.int16 if np.abs(v).max(initial=0) < 2**15 else np.float64)
    offsets = np.arange(len(v) + 1, dtype=np.int64) * v.shape[1] * v.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(v)])


def matrix(table: pa.Table) -> np.ndarray:
    """The packed vectors of a table of one length (dims), one a row."""
    values, dims = table.column("v").cast(pa.large_binary()).combine_chunks(), table.column("dims")[0].as_py()
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    flat, short = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets) == 2 * dims
    if short.all():
        return flat.view(np.int16).reshape(-1, dims)
    out, wide = np.empty((len(values), dims)), np.repeat(~short, np.diff(offsets))
    out[short], out[~short] = flat[~wide].view(np.int16).reshape(-1, dims), flat[wide].view(np.float64).reshape(-1, dims)
    return out


class CoverTree:
    """A cover tree over points. Nesting: a node's centre is one of its points, and of one of its children. Covering: a
    child's points are within radius / BASE of its centre. Separation: the children's centres are farther apart than that.
    A node of LEAF points or fewer, of equal points, or that would have a child for each LEAF / 4 points, has no children."""

    def __init__(self, points: np.ndarray, index: np.ndarray, centre: int = 0) -> None:
        """centre: which of the index is the centre."""
        own = points[index]
        self.index, self.centre = index, own[centre]
        self.norm = float(np.linalg.norm(self.centre))
        distance = self.apart(own, centre)
        self.radius = float(distance.max()) * (1 + 1e-12)
        self.children: list[CoverTree] = []
        if len(index) <= LEAF or self.radius == 0:
            return
        apart, nearest, centres = distance, np.zeros(len(index), int), [centre]
        while apart[far := int(apart.argmax())] > self.radius / BASE:
            if len(centres) * LEAF >= 4 * len(index):
                return
            distance = self.apart(own, far)
            closer = distance < apart
            apart[closer], nearest[closer] = distance[closer], len(centres)
            centres.append(far)
        for c, at in enumerate(centres):
            group = np.flatnonzero(nearest == c)
            self.children.append(CoverTree(points, index[group], int(np.searchsorted(group, at))))
        self.spheres = spheres(self.children)

    def leaves(self) -> list[CoverTree]:
        return [leaf for c in self.children for leaf in c.leaves()] if self.children else [self]

    @staticmethod
    def apart(points: np.ndarray, at: int) -> np.ndarray:
        across = points - points[at]
        return np.sqrt(np.einsum("ij,ij->i", across, across))


def spheres(nodes: list[CoverTree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Their centres, norms and radii."""
    return np.array([x.centre for x in nodes]), *(np.array([getattr(x, name) for x in nodes]) for name in ("norm", "radius"))


def bounds(q: CoverTree, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No product of a point below q and a point below a node (of this centre, norm and radius) is above its bound."""
    most = centres @ q.centre + q.radius * norms + radii * q.norm + q.radius * radii
    return most + 1e-9 * (np.abs(most) + (q.norm + q.radius) * (norms + radii))


class Search:
    """The k best candidates of each query so far. dtype: a precision that holds all scores."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray, dtype: type) -> None:
        self.tree, self.queries, self.query_ids, self.k = CoverTree(queries.astype(float), np.arange(len(queries))), queries.astype(dtype), query_ids, k
        self.scores, self.ids = np.full((len(queries), k), -math.inf), np.full((len(queries), k), MOST)
        self.worst = least  # a candidate below this is out
        self.ends = self.tree.leaves()
        self.order, self.sizes = np.concatenate([x.index for x in self.ends]), np.array([len(x.index) for x in self.ends])

    def block(self, data: np.ndarray, ids: np.ndarray, most: float = math.inf) -> None:
        """Search a block of data, in ascending order of ids; most: no product is above it."""
        if most < self.worst.min():
            return
        self.data, self.data_ids = data.astype(self.queries.dtype), ids
        tree = CoverTree(data.astype(float), np.arange(len(data)))
        if self.left(tree.leaves()) > WORTH:
            self.leaves(self.tree.index, tree.index)
        else:
            self.run(self.tree, tree, most)

    def left(self, others: list[CoverTree]) -> float:
        """The share of all products that is left if pairs of leaves are dropped by their bounds."""
        worst = np.minimum.reduceat(self.worst[self.order], np.cumsum(self.sizes) - self.sizes)
        centres, norms, radii = spheres(self.ends)
        sizes = np.array([len(x.index) for x in others])
        kept = sum(float(self.sizes[bounds(x, centres, norms, radii) >= worst].sum()) * n for x, n in zip(others, sizes, strict=True))
        return kept / float(self.sizes.sum() * sizes.sum())

    def run(self, q: CoverTree, n: CoverTree, most: float) -> None:
        if most < self.worst[q.index].min():
            return
        if not q.children and not n.children or len(q.index) * len(n.index) <= LEAF * LEAF:
            self.leaves(q.index, n.index)
        elif not q.children or n.children and n.radius >= q.radius:
            most = bounds(q, *n.spheres)
            for c in np.argsort(-most, kind="stable").tolist():
                self.run(q, n.children[c], most[c])
        else:
            for child, most in zip(q.children, bounds(n, *q.spheres), strict=True):
                self.run(child, n, most)

    def leaves(self, queries: np.ndarray, points: np.ndarray) -> None:
        data, ids = self.data[points].T, self.data_ids[points]
        low, high = (np.searchsorted(ids, self.query_ids[queries], side=x) for x in ("left", "right"))
        step = max(1, TILE // len(points))
        for a in range(0, len(queries), step):
            at = queries[a : a + step]
            scores = self.queries[at] @ data
            for i in np.flatnonzero(low[a : a + step] < high[a : a + step]):
                scores[i, low[a + i] : high[a + i]] = -math.inf  # the query's own
            good = scores >= np.maximum(self.worst[at], np.finfo(scores.dtype).min).astype(scores.dtype)[:, None]
            found = np.flatnonzero(good)
            if len(found) > 4 * self.k * len(at):  # of each query with many the k first
                many = np.flatnonzero(np.count_nonzero(good, axis=1) > self.k)
                own = scores[many]
                kth = np.partition(own, -self.k, axis=1)[:, -self.k, None]
                over, tie = own > kth, own == kth
                good[many] = over | tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= self.k - np.count_nonzero(over, axis=1)[:, None])
                found = np.flatnonzero(good)
            if len(found):
                i, j = np.divmod(found, len(points))
                self.take(at, i, ids[j], scores[i, j].astype(float))

    def take(self, at: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put candidates (i: for which of at; ascending) with the best so far."""
        starts = np.concatenate([[True], i[1:] != i[:-1]])
        at, owner = at[i[starts]], np.cumsum(starts) - 1
        owner = np.concatenate([np.repeat(np.arange(len(at)), self.k), owner])
        ids, scores = np.concatenate([self.ids[at].ravel(), ids]), np.concatenate([self.scores[at].ravel(), scores])
        order = np.lexsort([ids, -scores, owner])
        first = np.searchsorted(owner[order], np.arange(len(at)))
        order = order[first[:, None] + np.arange(self.k)]
        self.ids[at], self.scores[at] = ids[order], scores[order]
        self.worst[at] = np.maximum(self.worst[at], self.scores[at, -1])

    def rows(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.scores > -math.inf)
        return names[i], self.ids[i, j], self.scores[i, j].astype(np.int64)


class LargeSearch(Search):
    """The same in unbounded integers."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray, dtype: type) -> None:
        super().__init__(queries, query_ids, k, least, dtype)
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]  # heaps of (score, -id)

    def leaves(self, queries: np.ndarray, points: np.ndarray) -> None:
        data = [([int(x) for x in self.data[j]], int(self.data_ids[j])) for j in points]
        for at in queries.tolist():
            own, heap = [int(x) for x in self.queries[at]], self.best[at]
            for v, ident in data:
                item = (sum(a * b for a, b in zip(own, v, strict=True)), -ident)
                if ident == self.query_ids[at] or item[0] < self.worst[at]:
                    continue
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.worst[at] = max(self.worst[at], lower(heap[0][0]))

    def rows(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(name, -i, max(-MOST - 1, min(MOST, s))) for name, heap in zip(names.tolist(), self.best, strict=True) for s, i in heap]
        return tuple(np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3))


def lower(score: int | None) -> float:
    """The score, or a double below it where none holds it."""
    if score is None:
        return -math.inf
    return float(score) if abs(score) <= EXACT else float(score) * (1 - 1e-12 * math.copysign(1, score))


FOUND = "qid long, vec_id long, score long"


def search_blocks(k: int):
    """The trees of a block of queries and of blocks of data, searched together; the blocks by their bounds."""

    def of(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if queries.num_rows and data.num_rows:
            q, d = matrix(queries), matrix(data)
            ids, most = data.column("vec_id").to_numpy(), data.column("most").to_numpy()
            block = data.column("block").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort([ids, block, -most])
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            largest = float(np.abs(q.astype(float)).max()) * max(float(d.max()), -float(d.min())) * d.shape[1]
            kind, dtype = (Search, np.float32) if largest < SINGLE and max(largest, abs(q).max(), abs(d).max()) < SINGLE else (Search if largest < EXACT else LargeSearch, np.float64)
            least = np.array([lower(x) for x in queries.column("least").to_pylist()])
            search = kind(q, queries.column("vec_id").to_numpy(), k, least, dtype)
            for part in np.split(order, cuts):
                search.block(d[part], ids[part], float(most[part[0]]))
            found = search.rows(queries.column("qid").to_numpy())
        return pa.table(list(found), names=["qid", "vec_id", "score"])

    return of


def summarise(table: pa.Table) -> pa.Table:
    """A block's length of vectors, rows, centre, covering radius and, of queries, the least of their kth scores so far."""
    v = matrix(table).astype(float)
    centre = v.mean(axis=0)
    radius = float(np.sqrt(np.square(v - centre).sum(axis=1).max())) * (1 + 1e-12)
    worst = min(map(lower, table.column("least").to_pylist())) if "least" in table.column_names else -math.inf
    columns = {"block": table.column("block").slice(0, 1), "dims": pa.array([v.shape[1]], pa.int64()), "n": pa.array([len(v)], pa.int64())}
    return pa.table(columns | {"centre": pa.array([centre.tolist()]), "radius": pa.array([radius]), "worst": pa.array([worst])})


SUMMARY = "block string, dims long, n long, centre array<double>, radius double, worst double"


def summaries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(table.column(c).to_pylist()) for c in ("centre", "radius"))


def home_blocks(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
    """For each block of queries the block of data with the nearest centre."""
    out: list[tuple] = []
    if queries.num_rows and data.num_rows:
        (qc, _), (dc, _) = summaries(queries), summaries(data)
        apart = np.square(qc).sum(axis=1)[:, None] - 2 * (qc @ dc.T) + np.square(dc).sum(axis=1)
        blocks = data.column("block").to_pylist()
        out = [(q, blocks[j], float(apart[i, j])) for i, (q, j) in enumerate(zip(queries.column("block").to_pylist(), apart.argmin(axis=1), strict=True))]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query_block", "block", "apart"])


def near_blocks(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
    """The pairs of blocks whose bound isn't below the worst kth score of the queries, with that bound and the data's rows."""
    i, j, most = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 0))
    if queries.num_rows and data.num_rows:
        (qc, qr), (dc, dr) = summaries(queries), summaries(data)
        qn, dn = np.linalg.norm(qc, axis=1), np.linalg.norm(dc, axis=1)
        most = qc @ dc.T + qr[:, None] * dn + dr * qn[:, None] + qr[:, None] * dr
        most = most + 1e-9 * (np.abs(most) + (qn + qr)[:, None] * (dn + dr))
        i, j = np.nonzero(most >= queries.column("worst").to_numpy()[:, None])
    left, right = (x.take(pa.array(at)).cast(pa.string()) for x, at in ((queries.column("block"), i), (data.column("block"), j)))
    return pa.table([left, right, pa.array(most[i, j]), data.column("n").take(pa.array(j))], names=["query_block", "block", "most", "n"])


def side_by_side(queries: DataFrame, data: DataFrame, compare, schema: str) -> DataFrame:
    """compare on all pairs of block summaries of one length, a portion of either side at a time."""
    nq, nd = (max(1, math.ceil(x.count() / TOGETHER)) for x in (queries, data))
    portion = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qp", portion(nq)).withColumn("dp", every(nd))
    d = data.withColumn("dp", portion(nd)).withColumn("qp", every(nq))
    return q.groupBy("dims", "qp", "dp").cogroup(d.groupBy("dims", "qp", "dp")).applyInArrow(compare, schema)


def deal(rows: DataFrame, size: int, numbers: int | None = None) -> DataFrame:
    """rows (v, ...) with v packed, dims (its length) and a block: the nearest pivot of their length, a ring of like distances
    from it, and a part of the ring if its ties still are more than `size` rows. numbers: components, about, that a block may hold."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    size = size if numbers is None else max(1, min(size, numbers // max(1, dims or 1)))
    pivots = [r["v"] for r in rows.select("v").orderBy(F.xxhash64("v")).limit(min(PIVOTS, math.ceil(n / size))).collect()]  # PIVOTS vectors at most
    index = {d: (np.array([p for p in pivots if len(p) == d]), [i for i, p in enumerate(pivots) if len(p) == d]) for d in {len(p) for p in pivots}}

    def nearest(batches):
        for batch in batches:
            lengths, flat = batch.column(0).value_lengths().to_numpy().astype(np.int64), batch.column(0).flatten().to_numpy()
            starts, pivot, apart = np.cumsum(lengths) - lengths, -lengths, np.zeros(len(lengths))
            order, parts = [], []
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                v = flat[starts[own][:, None] + np.arange(d)]
                order.append(own)
                parts.append(packed(v).cast(pa.binary()))
                if d in index:
                    points, names = index[d]
                    square = np.square(v).sum(axis=1)[:, None] - 2 * (v @ points.T) + np.square(points).sum(axis=1)
                    pivot[own] = np.array(names)[square.argmin(axis=1)]
                    apart[own] = np.sqrt(np.maximum(square.min(axis=1), 0))
            v = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order)))) if parts else pa.array([], pa.binary())
            added = [pa.array(lengths, pa.int32()), pa.array(pivot, pa.int64()), pa.array(apart)]
            yield pa.RecordBatch.from_arrays([v, *batch.columns[1:], *added], [*batch.schema.names, "dims", "pivot", "apart"])

    others = [f for f in rows.schema.fields if f.name != "v"]
    schema = ", ".join(["v binary", *(f"{f.name} {f.dataType.simpleString()}" for f in others), "dims int", "pivot long", "apart double"])
    dealt = materialize(rows.select("v", *[f.name for f in others]).mapInArrow(nearest, schema), "dealt")
    # the rings' bounds: as many quantiles of the distance as the pivot's rows fill blocks
    sizes = dealt.groupBy("pivot", "dims").agg(F.count("*").alias("n"), F.percentile_approx("apart", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000).alias("marks"))
    step = F.ceil(F.col("n") / size)
    bounds = F.when(step <= 1, F.array().cast("array<double>")).otherwise(F.filter("marks", lambda x, i: (F.floor((i + 1) * step / 64) > F.floor(i * step / 64))))
    sizes = materialize(sizes.select("pivot", "dims", bounds.alias("bounds")), "marks")
    rings = dealt.join(sizes, ["pivot", "dims"])
    rings = rings.withColumn("ring", F.size(F.filter("bounds", lambda x: x < F.col("apart")))).drop("bounds", "apart")
    parts = materialize(rings.groupBy("pivot", "dims", "ring").agg(F.ceil(F.count("*") / (2 * size)).alias("parts")), "parts")
    joined = rings.join(parts, ["pivot", "dims", "ring"])
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return joined.withColumn("block", F.concat_ws("-", "pivot", "dims", "ring", part)).drop("pivot", "ring", "parts")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked."""
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def portions(near: DataFrame, data: DataFrame) -> DataFrame:
    """near (query_block, block, most, n) with the portion of its block of queries: a few portions a core in all, but no more
    rows in one than hold PORTION_NUMBERS components, about, and no fewer than a block. Each has blocks of high and low bounds."""
    rows = near.agg(F.sum("n")).first()[0] or 0
    dims = data.agg(F.max("dims")).first()[0] or 1
    size = max(1, min(max(BLOCK, math.ceil(rows / (2 * near.sparkSession.sparkContext.defaultParallelism))), max(BLOCK, PORTION_NUMBERS // dims)))
    whole = W.partitionBy("query_block")
    place = F.row_number().over(whole.orderBy(F.col("most").desc(), "block")) - 1
    return near.withColumn("portion", F.pmod(place, F.ceil(F.sum("n").over(whole) / size)).cast("int")).select("query_block", "block", "most", "portion")


def search(vectors: DataFrame, is_query: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best candidates of each query row: query_id, rank, vec_id, score. is_query is a condition on `vec_id`."""
    rows = materialize(usable(vectors, ident, vector), "vectors")
    data = materialize(deal(rows, BLOCK), "data-blocks")
    queries = materialize(rows.where(is_query).distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    queries = materialize(deal(queries, QUERY_BLOCK, QUERY_NUMBERS), "query-blocks").withColumnRenamed("block", "query_block")
    keys = ["query_block", "block"]

    # first, each block of queries in the block of data nearest to it
    q = queries.select("vec_id", "v", "dims", F.col("query_block").alias("block")).groupBy("block").applyInArrow(summarise, SUMMARY)
    d = materialize(data.select("vec_id", "v", "dims", "block").groupBy("block").applyInArrow(summarise, SUMMARY), "data-summaries")
    home = side_by_side(materialize(q, "query-summaries"), d, home_blocks, "query_block string, block string, apart double")
    pairs = materialize(home.groupBy("query_block").agg(F.min_by("block", "apart").alias("block")), "home-blocks")
    start = queries.join(pairs, "query_block").select("qid", "vec_id", "v", "dims", F.lit(None).cast("long").alias("least"), *keys)
    own = data.select("vec_id", "v", "dims", "block", F.lit(math.inf).alias("most")).join(pairs, "block")
    first = start.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(search_blocks(k), FOUND)
    first = materialize(best(first, k), "first-found")
    worst = first.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    queries = materialize(queries.join(worst, "qid", "left"), "bounded-queries")

    # then in all blocks that may hold something better, found by comparing summaries
    q = queries.select("vec_id", "v", "dims", "least", F.col("query_block").alias("block")).groupBy("block").applyInArrow(summarise, SUMMARY)
    near = side_by_side(materialize(q, "query-summaries"), d, near_blocks, "query_block string, block string, most double, n long")
    near = materialize(portions(materialize(near.join(pairs, keys, "left_anti"), "near-blocks"), data), "portions")
    keys = ["query_block", "portion"]
    left = queries.select("qid", "vec_id", "v", "dims", "least", "query_block").join(materialize(near.select(*keys).distinct(), "portions"), "query_block")
    right = data.select("vec_id", "v", "dims", "block").join(near, "block")
    rest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search_blocks(k), FOUND)
    ranked = best(first.select("qid", "vec_id", "score").unionByName(rest), k)
    return ranked.join(queries.select("qid", F.col("vec_id").alias("query_id")), "qid").select("query_id", "rank", "vec_id", "score")
