"""Mix sources to target weights, with DataFrame operations only: a multivariate-hypergeometric splitting tree.

Every source's rows are dealt into blocks by a keyed hash, which permutes them. A source's quota is an exact number of
block draws: all its blocks once for every whole time its target holds its size, then a run of blocks for the rest, the
last of them (the edge) only in part. A binary tree splits the quotas among the output shards: each node divides its
vector of quotas between its two children by a multivariate hypergeometric draw, so each shard's composition is
distributed as if all blocks had been shuffled together. Each shard then takes its own disjoint range of every source's
permuted blocks, and its rows are shuffled locally.

The edge of a source is found by descending from wide ranges of blocks to narrow ones, so that no window holds more than
FAN rows of a source, whatever its size. Rows find their shard by an equi-join on cells of their source's draws, of which
no one holds more draws than a shard's average share.

Defined results: null text has size 0; sources rank by code point, null last; a repeated row is a document of its own; a
text of any length is one document, taken whole or not at all; ties of the hash are passed in the order of doc_id; a
source whose sizes are all 0 has target 0; an empty table gives an empty mix; further columns are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialize, new_names

#: Rows of a block, about, and ranges of blocks that a step towards the edge compares.
BLOCK_ROWS, FAN = 256, 4096
#: Words of an output shard, about. There are 2**MOST_LEVELS shards at most; from there on shards grow with the corpus,
#: which changes how many partitions the result has and nothing else.
SHARD_WORDS, MOST_LEVELS = 8_000_000, 16
#: The table that leads rows to shards is broadcast up to this many rows (some 100 bytes each), and shuffled beyond.
MOST_BROADCAST = 500_000
#: No source's target is above this many times its size.
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
#: A hypergeometric draw looks this many standard deviations to either side; the mass beyond is below double precision.
REACH = 9.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) fixed by the values of cols."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size, rows, one row per source. Adds rank (from 0), weight and target.

    Water filling: with the sources in the order of cap / weight, the first k are capped, and the level that the rest
    share per unit of weight is (all sizes - their caps) / (all weights - their weights) for the least k whose next
    source isn't above its cap. One row per source goes through these windows, never one per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * MOST_TIMES
    up = W.orderBy(cap / F.col("weight"), "rank")
    before, everything = up.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    found = ranked.withColumn("level", level)
    # levels rise up to the least k that fits and fall from there on, so its level is the highest that fits
    fits = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(everything)
    return found.withColumn("target", F.least(F.coalesce(fits * F.col("weight"), F.lit(0.0)), cap.cast("double"))).drop("level")


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series shifted by 8."""

    def series(x: Column) -> Column:
        shift = functools.reduce(lambda a, b: a * b, [x + float(i) for i in range(8)])
        return let(x + 8.0, lambda z: (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z) - F.log(shift))

    return let(x, series)


def ln_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def hypergeometric(whole: Column, own: Column, draws: Column, u: Column) -> Column:
    """How many of `own` of the `whole` items are among `draws` drawn without replacement: the inverse of the
    distribution function at u, summed upwards from REACH standard deviations below the mean, each chance from the one
    before it."""

    def ends(p: Column) -> Column:
        n, k, m = p["n"], p["k"], p["m"]
        mean = F.when(n > 0, m * k / n).otherwise(0.0)
        spread = F.sqrt(F.when(n > 1, mean * (1 - k / n) * (n - m) / (n - 1)).otherwise(0.0)) * REACH + 8.0
        low, high = F.greatest(F.lit(0.0), m + k - n, F.floor(mean - spread).cast("double")), F.least(k, m, F.ceil(mean + spread).cast("double"))
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), p["u"].alias("u"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    def draw(p: Column) -> Column:
        n, k, m, low = p["n"], p["k"], p["m"], p["low"].cast("double")

        def step(state: Column, y: Column) -> Column:
            # state: the distribution function below y, the chance of y, and the answer so far
            x = y.cast("double")
            following = state["chance"] * (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))
            return F.struct(
                (state["below"] + state["chance"]).alias("below"), F.coalesce(following, F.lit(0.0)).alias("chance"), F.when(state["below"] <= p["u"], y).otherwise(state["x"]).alias("x")
            )

        first = F.exp(ln_choose(k, low) + ln_choose(n - k, m - low) - ln_choose(n, m))
        start = F.struct(F.lit(0.0).alias("below"), first.alias("chance"), p["low"].alias("x"))
        return F.when(p["low"] >= p["high"], p["low"]).otherwise(F.aggregate(F.sequence(p["low"], p["high"]), start, step, lambda s: s["x"]))

    given = F.struct(whole.cast("double").alias("n"), own.cast("double").alias("k"), draws.cast("double").alias("m"), u.alias("u"))
    return let(let(given, ends), draw)


def split(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """nodes: node, quotas array<struct<rank, blocks>>. Each node becomes two, its blocks halved between them."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["blocks"])

    def draw(state: Column, q: Column) -> Column:
        u = uniform(F.lit(seed), F.lit(level), F.col("node"), q["rank"])
        x = hypergeometric(state["whole"], q["blocks"], state["draws"], u)
        taken = F.array_append(state["taken"], F.struct(q["rank"].alias("rank"), x.alias("blocks")))
        return F.struct((state["whole"] - q["blocks"]).alias("whole"), (state["draws"] - x).alias("draws"), taken.alias("taken"))

    none = F.array().cast("array<struct<rank:int,blocks:bigint>>")
    start = F.struct(total.alias("whole"), F.ceil(total / 2).alias("draws"), none.alias("taken"))
    left = nodes.withColumn("left", F.aggregate("quotas", start, draw, lambda s: s["taken"]))
    right = F.zip_with("quotas", "left", lambda q, x: F.struct(q["rank"].alias("rank"), (q["blocks"] - x["blocks"]).alias("blocks")))
    both = left.select("node", F.posexplode(F.array(F.col("left"), right)).alias("side", "quotas"))
    return both.select((F.col("node") * 2 + F.col("side")).alias("node"), "quotas")


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: rank, blocks. Returns rank, shard, begin and end: the range of its draws that a shard takes."""
    pair = F.struct(F.col("rank").cast("int").alias("rank"), F.col("blocks").cast("long").alias("blocks"))
    nodes = quotas.agg(F.sort_array(F.collect_list(pair)).alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        nodes = split(nodes, level, seed)
        if level % 4 == 3:  # so that plans stay short and tasks many
            nodes = materialize(nodes.repartition("node"), "mix-tree")
    each = nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("q.rank", "shard", "q.blocks")
    end = F.sum("blocks").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("end", end).select("rank", "shard", (F.col("end") - F.col("blocks")).alias("begin"), "end")


class Mix:
    """The plan of a mix: `sources` has a row per source, `edge_rows` those of the blocks taken in part."""

    def __init__(self, docs: DataFrame, levels: int | None = None, seed: int = 17) -> None:
        """levels: depth of the splitting tree; by default, as many shards as hold SHARD_WORDS each."""
        self.docs, self.seed = docs, seed
        slim = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"),
            uniform(F.lit(seed), F.col("doc_id"), F.col("text")).alias("u"),
        )
        self.slim = materialize(slim, "mix-sizes")
        sizes = self.slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        plan = targets(sizes).withColumn("n_blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long"))
        times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        plan = plan.withColumn("times", times).withColumn("rest", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
        self.sources = materialize(plan, "mix-sources")
        total, most = self.sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("n_blocks"), F.lit(1))).first()
        self.sources = materialize(self._edges(most), "mix-edges")
        self.edge_rows = materialize(self._edge_rows(), "mix-edge-rows")
        self.levels = min(MOST_LEVELS, max(0, (total // SHARD_WORDS).bit_length())) if levels is None else levels
        part = (F.col("edge_rest") > 0).cast("long")
        draws = F.col("times") * F.col("n_blocks") + F.col("edge") + part
        self.sources = materialize(self.sources.withColumn("draws", draws).withColumn("width", F.greatest(F.ceil(draws / 2**self.levels), F.lit(1)).cast("long")), "mix-plan")

    def _with_plan(self, rows: DataFrame) -> DataFrame:
        """rows with their source's plan and their block; the plan has a row per source, and Spark sees its size."""
        joined = rows.join(self.sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
        return joined.withColumn("block", F.floor(F.col("u") * F.col("n_blocks")).cast("long"))

    def _edges(self, most: int) -> DataFrame:
        """The sources with edge (the block taken in part) and edge_rest (how many words to take from it); most: of the
        sources' numbers of blocks."""
        width = 1
        while width * FAN < most:
            width *= FAN
        slim = self._with_plan(self.slim).select("rank", "block", "size")
        found = self.sources.select("rank", F.lit(0).cast("long").alias("range"), F.col("rest").alias("left"))
        while width:
            # the ranges of this width within the one found so far, and the first of them that isn't taken whole
            rows = slim.withColumn("range", F.floor(F.col("block") / F.lit(width)).cast("long"))
            rows = rows.withColumn("wider", F.floor(F.col("range") / F.lit(FAN)).cast("long"))
            sums = rows.join(found.withColumnRenamed("range", "wider"), ["rank", "wider"]).groupBy("rank", "range", "left").agg(F.sum("size").alias("words"))
            run = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
            ahead = sums.withColumn("ahead", F.coalesce(F.sum("words").over(run), F.lit(0)))
            found = ahead.where("ahead <= left and ahead + words > left").groupBy("rank").agg(
                F.min("range").alias("range"), F.min_by(F.col("left") - F.col("ahead"), "range").alias("left")
            )
            found = materialize(found, "mix-ranges")
            width //= FAN
        edge = found.select("rank", F.col("range").alias("edge"), F.col("left").alias("edge_rest"))
        # without an edge, either all blocks are taken or no words at all
        full = self.sources.join(edge, "rank", "left").withColumn("edge_rest", F.coalesce("edge_rest", F.lit(0)))
        return full.withColumn("edge", F.coalesce("edge", F.when(F.col("rest") > 0, F.col("n_blocks")).otherwise(0)))

    def _edge_rows(self) -> DataFrame:
        """The different rows of the blocks taken in part (one block a source): rank, u, doc_id, twins (equal rows) and took,
        how many of them the mix takes from it.

        Rows are taken in the permuted order, passing over those that don't fit any more. A block has about BLOCK_ROWS
        different rows, so it is small enough to be one array; equal rows, of which there may be many, are counted before.
        """
        edge = self._with_plan(self.slim).where("block = edge")
        edge = edge.groupBy("rank", "edge_rest", "u", "doc_id", "size").agg(F.count("*").alias("twins"))
        blocks = edge.groupBy("rank", "edge_rest").agg(F.sort_array(F.collect_list(F.struct("u", "doc_id", "size", "twins"))).alias("items"))

        def take(state: Column, x: Column) -> Column:
            fit = F.when(state["left"] <= 0, 0).when(x["size"] > 0, F.least(F.floor(state["left"] / x["size"]), x["twins"])).otherwise(x["twins"]).cast("long")
            return F.struct((state["left"] - fit * x["size"]).alias("left"), F.array_append(state["took"], fit).alias("took"))

        start = F.struct(F.col("edge_rest").cast("long").alias("left"), F.array().cast("array<bigint>").alias("took"))
        took = F.aggregate("items", start, take, lambda s: s["took"])
        each = blocks.withColumn("took", took).select("rank", F.explode(F.arrays_zip("items", "took")).alias("e"))
        return each.select("rank", "e.items.u", "e.items.doc_id", "e.items.twins", "e.took")

    def _dealt(self, rows: DataFrame, u: str, ident: Column, source: Column) -> tuple[DataFrame, dict[str, str]]:
        """rows with their plan, and the names of its columns: those of `sources`, block, and copies, the times that the
        mix takes the row. rows has the permuting hash in column u."""
        columns = ["rank", "source", "source_size", "target", "n_blocks", "times", "edge", "width"]
        names = dict(zip([*columns, "block", "copies", "nth", "e_rank", "e_u", "e_id", "took", "twins"], new_names(rows, *columns, "block", "copies", "nth", "e_rank", "e_u", "e_id", "took", "twins"), strict=True))
        c = {k: F.col(v) for k, v in names.items()}
        joined = rows.join(self.sources.select([F.col(k).alias(names[k]) for k in columns]), source.eqNullSafe(c["source"]))
        joined = joined.withColumn(names["block"], F.floor(F.col(u) * c["n_blocks"]).cast("long"))
        edge = self.edge_rows.select(F.col("rank").alias(names["e_rank"]), F.col("u").alias(names["e_u"]), F.col("doc_id").alias(names["e_id"]), F.col("took").alias(names["took"]), F.col("twins").alias(names["twins"]))
        same = (c["rank"] == c["e_rank"]) & (F.col(u) == c["e_u"]) & ident.eqNullSafe(c["e_id"])
        whole = c["times"] + F.when(c["block"] == c["edge"], c["took"] >= c["twins"]).otherwise(c["block"] < c["edge"]).cast("long")
        keep = [*rows.columns, *[names[k] for k in [*columns, "block"]]]
        shared = self.edge_rows.where("0 < took and took < twins")
        if shared.isEmpty():
            return joined.join(edge, same, "left").select(*keep, whole.alias(names["copies"])), names
        # of equal rows, some are taken and some not: those are numbered
        partly = edge.where((c["took"] > 0) & (c["took"] < c["twins"]))
        plain = joined.join(edge, same, "left").where(c["took"].isNull() | (c["took"] == 0) | (c["took"] >= c["twins"])).select(*keep, whole.alias(names["copies"]))
        nth = F.row_number().over(W.partitionBy(c["rank"], F.col(u), c["e_id"]).orderBy(F.lit(0)))
        part = joined.where(c["block"] == c["edge"]).join(partly, same).withColumn(names["nth"], nth)
        return plain.unionByName(part.select(*keep, (c["times"] + (c["nth"] <= c["took"]).cast("long")).alias(names["copies"]))), names

    def chosen(self) -> DataFrame:
        """A row per row of docs: doc_id, source, size, source_size, target and copies, the times the mix takes it."""
        rows, names = self._dealt(self.slim, "u", F.col("doc_id"), F.col("source"))
        return rows.select("doc_id", "source", "size", *[F.col(names[k]).alias(k) for k in ("source_size", "target", "copies")])

    def cells(self) -> DataFrame:
        """rank, cell, and takers: the shards that take draws of the cell, with the draw at which each ends. Copy c of
        block b of n is its source's draw c * n + b; a cell is `width` draws."""
        ranges = shard_quotas(self.sources.select("rank", F.col("draws").alias("blocks")), self.levels, self.seed).where("end > begin")
        ranges = ranges.join(self.sources.select("rank", "width"), "rank")
        first, last = F.floor(F.col("begin") / F.col("width")).cast("long"), F.floor((F.col("end") - 1) / F.col("width")).cast("long")
        each = ranges.select("rank", F.explode(F.sequence(first, last)).alias("cell"), F.struct("end", F.col("shard").cast("int").alias("shard")).alias("taker"))
        return each.groupBy("rank", "cell").agg(F.sort_array(F.collect_list("taker")).alias("takers"))

    def shards(self, draw: str | None = None) -> DataFrame:
        """The mixed rows, with all columns of docs, shuffled within their shards; one shard is one partition.

        draw: the name of a further column for what is dealt: rank, u and doc_id of its document, the copy and the shard.
        """
        docs, n = self.docs, 1 << self.levels
        u, ident = new_names(docs, "u", "doc_id")
        rows = docs.withColumn(u, uniform(F.lit(self.seed), docs["doc_id"].cast("long"), docs["text"])).withColumn(ident, docs["doc_id"].cast("long"))
        rows, names = self._dealt(rows, u, F.col(ident), docs["source"].cast("string"))
        c = {k: F.col(v) for k, v in names.items()}
        copy, nth, shard, place, cell, takers, of = new_names(rows, "copy", "draw", "shard", "place", "cell", "takers", "of")
        out = rows.where(c["copies"] > 0).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), c["copies"] - 1)))
        out = out.withColumn(nth, F.col(copy) * c["n_blocks"] + c["block"])
        cells = materialize(self.cells(), "mix-cells")
        small = cells.count() <= MOST_BROADCAST
        cells = cells.select(F.col("rank").alias(of), F.col("cell").alias(cell), F.col("takers").alias(takers))
        here = (c["rank"] == F.col(of)) & (F.floor(F.col(nth) / c["width"]).cast("long") == F.col(cell))
        out = out.join(F.broadcast(cells) if small else cells, here)
        taker = F.element_at(F.filter(F.col(takers), lambda e: e["end"] > F.col(nth)), 1)
        out = out.withColumn(shard, taker["shard"]).withColumn(place, uniform(F.lit(self.seed + 1), F.col(shard), F.col(u), F.col(copy)))
        dealt = F.struct(c["rank"].alias("rank"), F.col(u).alias("u"), F.col(ident).alias("doc_id"), F.col(copy).alias("copy"), F.col(shard).alias("shard"))
        extra = [dealt.alias(draw)] if draw else []
        out = out.select(*docs.columns, *extra, shard, place)
        return out.repartitionById(n, F.col(shard)).sortWithinPartitions(shard, place).select(*docs.columns, *([draw] if draw else []))

    def counted(self, dealt: DataFrame) -> DataFrame:
        """dealt: rank, u and doc_id of every row of a mix. A row per row of docs, as `chosen` has, with its copies
        counted from dealt; rows that repeat one another share what was dealt of them."""
        key = ["rank", "u", "id", "no_id"]
        ident = (F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"))
        times = dealt.select("rank", "u", *ident).groupBy(*key).agg(F.count("*").alias("dealt"))
        rows = self._with_plan(self.slim).select("doc_id", "source", "size", "source_size", "target", "rank", "u", *ident)
        same = [F.first(x).alias(x) for x in ("doc_id", "source", "size", "source_size", "target")]  # equal in all twins
        each = rows.groupBy(*key).agg(F.count("*").alias("twins"), *same).join(times, key, "left").fillna(0, ["dealt"])
        each = each.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("twins"))))
        share = F.floor(F.col("dealt") / F.col("twins")).cast("long") + (F.col("nth") <= F.col("dealt") % F.col("twins")).cast("long")
        return each.select("doc_id", "source", "size", "source_size", "target", share.alias("copies"))


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken. The mix is made and stored with all columns of
    docs, and taken is counted from its rows."""
    plan = Mix(docs, seed=seed)
    (draw,) = new_names(docs, "draw")
    mixed = materialize(plan.shards(draw), "mixed")
    rows = plan.counted(mixed.select(f"{draw}.*"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, levels: int | None = None, seed: int = 17) -> DataFrame:
    """The mixed rows with all columns of docs, rows repeated as the mix takes them, dealt to 2**levels shards by the
    splitting tree and shuffled within each."""
    return Mix(docs, levels, seed).shards()
