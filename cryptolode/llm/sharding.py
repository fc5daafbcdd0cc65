"""Sharding along a Hilbert curve, with DataFrame operations only.

Four dimensions of a document's metadata (source, lang, size, doc_id) are quantised to 2**BITS levels each. A cell's place
on the Hilbert curve orders the documents, so neighbours on the curve are alike in all dimensions at once, and the order is
cut into runs of near equal bytes. Each run is a folder of Parquet files, written in the order of the curve, with a
manifest of every file's smallest and largest values, by which readers pass over files that can't hold what they want.

Texts are shuffled once, when they are written. The cuts come from a narrow table before (place, id, checksum, size): it is
sorted by ranges, partitions are summed, and only the rows at which shards begin reach the driver, one per shard.

A document goes to the shard in which the middle of its bytes lies, so no shard is off the mean by more than the largest
document. Levels: of a text column, ranks of its different values by code point (null first), spread over all levels; of a
size, its number of binary digits; of an id, equal parts of its range.

Defined results: a null text has no bytes (size 16) and the checksum of the empty text; null ids come first and are on the
lowest level; null sources and languages are values of their own; a text of any length is one document; rows that agree in
place, id and checksum follow each other in any order, and where a cut falls between them, each takes a side by chance, in
proportion; an empty table gives no files and an empty result; a document larger than a shard leaves others with fewer or
no rows; further columns are carried along, and bookkeeping columns take names that none of them has.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, new_names, numbered, scratch_path

SHARDS = 40
#: Binary digits of a level; four dimensions make 2**16 cells.
BITS = 4
#: Bytes that a document has besides its text.
OVERHEAD = 16
#: What orders documents: place on the curve, id (null first), checksum, size.
KEY = ["place", "has_id", "id", "crc", "size"]


def size(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + OVERHEAD


def checksum(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def hilbert(levels: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of the cell with these levels, from 0 to 2**(bits * len(levels)) - 1.

    From the highest digit down, each dimension in turn turns or mirrors the rest of the cube (Skilling's transform), one
    fold over pairs of digit and dimension; then Gray decoding, one fold over dimensions; then digits are interleaved.
    """
    n = len(levels)
    turns = [F.struct(F.lit(1 << b).alias("digit"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, of: Column) -> Column:
        digit, axis = of["digit"], of["axis"]
        first, own = F.element_at(x, 1), F.get(x, axis)
        below, hit = digit - 1, own.bitwiseAND(digit) != 0
        differ = first.bitwiseXOR(own).bitwiseAND(below)
        lead = first.bitwiseXOR(F.when(hit, below).otherwise(differ))
        other = own.bitwiseXOR(F.when(hit, F.lit(0)).otherwise(differ))
        return F.transform(x, lambda v, i: F.when(i == 0, lead).when(i == axis, other).otherwise(v))

    def decode(state: Column, v: Column) -> Column:
        return F.array_append(state, v.bitwiseXOR(F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit(0))))

    def finish(x: Column) -> Column:
        last = F.element_at(x, -1)
        # of the last dimension, each digit above the lowest that is set flips all digits below it, everywhere
        flips = [F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0) for b in range(bits - 1, 0, -1)]
        flip = functools.reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0))
        shown = [F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(flip), b).bitwiseAND(F.lit(1)).cast("long") for b in range(bits - 1, -1, -1) for i in range(n)]
        return functools.reduce(lambda a, b: a * 2 + b, shown)

    turned = F.aggregate(F.array(*turns), F.array(*[v.cast("int") for v in levels]), turn)
    return F.aggregate(turned, F.array().cast("array<int>"), decode, finish)


def value_levels(docs: DataFrame, name: str, bits: int = BITS) -> Column:
    """The level of a text column: each of its c different values has a rank by code point, and rank * 2**bits / c is its
    level. Only the first value of each level is collected."""
    value, known = F.col(name).cast("string"), F.col("known")
    values = docs.select(value.isNotNull().alias("known"), value.alias("v")).distinct()
    ranks = numbered(values, ["known", "v"], "shard-values")
    levels = ranks.groupBy(F.floor(F.col("nth") * (1 << bits) / F.greatest(F.col("total"), F.lit(1))).cast("int").alias("level"))
    firsts = levels.agg(F.min_by("v", "nth").alias("v"), F.min_by(known, "nth").alias("known")).collect()
    level = F.lit(0)
    for row in sorted(firsts, key=lambda r: r.level):
        level = F.when(value >= row.v if row.known else F.lit(True), row.level).otherwise(level)
    return level


def spread(x: Column, low: int | None, high: int | None, bits: int = BITS) -> Column:
    """The level of a whole number between low and high, in equal parts of that range."""
    if low is None:
        return F.lit(0)
    whole = lambda v: F.lit(str(v)).cast("decimal(20,0)")  # noqa: E731  beyond 64 bits
    part = F.call_function("div", (x.cast("decimal(20,0)") - whole(low)) * F.lit(1 << bits), whole(high - low + 1))
    return F.coalesce(part.cast("int"), F.lit(0))


class Sharding:
    """The plan of the shards of docs, and their files.

    `add_key` gives rows their place and the rest of the order's key, `cuts` the first keys of the shards.
    """

    def __init__(self, docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> None:
        self.docs, self.shards, self.bits = docs, shards, bits
        ident = F.col("doc_id").cast("long")
        digits = F.length(F.bin(size("text")))
        lows = docs.agg(F.min(ident), F.max(ident), F.min(digits), F.max(digits)).first()
        self.levels = [
            value_levels(docs, "source", bits), value_levels(docs, "lang", bits),
            spread(digits, lows[2], lows[3], bits), spread(ident, lows[0], lows[1], bits),
        ]
        names = [*KEY, "chance", "shard", "seq"]
        self.names = dict(zip(names, new_names(docs, *names), strict=True))
        key = self.add_key(docs).select(*[F.col(self.names[k]).alias(k) for k in KEY])
        self.cuts = self._cuts(key)

    def add_key(self, rows: DataFrame) -> DataFrame:
        ident = F.col("doc_id").cast("long")
        key = [hilbert(self.levels, self.bits), ident.isNotNull(), F.coalesce(ident, F.lit(0)), checksum("text"), size("text")]
        return rows.select(*rows.columns, *[c.alias(self.names[k]) for c, k in zip(key, KEY, strict=True)], F.rand(29).alias(self.names["chance"]))

    def _cuts(self, keys: DataFrame) -> list[tuple[int, tuple, float, float]]:
        """For each shard and each key at which it begins or that it shares with a neighbour: shard, key, and the range of
        the shares of that key's rows which it takes (0 to 1, all of them, unless equal rows are cut through)."""
        rows = numbered(keys, KEY, "shard-order", amount="size")
        middle = (F.col("before") * 2 + F.col("size")).cast("decimal(20,0)") * F.lit(self.shards)
        shard = F.least(F.call_function("div", middle, (F.col("amount") * 2).cast("decimal(20,0)")), F.lit(self.shards - 1)).cast("int")
        placed = materialize(rows.select(*KEY, shard.alias("shard")), "shard-places")
        firsts = placed.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("key"))
        at = [tuple(r.key) for r in firsts.collect()]
        if not at:
            return []
        # of these keys (one a shard at most), the rows in each shard
        edges = placed.join(F.broadcast(firsts.select("key.*").distinct()), KEY).groupBy(*KEY, "shard").agg(F.count("*").alias("n")).collect()
        out = []
        for key in sorted(set(at)):
            own = sorted((r.shard, r.n) for r in edges if tuple(r[k] for k in KEY) == key)
            total, done = sum(n for _, n in own), 0
            for s, n in own:
                out.append((s, key, done / total, (done + n) / total))
                done += n
        return sorted(out, key=lambda c: (c[1], c[0]))

    def shard_of(self) -> Column:
        """The shard of a row with its key: that of the last cut that isn't beyond it."""
        own = F.struct(*[F.col(self.names[k]).alias(k) for k in KEY])
        chance, found = F.col(self.names["chance"]), F.lit(0)
        for shard, key, begin, _ in self.cuts:
            lead = F.struct(*[F.lit(v).alias(k) for v, k in zip(key, KEY, strict=True)])
            # a key that is cut through: beyond it, its last shard; on it, the shard into whose share the chance falls
            taken = (own > lead) | ((own == lead) & (chance >= begin)) if begin > 0 else own >= lead
            found = F.when(taken, F.lit(shard)).otherwise(found)
        return found

    def write(self, path: str) -> ShardFiles:
        """Write all rows of docs, each shard's in the order of the curve; one shuffle by ranges of shard and key."""
        order = [F.col(self.names[k]) for k in ("shard", *KEY)]
        rows = self.add_key(self.docs).withColumn(self.names["shard"], self.shard_of())
        sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(self.names["seq"], F.monotonically_increasing_id())
        out = sorted_rows.select(*self.docs.columns, self.names["seq"], self.names["shard"])
        out.write.partitionBy(self.names["shard"]).parquet(path)
        return ShardFiles(self.docs, path, self.names["shard"], self.names["seq"], out.schema)


class ShardFiles:
    """Shards in files: rows with their shard and their slot in it, and the manifest by which files are passed over."""

    def __init__(self, docs: DataFrame, path: str, shard: str, seq: str, schema) -> None:
        self.columns, self.shard = docs.columns, shard
        self.files = docs.sparkSession.read.schema(schema).parquet(path)
        part, place = F.shiftright(seq, 33), F.col(seq).bitwiseAND(F.lit((1 << 33) - 1))
        stats = [f(c).alias(f"{n}_{c}") for c in ("source", "lang", "doc_id") for n, f in (("least", F.min), ("most", F.max))]
        each = self.files.groupBy(F.col(shard).alias("shard"), part.alias("part")).agg(
            F.count("*").alias("rows"), F.sum(size("text")).alias("bytes"), F.min(size("text")).alias("least_size"), F.max(size("text")).alias("most_size"),
            F.min(place).alias("at"), *stats, *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("source", "lang", "doc_id")],
        )
        before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        #: A row per shard and run of files of one task: shard, part, first_slot, rows, bytes, and least_, most_ and null_ of source, lang, doc_id, size.
        self.manifest = materialize(each.withColumn("first_slot", F.coalesce(F.sum("rows").over(before), F.lit(0))), "shard-manifest")
        self._part, self._place = part, place

    def rows(self, shard: str = "shard", slot: str = "slot") -> DataFrame:
        """All columns of docs, with shard and slot under these names."""
        m_shard, m_part, m_at, m_slot = new_names(self.files, "m_shard", "m_part", "m_at", "m_slot")
        parts = self.manifest.select(F.col("shard").alias(m_shard), F.col("part").alias(m_part), F.col("at").alias(m_at), F.col("first_slot").alias(m_slot))
        rows = self.files.join(parts, (F.col(self.shard) == F.col(m_shard)) & (self._part == F.col(m_part)))
        return rows.select(*self.columns, F.col(self.shard).alias(shard), (self._place - F.col(m_at) + F.col(m_slot)).alias(slot))

    def shards_with(self, **wanted) -> list[int]:
        """Shards that can hold a row with the wanted values (source, lang, doc_id; None for null), from the manifest."""
        hit = F.lit(True)
        for c, v in wanted.items():
            hit &= (F.col(f"null_{c}") > 0) if v is None else (F.col(f"least_{c}") <= F.lit(v)) & (F.col(f"most_{c}") >= F.lit(v))
        return sorted(r.shard for r in self.manifest.where(hit).select("shard").distinct().collect())

    def read(self, **wanted) -> DataFrame:
        """The rows with the wanted values; only the folders of shards that can hold them are read."""
        rows = self.files.where(F.col(self.shard).isin(self.shards_with(**wanted)))
        for c, v in wanted.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
        return rows.select(*self.columns)


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shards are written with all columns of docs and read back: a row per row of docs with doc_id, size, text_crc32,
    law, shard, slot and grown_shard (null: the law is that of near equal bytes)."""
    files = Sharding(docs, shards).write(scratch_path(docs.sparkSession, "shards"))
    slim = docs.select("doc_id", "text").columns
    rows = files.rows("_shard", "_slot").select(*slim, "_shard", "_slot")
    return rows.select(
        "doc_id", size("text").alias("size"), checksum("text").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
