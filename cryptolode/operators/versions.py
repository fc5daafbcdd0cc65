"""What became of files and lines between versions: renamed files by set similarity, and who last changed a line.

Renames. A file is the set of its lines (white space at their ends and blank lines aside). New files meet removed ones whose
sets are similar, exactly, at a threshold. Equal sets are one before that, so a thousand copies meet as one. Sets are dealt
into blocks by size and packed (different lines once, numbers of a byte or two for each set's lines), and only blocks of sizes
that can be similar are compared, two blocks in a task: what moves between tasks is packed sets, never pairs, and each task
gives one row per new set, its best. Pairs of blocks are taken in rounds, so that shuffles grow with the input and not with the
number of pairs. Within a task, two sets of m and n lines that are similar have at least c = t / (1 + t) * (m + n) in common, and
so share k lines, at least, among the m - c + k and n - c + k rarest of each; pairs that do are verified line by line.

Blame. Each version of a file is compared with the one before by patience: lines that both have once are anchors, the longest
run of anchors that keeps their order stays, and equal lines next to matched ones are matched too. Matches are pointers from a
line to the line before it was; pointers are followed by doubling, so a file of a thousand versions takes ten rounds.

Defined results: files without lines have no source; of sources of the same similarity the first by path; of removed files
with the same lines too. The first version of a file owns all its lines; of runs of the same length that which ends earliest
in the version before; a null text has no lines; a path's versions are told apart by a number.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.files import line_array
from .graph import drop_shuffles, stored, stored_for_now

#: Two files whose sets of lines are less alike are not the same file.
THRESHOLD = 0.5
#: Lines, about, of a block of old sets, which a task compares with twice as many of new ones; of a block that isn't made
#: smaller for the sake of more tasks; of a part of a block that is packed as one row; pairs that a task looks at at once.
BLOCK, LEAST, CHUNK, PAIRS = 6_000_000, 100_000, 2_000_000, 500_000
#: How often, about, each line is sent to tasks before what was sent is deleted.
ROUND = 2
#: Bits of the bitmap of paths' hashes.
PATH_BITS = 1 << 24


def line_set(text: Column) -> Column:
    """Different lines by a hash of 64 bits, in ascending order."""
    lines = F.when(F.instr(text, "\r") > 0, line_array(text)).otherwise(F.split(F.coalesce(text, F.lit("")), "\n"))
    hashes = F.transform(lines, lambda x: F.xxhash64(F.rtrim(x)))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def size_class(n: Column) -> Column:
    """Eight classes for each doubling of a set's size."""
    return F.floor(8 * F.log2(n)).cast("int")


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bytes as they need: seven bits in each, the eighth says that more follow."""
    length = np.ones(len(x), np.int64)
    for k in range(1, 9):
        length += x >> 7 * k > 0
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(length.max(initial=0))):
        own = length > k
        out[ends[own] - length[own] + k] = x[own] >> 7 * k & 127 | (length[own] > k + 1).astype(np.int64) << 7
    return out.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (raw[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        own = ends - starts >= k
        out[own] |= (raw[starts[own] + k] & 127).astype(np.int64) << 7 * k
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def in_order(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each set, which follow one another, in ascending order."""
    owner = np.repeat(np.arange(len(sizes)), sizes) * (int(numbers.max(initial=0)) + 1)
    return np.sort(owner + numbers) - owner


CHUNK_SCHEMA = "block int, ids binary, sizes binary, lines binary, codes binary, paths array<string>"


def chunk_of_sets(table: pa.Table) -> pa.Table:
    """block, id, set and path: different sets (of equal ones the first path) as one row. Lines are numbered by how often they
    occur, and a set is the steps between its numbers."""
    block, ids = table.column("block")[0].as_py(), table.column("id").to_numpy()
    paths = table.column("path").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], paths[i].encode()))
    order = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]]]
    sets = table.column("set").combine_chunks().take(pa.array(order))
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, number, counts = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[often] = np.arange(len(values))
    codes = in_order(rank[number], sizes)
    steps, starts = np.diff(codes, prepend=0), np.cumsum(sizes) - sizes
    steps[starts] = codes[starts]
    columns = [[block], [ids[order].tobytes()], [squeezed(sizes)], [values[often].tobytes()], [squeezed(steps)], [[paths[i] for i in order]]]
    types = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.string())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])


class Chunk:
    """Sets as chunk_of_sets gives them: ids, sizes, paths, the different lines, and of all sets' lines which of those they are."""

    def __init__(self, table: pa.Table, row: int) -> None:
        ids, sizes, lines, self.codes = (table.column(c)[row].as_py() for c in ("ids", "sizes", "lines", "codes"))
        self.ids, self.sizes, self.lines = np.frombuffer(ids, np.int64), unsqueezed(sizes), np.frombuffer(lines, np.int64)
        self.paths = table.column("paths")[row].as_py() if "paths" in table.column_names else []

    def numbers(self) -> np.ndarray:
        total = np.cumsum(unsqueezed(self.codes))
        ends = np.cumsum(self.sizes)
        return total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), self.sizes)


def at_least(threshold: float, own: np.ndarray, other: float) -> np.ndarray:
    """Lines that a set of this size has in common, at least, with a similar one of a size of at least `other`."""
    return np.ceil(threshold / (1 + threshold) * (own + np.maximum(other, np.ceil(threshold * own - 1e-9))) - 1e-9)


class OldSets:
    """A block of old sets: all lines by number, the rarest first, each set's numbers ascending, and where each of the first
    lines of sets is. shared: how many of their first lines similar sets share."""

    def __init__(self, chunks: list[Chunk], threshold: float, least_new: int, shared: int) -> None:
        self.threshold, self.shared = threshold, shared
        self.values = np.unique(np.concatenate([c.lines for c in chunks]))
        ends = np.cumsum([0, *(int(c.sizes.sum()) for c in chunks)])
        self.lines, counts = np.empty(ends[-1], np.int32), np.zeros(len(self.values), np.int64)
        parts = [self.lines[a:b] for a, b in itertools.pairwise(ends)]
        for part, c in zip(parts, chunks, strict=True):
            part[:] = np.searchsorted(self.values, c.lines)[c.numbers()]
            counts += np.bincount(part, minlength=len(self.values))
        self.rank = np.empty(len(self.values), np.int32)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(self.values), dtype=np.int32)
        for part, c in zip(parts, chunks, strict=True):
            part[:] = in_order(self.rank[part].astype(np.int64), c.sizes)
        self.sizes = np.concatenate([c.sizes for c in chunks])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.paths = [p for c in chunks for p in c.paths]
        self.place = np.empty(len(self.paths), np.int64)
        self.place[sorted(range(len(self.paths)), key=lambda i: self.paths[i].encode())] = np.arange(len(self.paths))
        first = np.clip(self.sizes - at_least(threshold, self.sizes, least_new) + shared, 0, self.sizes).astype(np.int64)
        at = ragged(self.starts, first)
        tokens = self.lines[at]
        self.owner = np.repeat(np.arange(len(first), dtype=np.int32), first)[np.argsort(tokens, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(self.values)))])
        self.least, self.marked = int(self.sizes.min()), np.zeros(len(self.values) + 1, bool)

    def most_similar(self, new: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """For each new set the old one most similar (of equal ones that of the first path; -1 if none reaches the threshold), and
        the similarity."""
        best, similarity, n_old = np.full(len(new.sizes), -1, np.int64), np.zeros(len(new.sizes)), len(self.sizes)
        # lines that no old set has come first, as 0
        at = np.searchsorted(self.values, new.lines)
        known = self.values[np.minimum(at, len(self.values) - 1)] == new.lines
        number = np.where(known, self.rank[np.minimum(at, len(self.values) - 1)].astype(np.int64) + 1, 0)
        lines = in_order(number[new.numbers()], new.sizes)
        starts = np.cumsum(new.sizes) - new.sizes
        strange = np.add.reduceat(lines == 0, starts)
        first = np.clip(new.sizes - at_least(self.threshold, new.sizes, self.least) + self.shared, 0, new.sizes).astype(np.int64)
        first = np.maximum(first - strange, 0)
        owner, tokens = np.repeat(np.arange(len(first)), first), lines[ragged(starts + strange, first)] - 1
        meets = self.begin[tokens + 1] - self.begin[tokens]
        owner, tokens, meets = owner[meets > 0], tokens[meets > 0], meets[meets > 0]
        total, ends = np.concatenate([[0], np.cumsum(meets)]), np.searchsorted(owner, np.arange(len(first) + 1))
        low = 0
        while low < len(first):  # portions of new sets, whole ones
            high = int(np.searchsorted(total[ends], total[ends[low]] + PAIRS, side="right")) - 1
            high = max(low + 1, min(high, low + PAIRS // n_old))
            common, a, last = np.zeros(0, np.int64), int(ends[low]), int(ends[high])
            while a < last:
                b = min(last, max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1))
                met = self.owner[ragged(self.begin[tokens[a:b]], meets[a:b])] + np.repeat((owner[a:b] - low) * n_old, meets[a:b])
                counts = np.bincount(met, minlength=(high - low) * n_old)
                common, a = common + counts if len(common) else counts, b
            i, j = np.divmod(np.flatnonzero(common >= self.shared), n_old)
            i += low
            alike = np.minimum(new.sizes[i], self.sizes[j]) / np.maximum(new.sizes[i], self.sizes[j]) >= self.threshold
            i, j = i[alike], j[alike]
            bounds = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else np.zeros(1, np.int64)
            for a, b in itertools.pairwise(bounds):
                own = int(i[a])
                self.verify(lines[starts[own] + strange[own] : starts[own] + new.sizes[own]] - 1, int(new.sizes[own]), own, j[a:b], best, similarity)
            low = high
        return best, similarity

    def verify(self, lines: np.ndarray, size: int, own: int, theirs: np.ndarray, best: np.ndarray, similarity: np.ndarray) -> None:
        """Compare a new set line by line with old ones."""
        self.marked[lines] = True
        after = np.cumsum(self.sizes[theirs])
        for part in np.split(theirs, np.flatnonzero(np.diff(after // PAIRS)) + 1):
            sizes = self.sizes[part]
            common = np.add.reduceat(self.marked[self.lines[ragged(self.starts[part], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
            alike = common / (size + sizes - common)
            k = np.lexsort([self.place[part], -alike])[0]
            if alike[k] >= self.threshold and (best[own] < 0 or (-alike[k], self.place[part[k]]) < (-similarity[own], self.place[best[own]])):
                best[own], similarity[own] = part[k], alike[k]
        self.marked[lines] = False


def cut(classes: list[tuple[int, int, int, int]], size: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]], list[float]]:
    """classes (class, lines, least and greatest size) by class: of each its first block, over how many blocks it is dealt and how
    many chunks a block has; and of each block the least and greatest size, and the lines. A block has about `size` lines at
    most, of sets of sizes in one doubling."""
    dealt, blocks, inside = [], [], []
    room = 0
    for name, lines, least, most in classes:
        parts = math.ceil(lines / size)
        if parts > 1 or lines > room or name // 8 != dealt[-1][0] // 8:
            dealt.append((name, len(blocks), parts))
            blocks += [(least, most)] * parts
            inside += [lines / parts] * parts
            room = size - lines if parts == 1 else 0
        else:
            dealt.append((name, len(blocks) - 1, 1))
            blocks[-1] = (blocks[-1][0], most)
            inside[-1] += lines
            room -= lines
    return [(name, first, parts, math.ceil(inside[first] / CHUNK)) for name, first, parts in dealt], blocks, inside


def renamed(removed: DataFrame, added: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """path (of added), source (of removed: the most similar) and similarity (at least the threshold), from path and text.
    block: lines, about, of the removed files' side of a task; it changes no result."""
    spark = removed.sparkSession
    sides, found, lines, named = [], [], [], None
    for name, df, most in (("old", removed, block), ("new", added, 2 * block)):
        # a set's number is its hash, so equal sets are one, and their paths are joined again at the end
        n = F.size("set")
        sets = df.select("path", line_set(F.col("text")).alias("set")).where(n > 0).withColumns({"id": F.xxhash64("set"), "class": size_class(n)})
        with stored_for_now(sets, "line-sets") as k:
            # a few hundred classes, whatever the input
            classes = sorted(map(tuple, k.groupBy("class").agg(F.sum(n), F.min(n), F.max(n)).collect()))
            each = math.ceil(sum(x[1] for x in classes) / math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism)))
            dealt, blocks, inside = cut(classes, min(most, max(LEAST, each)))
            place = spark.createDataFrame(dealt, "class int, first int, parts int, chunks int")
            rows = k.join(F.broadcast(place), "class").withColumn("block", F.col("first") + F.pmod("id", "parts").cast("int"))
            rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).select("block", "chunk", "id", "set", "path")
            side = stored(rows.groupBy("block", "chunk").applyInArrow(chunk_of_sets, CHUNK_SCHEMA), "chunks")
            named = stored(k.select("path", F.col("id").alias("new")), "names") if name == "new" else None
        sides.append((side if name == "old" else side.drop("paths")).withColumnRenamed("block", f"{name}_block"))
        found.append(blocks)
        lines.append(inside)

    def compared(key: tuple, before: pa.Table, after: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), [])]
        if before.num_rows and after.num_rows:
            (low, _), (least, _) = (blocks[k.as_py()] for blocks, k in zip(found, key, strict=True))
            shared = 1 + int(np.ceil(threshold / (1 + threshold) * (low + least) - 1e-9)) // 16
            sets = OldSets([Chunk(before, i) for i in range(before.num_rows)], threshold, least, shared)
            for i in range(after.num_rows):
                chunk = Chunk(after, i)
                best, similarity = sets.most_similar(chunk)
                got = np.flatnonzero(best >= 0)
                out.append((chunk.ids[got], -similarity[got], [sets.paths[i] for i in best[got]]))
        ids, distance, paths = zip(*out, strict=True)
        return pa.table([pa.array(np.concatenate(ids)), pa.array(np.concatenate(distance)), pa.array(list(itertools.chain(*paths)), pa.string())], names=["new", "distance", "source"])

    close = spark.createDataFrame([], "new long, distance double, source string")
    for near in rounds(found, lines, threshold):
        met = F.broadcast(spark.createDataFrame(near, "old_block int, new_block int"))
        left, right = (side.join(met, own).groupBy("old_block", "new_block") for side, own in zip(sides, ("old_block", "new_block"), strict=True))
        close = close.unionByName(stored(left.cogroup(right).applyInArrow(compared, close.schema), "similar"))
        drop_shuffles(spark)
    best = close.groupBy("new").agg(F.min(F.struct("distance", "source")).alias("best"))
    return named.join(best, "new").select("path", "best.source", (-F.col("best.distance")).alias("similarity"))


def rounds(blocks: list[list[tuple[int, int]]], lines: list[list[float]], threshold: float) -> list[list[tuple[int, int]]]:
    """The pairs of an old and a new block that may hold similar sets, by their least and greatest sizes, in rounds: what a
    round sends is ROUND times the lines of all blocks, about, so its shuffle grows with the input, however many pairs there are."""
    out, room = [], 0.0
    for (i, (low, high)), (j, (least, most)) in itertools.product(enumerate(blocks[0]), enumerate(blocks[1])):
        if high >= threshold * least - 1e-9 and most >= threshold * low - 1e-9:
            if room <= 0:
                out.append([])
                room = ROUND * float(sum(map(sum, lines)))
            out[-1].append((i, j))
            room -= lines[0][i] + lines[1][j]
    return out


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files whose paths are among paths. A bitmap of the paths' hashes keeps most others from being shuffled."""
    bit = F.pmod(F.xxhash64("path"), F.lit(PATH_BITS))
    bits = stored(paths.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "path-bits")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = files.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return likely.select(files.columns).join(paths.distinct(), "path")  # a semi join would be pushed below the other one


def snapshot_changes(before: DataFrame, after: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, state (new, modified, removed, renamed), source and similarity, between two snapshots (path, text). A removed
    file that is some new one's source isn't listed on its own."""
    old, new = (df.select("path", F.sha2("text", 256).alias("digest")) for df in (before, after))
    gone, come = (stored(x.join(y, "path", "left_anti").select("path"), "paths") for x, y in ((old, new), (new, old)))
    moved = stored(renamed(*(only(df.select("path", "text"), paths) for df, paths in ((before, gone), (after, come))), threshold), "renamed")
    none = (F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("similarity"))
    changed = old.join(new.select("path", F.col("digest").alias("now")), "path").where(~F.col("digest").eqNullSafe(F.col("now")))
    parts = [
        moved.select("path", F.lit("renamed").alias("state"), "source", "similarity"),
        come.join(moved, "path", "left_anti").select("path", F.lit("new").alias("state"), *none),
        gone.join(moved.select(F.col("source").alias("path")), "path", "left_anti").select("path", F.lit("removed").alias("state"), *none),
        changed.select("path", F.lit("modified").alias("state"), *none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def longest_run(values: np.ndarray | list[int]) -> np.ndarray:
    """Places of a longest ascending run of different numbers, by the piles of patience."""
    values = np.asarray(values, np.int64)
    tops, piles, before = [], np.zeros(len(values), np.int64), np.full(len(values), -1, np.int64)
    for i in range(len(values)):
        v = values[i]
        pile = bisect.bisect_left(tops, v)
        if pile:
            before[i] = piles[pile - 1]
        if pile == len(tops):
            tops.append(v)
        else:
            tops[pile] = v
        piles[pile] = i
    out, i = np.zeros(len(tops), np.int64), piles[len(tops) - 1] if tops else -1
    for k in range(len(tops) - 1, -1, -1):
        out[k] = i
        i = before[i]
    return out


def matched(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each line of new the line of old (from 0) that it was, or -1. Arrays only: a file may have millions of lines."""
    out = np.full(len(new), -1, np.int64)
    (old_once, old_at), (new_once, new_at) = ((v[c == 1], i[c == 1]) for v, i, c in (np.unique(x, return_index=True, return_counts=True) for x in (old, new)))
    _, o, n = np.intersect1d(old_once, new_once, assume_unique=True, return_indices=True)
    order = np.argsort(new_at[n])
    places, was = new_at[n][order], old_at[o][order]
    run = longest_run(was)
    kept_new, kept_old = places[run], was[run]
    out[kept_new] = kept_old
    # from each anchor, and from either end, as far as lines agree and nothing else is matched
    from_new, from_old = (np.concatenate([[-1], x]) for x in (kept_new, kept_old))
    stop_new, stop_old = (np.concatenate([x, [len(y)]]) for x, y in ((kept_new, new), (kept_old, old)))
    for i in np.flatnonzero((from_new + 1 < stop_new) & (from_old + 1 < stop_old)).tolist():
        n, o = int(from_new[i]) + 1, int(from_old[i]) + 1
        while n < stop_new[i] and o < stop_old[i] and new[n] == old[o]:
            out[n] = o
            n, o = n + 1, o + 1
    done = np.flatnonzero(out >= 0)
    at = np.searchsorted(done, stop_new) - 1
    last_new = np.where(at >= 0, done[at] if len(done) else -1, -1)
    last_old = np.where(at >= 0, out[last_new] if len(out) else -1, -1)
    for i in np.flatnonzero((stop_new - 1 > last_new) & (stop_old - 1 > last_old)).tolist():
        n, o = int(stop_new[i]) - 1, int(stop_old[i]) - 1
        while n > last_new[i] and o > last_old[i] and new[n] == old[o]:
            out[n] = o
            n, o = n - 1, o - 1
    return out


POINTERS = "path string, version long, line int, old_version long, old_line int"


def pointers(versions: DataFrame) -> DataFrame:
    """versions: path, version, text. Of each line (from 1) of each version the line of the version before that it was (null
    if it is new)."""
    lines = versions.select("path", F.col("version").cast("long").alias("version"), F.transform(line_array(F.col("text")), lambda x: F.xxhash64(x)).alias("lines"))
    order = W.partitionBy("path").orderBy("version")
    pairs = lines.withColumns({"old_version": F.lag("version").over(order), "old_lines": F.lag("lines").over(order)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, version, lines, before, old_lines in zip(*batch.columns, strict=True):
                path, version, before = path.as_py(), version.as_py(), before.as_py()
                new, old = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in (lines, old_lines))
                was = matched(old, new)
                none = was < 0
                columns = [pa.array([path] * len(new), pa.string()), pa.array(np.full(len(new), version)), pa.array(np.arange(1, len(new) + 1, dtype=np.int32))]
                columns += [pa.array(np.full(len(new), before or 0), mask=none), pa.array((was + 1).astype(np.int32), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in POINTERS.split(", ")])

    return pairs.select("path", "version", "lines", "old_version", "old_lines").mapInArrow(compared, POINTERS)


def blame(versions: DataFrame) -> DataFrame:
    """path, line (from 1), author and commit of the last version of each path: of the version since which the line has been
    there. versions: path, version (a number), author, commit, text."""
    now = stored(pointers(versions), "pointers")
    while True:
        # each round, a line points to where the line that it points to does
        further = now.where("old_version IS NOT NULL").select(F.col("path").alias("p"), F.col("version").alias("v"), F.col("line").alias("l"), F.col("old_version").alias("further"), F.col("old_line").alias("further_line"))
        same = (F.col("path") == F.col("p")) & (F.col("old_version") == F.col("v")) & (F.col("old_line") == F.col("l"))
        seen = Observation()
        jumped = now.join(further, same, "left").observe(seen, F.count("further").alias("n"))
        jumped = jumped.select("path", "version", "line", F.coalesce("further", "old_version").alias("old_version"), F.coalesce("further_line", "old_line").alias("old_line"))
        now = stored(jumped, "pointers")
        if not seen.get["n"]:
            break
    last = versions.groupBy("path").agg(F.max(F.col("version").cast("long")).alias("version"))
    owner = versions.select("path", F.col("version").cast("long").alias("since"), "author", "commit")
    own = now.join(last, ["path", "version"]).withColumn("since", F.coalesce("old_version", "version"))
    return own.join(owner, ["path", "since"]).select("path", "line", "author", "commit")
