"""Substring deduplication: words covered by windows that also start elsewhere, behind a count-min prefilter.

The documents are dealt into chunks, stored in a table bucketed by chunk, so that every later pass reads a chunk without
a shuffle. Three passes follow; texts never move again, only compressed sketches, digests and bit masks do.

1. Each chunk counts its windows in a count-min sketch of two rows, whose width grows with the corpus. A row is dealt in
   slices: a chunk sends the cells it has counted in a slice (sorted, as compressed differences), the slice's task adds
   up the sketches of all chunks, and sends back one bit a cell: whether its merged count is 2 or more.
2. A window whose cells say 2 in both rows is estimated to be repeated. A sketch never underestimates, so no repeated
   window is lost. Only those windows are sent, as 128-bit digests, and grouped exactly, again in slices that reply with a
   bit for each digest.
3. Each chunk removes the words that repeated windows cover.

A chunk sends a window once however often it has it, so a passage in a third of all texts burdens no task. Windows are
told apart by two hashes of 64 bits, each of them built from a hash of words of its own that mixes after every step, so
words and windows of any structure count as different unless all 128 bits agree: of 10**13 different windows, two do with
a chance of 1e-13. Messages are at most as many as windows, and fewer the larger chunks and slices are.

Defined results: null and empty texts have no words; texts with fewer words than a window keep all; a repeated row is a
document of its own, so its windows are repeated; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, scratch_table
from .hashing import Words

WINDOW = 35
#: What a task holds at once: characters of a chunk and windows of a slice. Raise both on executors with more memory:
#: a chunk sends one message to each slice, so their number falls with the product.
CHUNK_CHARS, SLICE_WINDOWS = 8_000_000, 4_000_000
#: Cells of a row of the sketch for each window of the corpus.
CELLS_PER_WINDOW = 8
ROWS = 2
MESSAGE = "key int, chunk int, n int, many binary, body binary"
REPLY = "chunk int, stage int, key int, bits binary"
#: Buckets of the table of chunks, at most (Spark takes no more than 100,000); a bucket may hold several chunks.
MOST_BUCKETS = 50_000
_U = np.uint64


def pack_numbers(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences, byte plane by byte plane, compressed."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(step.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpack_numbers(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    step = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(step, dtype=kind)


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Grouped:
    """Values grouped without losing their places: distinct values in order, their counts, and each value's group."""

    def __init__(self, *keys: np.ndarray) -> None:
        self.order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        sorted_ = [k[self.order] for k in keys]
        new = np.ones(len(self.order), dtype=bool)
        if len(new):
            new[1:] = np.any([k[1:] != k[:-1] for k in sorted_], axis=0)
        self.at = np.flatnonzero(new)
        self.values = [k[self.at] for k in sorted_]
        self.counts = np.diff(self.at, append=len(new))

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """A flag for each group, as one for each value."""
        out = np.empty(len(self.order), dtype=bool)
        out[self.order] = np.repeat(flags, self.counts)
        return out


class Chunk:
    """A chunk's windows: digests, cells in each row of the sketch, and what is known of them from replies."""

    def __init__(self, texts: list[str | None], slices: int, window: int) -> None:
        self.slices, self.window = slices, window
        self.words = Words(texts)
        self.first, self.at = self.words.windows(window, 0)
        self.second, _ = self.words.windows(window, 1)

    def cells(self, row: int) -> Grouped:
        """slice << 32 | cell of each window."""
        h = (self.first, self.second)[row]
        width = _U(CELLS_PER_WINDOW * SLICE_WINDOWS)
        slice_ = ((h >> _U(32)) * _U(self.slices)) >> _U(32)
        return Grouped((slice_ << _U(32)) | (((h & _U(0xFFFFFFFF)) * width) >> _U(32)))

    def estimated(self, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Whether each window is estimated to be repeated, given the slices' replies."""
        out = np.ones(len(self.at), dtype=bool)
        for row in range(ROWS):
            cells = self.cells(row)
            out &= cells.spread(answers(cells.values[0] >> _U(32), {k[1] - row * self.slices: v for k, v in replies.items() if k[0] == 1 and k[1] // self.slices == row}))
        return out

    def digests(self, chosen: np.ndarray) -> Grouped:
        return Grouped(self.first[chosen], self.second[chosen])

    def slice_of(self, first: np.ndarray) -> np.ndarray:
        return ((first >> _U(32)) * _U(self.slices)) >> _U(32)

    def repeated(self, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Whether each window is repeated, given the replies of both stages."""
        chosen = self.estimated(replies)
        digests = self.digests(chosen)
        out = np.zeros(len(self.at), dtype=bool)
        out[chosen] = digests.spread(answers(self.slice_of(digests.values[0]), {k[1]: v for k, v in replies.items() if k[0] == 2}))
        return out


def runs(slices: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, begin, end) of the runs of ascending slices."""
    if not len(slices):
        return []
    edge = np.flatnonzero(np.diff(slices, prepend=slices[:1] - _U(1)))
    return [(int(slices[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(slices)], strict=True)]


def answers(slices: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """The replies' bits in the order of the values that were sent."""
    parts = [bits_of(bits[s], b - a) for s, a, b in runs(slices)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def replies_of(table: pa.Table) -> dict[tuple[int, int], bytes]:
    names = ("stage", "key", "bits")
    return {(s, k): b for s, k, b in zip(*(table.column(n).to_pylist() for n in names), strict=True)}


def sketch(window: int, slices: int):
    """Pass 1 on a chunk: its sketch, a message for each slice of each row."""

    def of(table: pa.Table) -> pa.Table:
        out = []
        chunk = Chunk(table.column("text").to_pylist(), slices, window)
        name = table.column("chunk")[0].as_py()
        for row in range(ROWS):
            cells = chunk.cells(row)
            low = (cells.values[0] & _U(0xFFFFFFFF)).astype(np.uint32)
            for s, a, b in runs(cells.values[0] >> _U(32)):
                out.append((row * slices + s, name, b - a, np.packbits(cells.counts[a:b] > 1).tobytes(), pack_numbers(low[a:b])))
        return table_of(out, MESSAGE)

    return of


def merge_sketches(table: pa.Table) -> pa.Table:
    """The sum of all chunks' sketches in one slice, up to 2, and for each chunk which of its cells reach 2."""
    total = np.zeros(CELLS_PER_WINDOW * SLICE_WINDOWS, np.uint8)
    names = ("key", "chunk", "n", "many", "body")
    for _, _, n, many, body in zip(*(table.column(c).to_pylist() for c in names), strict=True):
        cells = unpack_numbers(body, np.uint32)
        total[cells] = np.minimum(total[cells] + 1 + bits_of(many, n), 2)
    out = []
    for key, chunk, _, _, body in zip(*(table.column(c).to_pylist() for c in names), strict=True):
        out.append((chunk, 1, key, np.packbits(total[unpack_numbers(body, np.uint32)] > 1).tobytes()))
    return table_of(out, REPLY)


def candidates(window: int, slices: int):
    """Pass 2 on a chunk: the digests of the windows estimated to be repeated, a message for each slice."""

    def of(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], MESSAGE)
        chunk = Chunk(table.column("text").to_pylist(), slices, window)
        digests = chunk.digests(chunk.estimated(replies_of(replies)))
        first, second = digests.values
        out = []
        for s, a, b in runs(chunk.slice_of(first)):
            body = pack_numbers(first[a:b])
            body = len(body).to_bytes(4, "little") + body + second[a:b].astype("<u8").tobytes()
            out.append((s, table.column("chunk")[0].as_py(), b - a, np.packbits(digests.counts[a:b] > 1).tobytes(), body))
        return table_of(out, MESSAGE)

    return of


def group_digests(table: pa.Table) -> pa.Table:
    """Exact groups of all chunks' digests in one slice, and for each chunk which of its digests occur again."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("key", "chunk", "n", "many", "body")), strict=True))
    firsts, seconds, many = [], [], []
    for _, _, n, flags, body in rows:
        size = int.from_bytes(body[:4], "little")
        firsts.append(unpack_numbers(body[4 : 4 + size], np.uint64))
        seconds.append(np.frombuffer(body[4 + size :], "<u8"))
        many.append(bits_of(flags, n))
    groups = Grouped(np.concatenate(firsts), np.concatenate(seconds))
    again = groups.counts > 1
    again |= np.logical_or.reduceat(np.concatenate(many)[groups.order], groups.at)
    flags, at, out = groups.spread(again), 0, []
    for key, chunk, n, _, _ in rows:
        out.append((chunk, 2, key, np.packbits(flags[at : at + n]).tobytes()))
        at += n
    return table_of(out, REPLY)


KEPT = "doc_id long, n_words long, n_removed long, text string"


def remove(window: int, slices: int):
    """Pass 3 on a chunk: its documents without the words that repeated windows cover."""

    def of(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], KEPT)
        chunk = Chunk(table.column("text").to_pylist(), slices, window)
        words = chunk.words
        start = chunk.at[chunk.repeated(replies_of(replies))]
        n = len(words.starts)
        cover = np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)[: n + 1]
        kept = np.cumsum(cover[:n]) == 0
        # the bytes of kept words and of one space after each
        data = words.data.copy()
        data[words.ends] = 32
        edge = np.zeros(len(data) + 2, np.int8)
        edge[words.starts[kept]] += 1
        edge[words.ends[kept] + 1] -= 1
        out = data[np.cumsum(edge[: len(data)], dtype=np.int8) > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(kept, words.ends - words.starts + 1, 0))])[words.first]
        counts = np.concatenate([[0], np.cumsum(kept)])[words.first]
        texts = [out[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n_words = np.diff(words.first)
        columns = [table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(counts), pa.int64()), pa.array(texts, pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "text"])

    return of


def store_chunks(docs: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """doc_id, text and chunk of all rows, in a table bucketed by chunk in the shared folder."""
    spark, name = docs.sparkSession, scratch_table("chunks")
    # dealt by position, so that no repeated row fills a chunk
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chunk.alias("chunk"))
    rows.repartition(buckets, "chunk").write.format("parquet").bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) without the words covered by windows that also start elsewhere: doc_id, n_words, n_removed and
    text, the kept words joined by single spaces."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, slices = max(1, math.ceil(chars / CHUNK_CHARS)), max(1, math.ceil(chars / 6 / SLICE_WINDOWS))
    buckets = min(MOST_BUCKETS, max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    stored = store_chunks(docs, chunks, buckets)
    by_chunk = stored.groupBy("chunk")
    first = by_chunk.applyInArrow(sketch(window, slices), MESSAGE).groupBy("key").applyInArrow(merge_sketches, REPLY)
    first = materialize(first, "estimates")
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(candidates(window, slices), MESSAGE)
    second = materialize(second.groupBy("key").applyInArrow(group_digests, REPLY), "repeats")
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(remove(window, slices), KEPT)
