"""Best-fit packing of tokenised documents into sequences: best-two-fit over the histogram of lengths.

Documents are tokenised in Arrow batches; each gets an end id; longer ones are cut into whole pieces, the first of them
shorter. What must be packed is known from how many pieces have each length: a table of at most `capacity` rows, however
large the input. Best-two-fit runs on that histogram and gives patterns (lengths of one sequence, and how many sequences
are filled like that); pieces then take the patterns' places by their rank among the pieces of the same length, which is
counted in parallel. No piece goes through the driver, and none moves to be packed except as its id and length.

Defined results: null text is empty and is one piece, the end id alone; a repeated row is a document of its own; ties
(pieces of one length) are placed by doc_id, piece and digest; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

CAPACITY, END_ID = 1024, 2
#: Pieces of one length are ranked in groups of about this many, so a length in a third of all pieces is no hot key.
RANK_GROUP = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str):
    """A fast encoder of a byte-level BPE vocabulary file of the tokenizers library, which gives that library's ids, and
    the bytes of each id. The vocabulary's ids are its merge ranks, which is what tiktoken needs."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, added = byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    # fixed value: the split pattern that the library's byte-level pre-tokenizer uses
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    own = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    sizes = np.zeros(own.n_vocab, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    return own, sizes


def encoder(path: str):
    """Texts to ids; added tokens are found in texts, as the library does."""
    own, _ = vocabulary(path)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of the capacity, the first shorter if they don't come out even."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            waiting = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or "").astype("<u4"), end])
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, n, start, length, zlib.crc32(own.tobytes()), *([own.astype("int32")] if with_ids else [])))
                    waiting += length
                if waiting > 1_000_000:
                    yield as_batch(rows)
                    rows, waiting = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
        return pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, sequences) that use up counts (pieces of each length).

    A bin is filled greedily, longest first. If a gap is left, the smallest piece gives way to the two unpacked ones
    whose lengths come closest to filling the gap that this opens, if they fill it better. The finished bin is repeated
    while there are pieces for it, so the work depends on how many lengths there are and not on how many pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while (lengths := np.flatnonzero(left)).size:
        used = np.zeros_like(left)
        chosen, gap = [], capacity
        while True:
            free = np.flatnonzero(left[: gap + 1] > used[: gap + 1])
            if not free.size:
                break
            chosen.append(int(free[-1]))
            used[free[-1]] += 1
            gap -= int(free[-1])
        while gap and len(chosen) > 1:
            small = chosen[-1]
            room, have = gap + small, left - used
            have[small] += 1
            a = np.flatnonzero(have[1 : room + 1]) + 1
            a = a[a * 2 >= small]
            # for each first piece, the longest second one that fits beside it and is no longer
            most = np.minimum(room - a, a)
            longest = np.maximum.accumulate(np.where(have > 0, np.arange(capacity + 1), 0))
            second = longest[most]
            same = (second == a) & (have[a] < 2)
            second = np.where(same, longest[np.minimum(most, a - 1)], second)
            both = np.where(second > 0, a + second, 0)
            if not both.size or both.max() <= small:
                break
            best = int(both.argmax())
            used[small] -= 1
            chosen[-1:] = sorted((int(a[best]), int(second[best])), reverse=True)
            for x in chosen[-2:]:
                used[x] += 1
            gap = room - int(both[best])
            chosen.sort(reverse=True)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        patterns.append((chosen, times))
    return patterns


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: the ranks at which runs begin, and each run's first sequence, offset and times.

    A run is one place of one pattern; the pieces of a rank in the run go to the sequences of the pattern in turn.
    """
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            starts, runs = out.setdefault(length, ([], []))
            starts.append(taken.get(length, 0))
            runs.append((sequence, offset, times))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ... ; stored, since it is read twice) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = places(best_two_fit(histogram, capacity))
    salts = F.array(*[F.lit(1 + histogram.get(n, 0) // RANK_GROUP) for n in range(1, capacity + 1)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int"))))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                starts, own = runs[length]
                i = bisect_right(starts, rank) - 1
                sequence.append(own[i][0] + rank - starts[i])
                offset.append(own[i][1])
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    slim = ranked.select(*pieces.columns, "rank")
    return slim.mapInArrow(place, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack docs: one row per piece, with its sequence and its offset there."""
    return pack(materialize(tokenize(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces packed with their ids: sequence_id, ids, doc_ids, starts."""
    piece = F.struct("offset", "doc_id", "ids")
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    return each.select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
