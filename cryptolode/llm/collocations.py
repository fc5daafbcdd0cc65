"""Phrase collocations by top-order marginalisation.

At each word of a piece stands a window: the word and the LONGEST - 1 that follow it, as one column each, padded with nulls
where the piece ends. Only these longest windows are counted. A ROLLUP of their counts then sums successively shorter
prefixes, so one table of windows gives the frequencies of all phrases of 1 to LONGEST words, and of all words of a lang;
no n-grams are made for each n.

Most windows are unlike any other, and none of these matters: a phrase of LEAST occurrences has only pairs and triples of
words of as many. A first pass counts pairs and triples in a table of counters by hash, which stop at LEAST, and
leaves one bit a counter. A window is cut (padded earlier) before the first word with which it has a pair or triple whose
bit is off. Counters are shared and so never too low: no phrase of LEAST occurrences loses one. There are more of them the
longer the texts are, from 2**BITS up to 2**MOST_BITS. Where a corpus fills all counters, less is cut, and more windows are
counted; the result is the same.

Windows are counted per task before they leave it (WAITING of them at a time, so that memory is bounded), and small
partitions are read several to a task: a frequent window leaves each task once, so fewer tasks send fewer rows. Parts of
candidates find their frequencies by joins that broadcast hot parts; candidates inside others are found from the longer
ones' subphrases; the first of each lang are chosen within parts of the lang first. No task holds a lang, a document or a
phrase's occurrences.

Defined results: null texts are empty, null langs `und` (as is the lang `und` itself); texts of any length are taken whole
(in portions of pieces, a piece as long as need be); repeated rows count again; ties are broken by frequency and phrase; an
empty table gives no rows; a lang without candidates has none; further columns are never looked at.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import join_unique, materialize
from .hashing import chain, mix64, word_hashes

LONGEST = 5
#: Occurrences that a candidate needs, and rows of a lang in the result.
LEAST, FIRST = 100, 2000
#: Counters of the first pass, at least and at most, and those of a slice, which travels and is summed as one.
BITS, MOST_BITS, SLICE = 24, 28, 16
#: Bytes of text for each counter: some five words, so that about sixteen words, pairs and triples share one.
BYTES = 32
#: Partitions that are read by one task, at most, and different windows, about, that it holds (32 bytes each, and their words).
GATHERED, WAITING = 16, 500_000
#: Characters of a batch, about, and pieces' ends.
BATCH = 2_000_000
ENDS = ".,;:!?\n\x0b\x0c\r"
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_U = np.uint64


def _table() -> np.ndarray:
    """What a byte becomes: lower case, a line end at the end of pieces, a space between words."""
    table = np.arange(256, dtype=np.uint8)
    table[[ord(c) for c in string.ascii_uppercase]] = [ord(c) for c in string.ascii_lowercase]
    table[[ord(c) for c in ENDS]] = 10
    table[9] = 32
    return table


_TABLE = _table()


class Pieces:
    """The words of a portion of a batch: their bytes, their lang (the number of a row), two hashes, and how many words there
    are from each to the end of its piece."""

    def __init__(self, data: np.ndarray, texts: np.ndarray) -> None:
        """data: bytes as by _TABLE; texts: where in data each row's text starts."""
        gap = (data == 32) | (data == 10)
        opens, shuts = np.zeros(len(data), bool), np.zeros(len(data), bool)
        opens[texts[texts < len(data)]] = True
        shuts[:-1] = opens[1:]
        self.data = data
        self.starts = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | opens))
        self.ends = np.flatnonzero(~gap & (np.append(gap[1:], True) | shuts)) + 1
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.row = np.searchsorted(texts, self.starts, side="right") - 1
        piece = np.cumsum((data == 10) | opens)[self.starts]
        self.left = np.searchsorted(piece, piece, side="right") - np.arange(len(piece))

    def counters(self, keys: np.ndarray, bits: int) -> list[np.ndarray]:
        """For runs of 1, 2 and 3 words, the counter (of 2**bits) of the run at each word (any, where it would leave the piece)."""
        n = len(self.starts)
        word = np.append(self.hashes[0], np.zeros(2, _U))
        run, out = mix64(word[:n] ^ keys[self.row]), []
        for size in (1, 2, 3):
            run = chain(run, word[size - 1 : n + size - 1], 0) if size > 1 else run
            out.append((run >> _U(64 - bits)).astype(np.int64))
        return out

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number, and the different words by number."""
        offsets = np.append(self.starts, self.ends[-1:] if len(self.ends) else 0).astype(np.int32)
        strings = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(self.data))
        coded = pc.dictionary_encode(pc.ascii_rtrim(strings, characters=" \n"))
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def portions(batch: pa.RecordBatch, most: int) -> Iterator[tuple[Pieces, np.ndarray, list[str]]]:
    """Of a batch (lang, text): portions of about `most` bytes that end with a piece, the langs' keys by row, the langs."""
    if not batch.num_rows:
        return
    langs = [lang if lang is not None else "und" for lang in batch.column(0).to_pylist()]
    keys = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], _U)
    column = batch.column(1).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    texts = offsets[:-1] - offsets[0]
    low = 0
    while low < len(whole):
        high = portion_end(whole, texts, low, most)
        yield Pieces(_TABLE[whole[low:high]], np.maximum(texts - low, 0) if low else texts), keys, langs
        low = high


def portion_end(whole: np.ndarray, texts: np.ndarray, low: int, most: int) -> int:
    """The last end of a piece within `most` bytes from low, or else the next one."""
    high = low + most
    if high >= len(whole):
        return len(whole)
    text = int(np.searchsorted(texts, high, side="right"))  # the first one that starts beyond
    ends = np.flatnonzero(_TABLE[whole[low:high]] == 10)
    last = max(int(texts[text - 1]), low + int(ends[-1]) + 1 if len(ends) else 0)
    if last > low:
        return last
    limit = int(texts[text]) if text < len(texts) else len(whole)
    for at in range(high, limit, most):
        ends = np.flatnonzero(_TABLE[whole[at : min(at + most, limit)]] == 10)
        if len(ends):
            return at + int(ends[0]) + 1
    return limit


def count_runs(least: int, bits: int, most: int):
    """Each task's counters, by slices: at (which counters, where few are above zero) and n (how much, `least` at most)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, kind(least))
        for batch in batches:
            for pieces, keys, _ in portions(batch, most):
                for size, which in enumerate(pieces.counters(keys, bits), 1):
                    ids, counts = np.unique(which[pieces.left >= size], return_counts=True)
                    table[ids] = np.minimum(table[ids].astype(np.int64) + counts, least)
        yield from slices(table)

    return of


def kind(least: int) -> np.dtype:
    """Counters that stop at `least`."""
    return np.min_scalar_type(least)


def slices(table: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The parts of a table in which there is anything: the counters above zero and where they are, or else all."""
    for i, part in enumerate(table.reshape(-1, 1 << SLICE)):
        at = np.flatnonzero(part)
        if len(at):
            sparse = len(at) * (2 + part.itemsize) < len(part) * part.itemsize
            where, n = (at.astype(np.uint16).tobytes(), part[at]) if sparse else (None, part)
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int32()), pa.array([where], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["slice", "at", "n"])


def merged(least: int, last: bool = True):
    """Slices added up, one of each in a task: their counters, or at last a bit for each of them (slice, bits)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                table = sums.setdefault(row["slice"], np.zeros(1 << SLICE, kind(least)))
                at = slice(None) if row["at"] is None else np.frombuffer(row["at"], np.uint16)
                table[at] = np.minimum(table[at].astype(np.int64) + np.frombuffer(row["n"], kind(least)), least)
        for first, table in sums.items():
            if last:
                bits = np.packbits(table >= least).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([bits], pa.binary())], ["slice", "bits"])
            else:
                yield from slices(table, first)

    return of


def bits_for(octets: int) -> int:
    """Bits of the counters' numbers for texts of so many bytes."""
    return min(MOST_BITS, max(BITS, (octets // BYTES).bit_length()))


def gathered(texts: DataFrame) -> DataFrame:
    """texts in two partitions a core, or in more, so that none is made of more than GATHERED of those that there are."""
    parts = texts.rdd.getNumPartitions()
    return texts.coalesce(max(1, 2 * texts.sparkSession.sparkContext.defaultParallelism, -(-parts // GATHERED)))


def frequent(docs: DataFrame, least: int, bits: int = BITS, most: int = BATCH) -> bytes:
    """A bit for each counter: whether it has reached `least`. 2**bits of them, however large the corpus."""
    parts = 1 << bits - SLICE
    some = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)  # tasks that first add up a slice
    schema = "slice int, at binary, n binary"
    counted = docs.mapInArrow(count_runs(least, bits, most), schema).withColumn("some", F.spark_partition_id() % some)
    # stored, so that counting isn't done again where a task is lost later on
    counted = materialize(counted, "phrase-counters")
    if some > 1:
        counted = counted.repartition("slice", "some").drop("some").mapInArrow(merged(least, last=False), schema)
    on = np.zeros(1 << bits - 3, np.uint8)
    for row in counted.drop("some").repartition("slice").mapInArrow(merged(least), "slice int, bits binary").toLocalIterator():
        on[row["slice"] << SLICE - 3 : row["slice"] + 1 << SLICE - 3] = np.frombuffer(row["bits"], np.uint8)
    return on.tobytes()


WINDOWS = f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n long"


def lead_windows(reached, bits: int, most: int, waiting: int = WAITING):
    """Each task's different windows, cut where the counters allow it, with their number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(reached.value, np.uint8)
        on = lambda which: (packed[which >> 3] >> (7 - (which & 7))) & 1
        windows = Windows(waiting)
        for batch in batches:
            for pieces, keys, langs in portions(batch, most):
                if not len(pieces.starts):
                    continue
                one, two, three = (on(w).astype(bool) & (pieces.left >= n) for n, w in enumerate(pieces.counters(keys, bits), 1))
                two[:-1] &= one[:-1] & one[1:]
                three[:-1] &= two[:-1] & two[1:]
                length = one.astype(np.int64) + two
                going = two
                for k in range(LONGEST - 2):  # a window of k + 3 words has a triple at its word k + 1
                    going = going & np.append(three[k:], np.zeros(k, bool))
                    length += going
                windows.add(pieces, length, langs)
                if windows.full():
                    yield from windows.leave()
        yield from windows.leave()

    return of


class Windows:
    """Different windows with their number, from any number of portions. Langs and words are numbered from 1, as they come
    up in windows; 0 is no word."""

    #: Windows that leave at once.
    LEAVING = 100_000

    def __init__(self, most: int) -> None:
        self.most = most
        self.langs: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.tables: list[pa.Table] = []

    def add(self, pieces: Pieces, length: np.ndarray, langs: list[str]) -> None:
        """The windows of these lengths at the words of a portion."""
        number, words = pieces.encoded()
        n = len(number)
        change = np.bincount(np.arange(n) + length, minlength=n + 1)
        inside = np.arange(1, n + 1) > np.cumsum(change)[:n]  # more windows have begun than ended
        used = np.zeros(len(words), bool)
        used[number[inside]] = True
        numbers = np.zeros(len(words), np.int32)
        numbers[used] = [self.words.setdefault(w, len(self.words) + 1) for w in words.filter(pa.array(used)).to_pylist()]
        number = np.append(numbers[number], np.zeros(LONGEST, np.int32))
        lang = np.array([self.langs.setdefault(x, len(self.langs) + 1) for x in langs], np.int32)[pieces.row]
        columns = [np.where(length > k, number[k : n + k], 0) for k in range(LONGEST)]
        self.tables.append(self.counted(pa.table([pa.array(c) for c in (lang, *columns, np.ones(n, np.int64))], names=["lang", *WORDS, "n"])))

    @staticmethod
    def counted(table: pa.Table) -> pa.Table:
        """Equal windows put together."""
        return table.group_by(["lang", *WORDS], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", *WORDS, "n"])

    def full(self) -> bool:
        """Whether there are too many to hold, once those of all portions are put together."""
        if sum(t.num_rows for t in self.tables) > self.most:
            self.tables = [self.counted(pa.concat_tables(self.tables))]
            return self.tables[0].num_rows > self.most // 2
        return False

    def leave(self) -> Iterator[pa.RecordBatch]:
        """All windows, which are forgotten."""
        if self.tables:
            langs, words = (pa.array([None, *x], pa.string()) for x in (self.langs, self.words))
            for batch in self.counted(pa.concat_tables(self.tables)).combine_chunks().to_batches(self.LEAVING):
                columns = [langs.take(batch.column("lang")), *(words.take(batch.column(w)) for w in WORDS), batch.column("n")]
                yield pa.RecordBatch.from_arrays(columns, ["lang", *WORDS, "n"])
        self.langs, self.words, self.tables = {}, {}, []


def frequencies(docs: DataFrame, least: int = LEAST, bits: int | None = None, most: int = BATCH) -> DataFrame:
    """lang, phrase, size (words; 0 with phrase '' for all words of the lang) and f, of all phrases of up to LONGEST words
    that occur `least` times."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = bits or bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    texts = gathered(texts)
    reached = docs.sparkSession.sparkContext.broadcast(frequent(texts, least, bits, most))
    windows = texts.mapInArrow(lead_windows(reached, bits, most), WINDOWS).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    windows = materialize(windows, "phrase-windows")
    # the grouping sets of a rollup are its columns' prefixes: with k of the words left, 2**(LONGEST - k) - 1 is their id
    sums = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    size = F.when(F.col("left_out") == (1 << LONGEST) - 1, 0)
    for k, w in enumerate(WORDS, 1):
        # a null in the last word that is left is padding: those windows are shorter
        size = size.when((F.col("left_out") == (1 << LONGEST - k) - 1) & F.col(w).isNotNull(), k)
    return sums.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), size.alias("size"), "f").where((F.col("size") == 0) | (F.col("size") > 0) & (F.col("f") >= least))


def look_up(rows: DataFrame, known: DataFrame, part: str, f: str) -> DataFrame:
    """rows with f, the frequency of the phrase in column `part`; a part that many rows have is joined by broadcast."""
    asked = rows.groupBy("lang", part).agg(F.count("*").alias("asked"))
    found = materialize(asked.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(f)), ["lang", part]), "phrase-parts")
    return materialize(join_unique(rows, found, ["lang", part], "asked", rows.count()).drop("asked"), "phrase-cuts")


def joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, least: int = LEAST, first: int = FIRST, bits: int | None = None, most: int = BATCH) -> DataFrame:
    """Each lang's first phrases: lang, rank, phrase, a, l, r, n, score.

    docs: lang, text. A phrase of 2 to LONGEST words that occurs a >= least times is a candidate; its score is the lowest
    floor(1000 * a * n / (l * r)) of all its cuts in two parts that occur l and r times (the first of equal ones), where n
    are all words of the lang. Candidates inside a longer one that occurs as often are left out.
    bits, most: of the counters (by default, as many as the texts' length asks for), and bytes of a batch; they change no
    result.
    """
    known = materialize(frequencies(docs, least, bits, most), "phrases")
    words, wide = F.split("phrase", " "), "decimal(19,0)"
    candidates = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    inner = known.where("size >= 3").select("lang", "f", words.alias("words"), F.col("size").alias("of"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("of") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("of") - F.col("size") + 1)))
    longer = inner.groupBy("lang", joined(F.col("words"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    own = candidates.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = materialize(cuts.withColumns({"head": joined(words, F.lit(1), F.col("cut")), "tail": joined(words, F.col("cut") + 1, F.col("size"))}), "phrase-cuts")
    cuts = look_up(look_up(cuts, known, "head", "l"), known, "tail", "r").withColumn("every", F.lit(""))
    cuts = look_up(cuts, known.where("size = 0"), "every", "n")
    score = F.call_function("div", F.col("a").cast(wide) * F.col("n").cast(wide) * F.lit(1000), F.col("l").cast(wide) * F.col("r").cast(wide)).cast("long")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    # the first of each part of a lang, then of what is left of the lang
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for part in (F.pmod(F.xxhash64("phrase"), F.lit(parts)), F.lit(0)):
        order = W.partitionBy("lang", part).orderBy(F.desc("score"), F.desc("a"), "phrase")
        scored = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
