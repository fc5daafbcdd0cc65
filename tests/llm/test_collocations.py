"""Phrase collocations against plain counting, with few counters, small portions, nulls, repeats and odd characters."""

import collections
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cryptolode.llm import collocations

from .test_corpus_operators import DOCS, corpus, lowered


def phrases_of(text, longest=5):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
        words = re.findall(r"[^\x20\x09]+", piece)
        for i in range(len(words)):
            for k in range(1, min(longest, len(words) - i) + 1):
                yield tuple(words[i : i + k])


def expected(rows, least, first):
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        counts["und" if r[2] is None else r[2]].update(phrases_of(r[1]))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        longer = collections.Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], c)
        found = []
        for p, a in often.items():
            if longer[p] < a:
                score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:cut]], f[p[cut:]], n, score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(4)
    words = ["the", "The", "of", "état", "x\x0by", "new", "york", "city", "a", "a", "a", "日本", "\x1f", "b.c", "end!"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in rng.integers(1, 60, 120)]
    texts += ["new york city, new york city\tnew york. city", "a a a a a a a a", " . ,;\n\r", "  lead and trail  ", "one two three four five six seven"] * 4
    langs = ["en", None, "und", "", "fr"]
    return [*[(i, t, langs[i % 5], "s", 1) for i, t in enumerate(texts)], *corpus()]


@pytest.mark.parametrize(("bits", "batch"), [(24, 4_000_000), (16, 300)])
def test_against_plain_counting(spark, bits, batch):
    """Also with counters so few that they are shared, and portions of a few pieces."""
    docs = spark.createDataFrame(rows(), DOCS).withColumns({"phrase": F.lit("clash"), "w1": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    for least, first in ((3, 2000), (6, 4)):
        got = sorted(tuple(r) for r in collocations.mine(docs, least, first, bits, batch).collect())
        assert got == expected(rows(), least, first)
        assert len(got) > 10


def test_windows_are_cut_only_where_no_phrase_is_lost():
    data = collocations._TABLE[np.frombuffer(b"New York city. new york\tCITY new york city", np.uint8)]
    pieces = collocations.Pieces(data, np.array([0, 24]))
    assert [bytes(data[a:b]).decode() for a, b in zip(pieces.starts, pieces.ends, strict=True)] == ["new", "york", "city"] * 2 + ["new", "york", "city"]
    assert pieces.left.tolist() == [3, 2, 1, 2, 1, 4, 3, 2, 1]
    one, two, three = pieces.counters(np.array([5, 5], np.uint64), 24)
    assert len({one[0], one[3], one[6]}) == len({two[0], two[3], two[6]}) == len({three[0], three[6]}) == 1
    assert pieces.counters(np.array([6, 5], np.uint64), 24)[1][0] != two[0]


def test_large_products_stay_exact(spark, monkeypatch):
    """Frequencies whose products pass 64 bits."""
    n = 10**15
    known = [("en", "", 0, n), ("en", "p", 1, 10**14 + 1), ("en", "q", 1, 10**14 + 7), ("en", "p q", 2, 10**14 - 3)]
    monkeypatch.setattr(collocations, "frequencies", lambda *_: spark.createDataFrame(known, "lang string, phrase string, size int, f long"))
    (row,) = collocations.mine(spark.createDataFrame([], DOCS)).collect()
    assert row.score == 1000 * (10**14 - 3) * n // ((10**14 + 1) * (10**14 + 7))


def test_empty_tables_and_texts_without_words(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None, None, None), (2, " ", "en", "a", 1)], DOCS)).collect() == []


def windows_of(texts, most=300, waiting=1_000_000):
    """What one task sends of these rows (lang, text), with counters that are all on."""
    batches = [pa.RecordBatch.from_pylist([{"lang": r[0], "text": r[1]} for r in part]) for part in (texts[::2], texts[1::2])]
    reached = types.SimpleNamespace(value=b"\xff" * (1 << 16 - 3))
    return [tuple(r.values()) for b in collocations.lead_windows(reached, 16, most, waiting)(iter(batches)) for r in b.to_pylist()]


def test_a_task_sends_a_window_once():
    """However many portions and batches it occurs in; with little room, windows leave earlier, and their sums are the same."""
    texts = [(r[2], r[1] or "") for r in rows()]
    wanted = collections.Counter()
    for lang, text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            wanted.update(("und" if lang is None else lang, *words[i : i + 5], *[None] * (i + 5 - len(words))) for i in range(len(words)))
    sent = windows_of(texts)
    assert {r[:-1]: r[-1] for r in sent} == wanted and len(sent) == len(wanted)
    early, sums = windows_of(texts, waiting=200), collections.Counter()
    for r in early:
        sums[r[:-1]] += r[-1]
    assert sums == wanted and len(early) > len(wanted)


def test_small_partitions_are_read_together(spark):
    tasks = 2 * spark.sparkContext.defaultParallelism
    for parts, gathered in ((3, 3), (tasks + 5, tasks), (collocations.GATHERED * tasks + 1, tasks + 1)):
        assert collocations.gathered(spark.range(0, 9, 1, parts)).rdd.getNumPartitions() == gathered


def test_counters_grow_with_the_texts():
    sizes = [collocations.bits_for(n) for n in (0, 168_000_000, 841_000_000, 10**10, 10**13)]
    assert sizes == [24, 24, 25, collocations.MOST_BITS, collocations.MOST_BITS]


def test_portions_end_with_pieces():
    """The same words with as many left to the end of their piece, however small the portions; none is longer than it has to be."""
    texts = ["a b. c d", "", None, "one longer piece than a portion, end", "x" * 40, "no end of a piece in here", ""]
    batch = pa.RecordBatch.from_pylist([{"lang": None, "text": t or ""} for t in texts])
    seen = {}
    for most in (1, 4, 10, 1000):
        parts = [p for p, _, _ in collocations.portions(batch, most)]
        seen[most] = [(bytes(p.data[a:b]), int(n), int(r)) for p in parts for a, b, n, r in zip(p.starts, p.ends, p.left, p.row, strict=True)]
        if most < 1000:
            assert all(len(p.data) <= most or not (p.data[:-1] == 10).any() for p in parts)
    assert len({tuple(x) for x in seen.values()}) == 1 and len(seen[1]) == 19
