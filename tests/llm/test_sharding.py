"""Sharding along a Hilbert curve: the curve, the law, the slots, the files, and tables with nulls, repeats and clashes."""

import collections
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from cryptolode.llm import sharding
from cryptolode.llm.common import numbered

from .test_corpus_operators import DOCS, corpus


@pytest.fixture(scope="module")
def docs(spark):
    clashes = {"shard": F.lit(-1), "seq": F.lit("clash"), "_x_place": F.lit(0.5), "part": F.lit("clash"), "slot": F.lit(7)}
    return spark.createDataFrame(corpus(), DOCS).withColumns(clashes).repartition(3)


def byte_size(text):
    return len((text or "").encode()) + 16


def test_the_curve_visits_every_cell_and_only_neighbours(spark):
    cells = spark.range(1 << 16).select(*[F.shiftright("id", 4 * i).bitwiseAND(F.lit(15)).cast("int").alias(f"x{i}") for i in range(4)])
    rows = cells.withColumn("place", sharding.hilbert([F.col(f"x{i}") for i in range(4)])).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1 << 16))
    assert all(sum(abs(p - q) for p, q in zip(a[:4], b[:4], strict=True)) == 1 for a, b in itertools.pairwise(rows))


def test_rows_get_their_places_in_a_group(spark):
    rows = [(g, v, s) for g in ("a", "b", None) for v in (5, 5, 1, None, 3) for s in (2, 4)]
    got = numbered(spark.createDataFrame(rows, "g string, v int, s long").repartition(5), ["g", "v"], "t", groups=1, amount="s")
    for g in ("a", "b", None):
        own = sorted((r for r in got.collect() if r.g == g), key=lambda r: r.nth)
        assert [r.nth for r in own] == list(range(10)) and {r.total for r in own} == {10} and {r.amount for r in own} == {30}
        assert [r.v for r in own] == [None, None, 1, 1, 3, 3, 5, 5, 5, 5]
        assert [r.before for r in own] == [sum(x.s for x in own[:i]) for i in range(10)]


@pytest.mark.parametrize("shards", [40, 5])
def test_law_slots_and_digests(docs, shards):
    rows = sharding.shard_report(docs, shards).collect()
    want = sorted((str(r[0]), byte_size(r[1]), zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max(r["size"] for r in rows)
    assert all(abs(sizes[s] - mean) <= largest for s in range(shards))


def test_files_hold_whole_rows_and_are_passed_over(docs, spark, tmp_path):
    files = sharding.Sharding(docs, 8).write(str(tmp_path / "shards"))
    full = files.rows("_s", "_t")
    assert full.columns == [*docs.columns, "_s", "_t"]
    assert sorted(map(str, full.drop("_s", "_t").collect())) == sorted(map(str, docs.collect()))
    for wanted in ({"source": "a"}, {"lang": None}, {"source": "b", "lang": "en"}, {"doc_id": 17}):
        got = files.read(**wanted).collect()
        hit = lambda r: all(r[c] == v for c, v in wanted.items())  # noqa: E731, B023
        assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect() if hit(r))
    assert len(files.shards_with(doc_id=17)) < 8
    bounds = files.manifest.agg(F.sum("rows"), F.sum("bytes")).first()
    assert tuple(bounds) == (len(corpus()), sum(byte_size(r[1]) for r in corpus()))


def test_equal_rows_are_cut_through(spark):
    """Rows that repeat one another fill many shards: all of them stay, and shards stay near equal."""
    rows = [(7, "same text", "en", "a", 9)] * 4000 + [(i, f"other {i}", "fr", "b", 9) for i in range(40)]
    got = sharding.shard_report(spark.createDataFrame(rows, DOCS).repartition(4), 8).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 4040 and len(counts) == 8 and max(counts.values()) < 1.3 * 505
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_wide_ids_one_row_and_an_empty_table(spark):
    assert sharding.shard_report(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = sharding.shard_report(spark.createDataFrame([(None, None, None, None, None)], DOCS)).collect()
    assert (one["size"], one.text_crc32, one.slot) == (16, 0, 0)
    ends = [(-(2**63), "a", "en", "a", 1), (2**63 - 1, "b", "en", "a", 1), (0, "c", "en", "a", 1)]
    got = {r.doc_id: r.shard for r in sharding.shard_report(spark.createDataFrame(ends, DOCS), 3).collect()}
    assert len(set(got.values())) == 3
