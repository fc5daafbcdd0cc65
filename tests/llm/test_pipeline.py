"""The pipeline's stages on small tables, and the queries with SQL against DuckDB."""

import collections
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cryptolode.llm import exact_dedup, minhash_join, mixing, toxicity
from cryptolode.llm.common import held_out
from cryptolode.llm.hashing import char_ngrams
from cryptolode.llm.oracles import ORACLES
from cryptolode.llm.queries import QUERIES, tokenizer_path

from .test_corpus_operators import WORD, expected_classes, expected_targets, lowered

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got) == sorted(want)
    # nulls, which each engine's frames have in their own way, as None; they have no order, so rows are sorted by their text
    plain = lambda df: sorted(([None if pd.isna(v) else v for v in row] for row in df[sorted(got)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    toxic, dedup, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = toxic(spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), lambda c: ~held_out(c, 4, 2))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.toxicity(docs, model).where("predicted = 0").collect()}
    once = dedup(spark, kept, SF).cache()
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in exact_dedup.dedup_report(kept).where("kept").collect()}
    single = near(spark, once, SF).cache()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash_join.join(once).where(F.col("doc_id") == F.col("class_id")).collect()}
    mixed = mix(spark, single, SF).cache()
    wanted = {r.doc_id: r.copies for r in mixing.Mix(single).chosen().where("copies > 0").collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(wanted)
    for df in (kept, once, single, mixed):
        assert df.columns == docs.columns
    packed = pack(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == set(wanted)


def test_near_copies_are_found_without_a_sample(spark, monkeypatch):
    """How long prefixes are follows from the threshold; the stage draws no sample of its input and collects no bands."""

    def drawn(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(minhash_join, "probe", drawn)
    monkeypatch.setattr(minhash_join.JaccardJoin, "bands", property(drawn), raising=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(10**6 + i, f"{r[1]} end", *r[2:]) for i, r in enumerate(rows[:40])]
    wanted, _ = expected_classes(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, first, _ in wanted if i == first)
    assert minhash_join.recall(minhash_join.stop_depth()) >= minhash_join.RECALL


def test_run_against_brute_force(spark):
    """The whole pipeline on tables with toxic documents, and again in plain Python from the same model."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{LARGER}/labels.parquet"), lambda c: ~held_out(c, 4, 2)).astype(float)
    (_, orders), bits = toxicity.SETTINGS.kinds[0], toxicity.SETTINGS.bits

    def toxic(text):
        margin = sum(model[i] for i in set(char_ngrams(text or "", orders, bits).tolist())) + model[-3]
        return 1 / (1 + np.exp(-(model[-2] * margin + model[-1]))) >= toxicity.THRESHOLD

    clean = [r for r in rows if not toxic(r[1])]
    last = {}
    for r in sorted(clean, key=lambda r: r[0]):
        last[lowered(r[1])] = r
    once = list(last.values())
    classes, _ = expected_classes(once)
    single = {r[0]: r for r, (_, least, _) in zip(once, classes, strict=True) if r[0] == least}
    assert 0 < len(single) < len(once) < len(clean) < len(rows)
    size = {i: len(WORD.findall(r[1] or "")) for i, r in single.items()}
    sizes = collections.defaultdict(int)
    for i, r in single.items():
        sizes[r[3]] += size[i]
    coder = Tokenizer.from_file(tokenizer_path())
    pieces = collections.defaultdict(collections.Counter)
    spans = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, LARGER).collect():
        pieces[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        spans[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) <= set(single)
    taken = collections.defaultdict(int)
    for i, found in pieces.items():
        ids = coder.encode(single[i][1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        wanted = {(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))}
        (times,) = set(found.values())
        assert set(found) == wanted and 1 <= times <= 3
        taken[single[i][3]] += times * size[i]
    for source, target in expected_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(size[i] for i, r in single.items() if r[3] == source)
    for own in spans.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_stages_on_nulls_repeats_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two three four five six", None, None, 1)], docs.schema)
    for own, most in ((odd, 3), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[1:]:  # the classifier of the first has tests of its own
            own = stage(spark, own, SF)
        assert own.count() <= 3 * most and "sequence_id" in own.columns


def test_run(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)
