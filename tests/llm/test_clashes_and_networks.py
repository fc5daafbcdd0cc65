"""Columns with the operators' own names, stages on odd tables, and the network of language identification byte by byte."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cryptolode.llm import langid, minhash_join, quality, toxicity
from cryptolode.llm.common import held_out

from .test_corpus_operators import DOCS, expected_classes, near_rows, prose

OWN_NAMES = "digest node shingles signature nibbles nid root block set class_id n_links copies lead score predicted held_out lang_pred u seq label toxic quality _x_toxicity".split()


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in OWN_NAMES})


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(21)
    rows = [(i, prose(rng, 30, 300) + (" badword vile" if i % 3 == 0 else " good thing"), ["en", "fr"][i % 2], "s", 1) for i in range(90)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (None, "no id badword", "en", "s", 0), (5, rows[5][1], "fr", "s", 1)]
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_clashing_columns_of_the_join(spark):
    rows = near_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    wanted, n_classes = expected_classes(rows)
    joined = minhash_join.JaccardJoin(docs)
    assert sorted(map(tuple, joined.report().collect()), key=str) == sorted(wanted, key=str)
    kept = joined.kept()
    assert kept.columns == docs.columns and kept.count() == n_classes and {r.node for r in kept.select("node").collect()} == {"clash node"}


def test_clashing_columns_of_the_classifiers(labelled):
    docs, labels = labelled
    for operator, score in ((quality, quality.quality), (toxicity, toxicity.toxicity)):
        model, same = (operator.train(d, labels, lambda c: ~held_out(c, 4, 2)) for d in (docs, clashing(docs)))
        plain, clashed = (sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in score(d, m).collect()) for d, m in ((docs, model), (clashing(docs), same)))
        assert plain == clashed and len(plain) == docs.count() and len({p for _, _, p in plain}) == 2
    kept = toxicity.drop_toxic(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and 0 < kept.count() < docs.count()


def test_clashing_columns_of_language_identification(labelled):
    docs, _ = labelled
    s = langid.Settings(steps=20, per_lang=20, batch=32)
    plain, clashed = (sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in langid.identify(d, langid.fit(d, lambda c: F.lit(True), s), s=s).collect()) for d in (docs, clashing(docs)))
    assert plain == clashed and len(plain) == docs.count()


def by_hand(w, text, length):
    """The network's mean distribution over a text's bytes, a byte at a time."""
    data, n = text.encode(), w["out_f"].shape[1]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(len(w["out_bias"]))
    for at in range(0, len(data), length):
        own = data[at : at + length]
        padded = own + bytes(length - len(own))
        states = {}
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h = np.zeros(n)
            for t in order:
                given, back = w[f"in_{d}"][:, padded[t]], w[f"rec_{d}"] @ h
                reset, update = sigmoid(given[:n] + back[:n]), sigmoid(given[n : 2 * n] + back[n : 2 * n])
                new = np.tanh(given[2 * n :] + reset * (back[2 * n :] + w[f"bias_{d}"][:, 0]))
                h = update * h + (1 - update) * new
                states[d, t] = h
        for t in range(len(own)):
            p = np.exp(w["out_f"] @ states["f", t] + w["out_b"] @ states["b", t] + w["out_bias"][:, 0])
            total += p / p.sum()
    return total / len(data)


def test_labels_against_the_network_by_hand(spark):
    s = langid.Settings(hidden=5, length=7)
    net = langid.Network.new(3, s)
    langs = ["aa", "bb", "cc"]
    texts = ["one", "a much longer text, with é and 日本 in it " * 5, "seven b", "x", "0 1 2", None, "", "ÄÖÜ"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, (langs, net.w), s=s).collect()}
    for i, t in enumerate(texts):
        if not t or not langid.has_letter(t):
            assert got[i] == ("und", 0.0)
        else:
            p = by_hand({k: v.astype(float) for k, v in net.w.items()}, t, 7)
            assert got[i][0] == langs[p.argmax()] and got[i][1] == pytest.approx(p.max(), abs=1e-5)


def test_long_texts_are_learnt_from_to_their_end(spark):
    """What tells two languages apart is only at the end of long texts."""
    rng = np.random.default_rng(3)
    rows = [(i, "zz " * 1500 + " ".join("".join(rng.choice(list(["abc", "xyw"][i % 2]), 5)) for _ in range(1200)), ["aa", "bb"][i % 2], "s", 1) for i in range(8)]
    s = langid.Settings(steps=150, batch=64)
    model = langid.fit(spark.createDataFrame(rows, DOCS), lambda c: F.lit(True), s)
    short = [(100 + i, " ".join("".join(rng.choice(list(["abc", "xyw"][i % 2]), 5)) for _ in range(20)), None, "s", 1) for i in range(20)]
    got = langid.identify(spark.createDataFrame(short, DOCS), model, s=s).collect()
    assert all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in got)


def test_stages_on_nulls_repeats_and_clashes(spark, tmp_path, labelled):
    docs, labels = labelled
    docs = docs.withColumns({"digest": F.lit("clash"), "copies": F.lit(3)})
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    (toxic, dedup, near, mix) = (f for _, f in corpus_pipeline.STAGES[:-1])
    kept = toxic(spark, docs, str(tmp_path))
    model = toxicity.train(docs, labels, lambda c: ~held_out(c, 4, 2))
    scored = collections.Counter(r.doc_id for r in toxicity.toxicity(docs, model).where("predicted = 0").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == scored and kept.columns == docs.columns
    once = dedup(spark, kept, "")
    texts = [(r.text or "").lower() for r in once.collect()]
    assert sorted(texts) == sorted({(r.text or "").lower() for r in kept.collect()}) and once.columns == docs.columns
    single = near(spark, once, "")
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {r.class_id for r in minhash_join.join(once).collect()}
    mixed = mix(spark, single, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    nothing = docs.limit(0)
    for stage in (toxic, dedup, near, mix):
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == docs.columns
