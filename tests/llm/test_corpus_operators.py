"""Corpus operators against brute force on small fixtures that hold nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cryptolode.llm import chat, exact_dedup, langid, minhash_join, mixing, nbsvm, packing, quality, substring, topk, toxicity
from cryptolode.llm.hashing import Words, char_ngrams
from cryptolode.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def corpus():
    rng = np.random.default_rng(1)
    base = [prose(rng, int(n)) for n in rng.integers(3, 400, 40)]
    shared = prose(rng, 80)
    texts = [*base, *base[:5], base[0].upper(), "", None, None, " \t\n", "one two", "one two", "日本語 テスト é", prose(rng, 30000)]
    words = base[7].split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (5, 100) if i < len(words)]
    texts += [*near, "start " + shared + " end", shared, "x " + shared]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "c", "", None][i % 5], i) for i, t in enumerate(texts)]
    return [*rows, (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (3, base[3], "fr", "d", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), DOCS).withColumns({"digest": F.lit("clash"), "keep_id": F.lit(-1), "_x_own": F.lit("clash"), "u": F.lit(0.5), "copies": F.lit(9)})
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- exact dedup


def expected_dedup(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda x: (x is not None, x)):
            first = i == keep and not kept
            kept |= first
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_exact_dedup_report(docs):
    got = [tuple(r) for r in exact_dedup.dedup_report(docs).collect()]
    assert sorted(got, key=str) == sorted(expected_dedup(corpus()), key=str)


def test_exact_dedup_keeps_one_of_each(docs, empty):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in corpus()})
    assert exact_dedup.dedup_report(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_index_outlives_its_object(spark, tmp_path):
    first = spark.createDataFrame([(1, "A"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "B"), (10, "c"), (11, "C")], "doc_id long, text string")
    path = str(tmp_path / "index")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup_report(first, exact_dedup.DigestIndex(spark, path, 4)).collect()} == {(1, 3, False), (2, 2, True), (3, 3, True)}
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup_report(second, again).collect()} == {(9, 2, False), (10, 11, False), (11, 11, True)}
    assert again.rows().count() == 3
    again.drop()


def test_a_batch_that_is_added_again_keeps_the_same_rows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 2)
    docs = spark.createDataFrame([(1, "A"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    once = sorted(map(tuple, exact_dedup.dedup_report(docs, index, "monday").collect()))
    assert sorted(map(tuple, exact_dedup.dedup_report(docs, index, "monday").collect())) == once
    assert index.rows().count() == 3
    assert {r.kept for r in exact_dedup.dedup_report(docs, index, "tuesday").collect()} == {False}


def test_later_batches_meet_a_filled_index(docs, monkeypatch):
    met, add = [], exact_dedup.DigestIndex.add
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", lambda self, groups, batch: met.append((groups.count(), self.rows().count(), add(self, groups, batch))) or met[-1][2])
    exact_dedup.dedup_report(docs).collect()
    (first, before, new), (second, filled, newer) = met
    assert before == 0 and new.count() == first == filled and newer.count() < second


# --- packing


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    packed = packing.pack_documents(docs, tokenizer_path(), with_ids=True)
    rows = packed.collect()
    coder = Tokenizer.from_file(tokenizer_path())
    wanted = collections.Counter((r[0], tuple(coder.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in corpus())
    pieces = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id][r.piece].append(r)
    single = {d: p for d, p in pieces.items() if all(len(x) == 1 for x in p.values())}
    for d, p in single.items():
        ids = [i for n in sorted(p) for i in p[n][0].ids]
        assert wanted[(d, tuple(ids))] == 1
        assert [p[n][0].start for n in sorted(p)] == [sum(p[m][0].length for m in range(n)) for n in sorted(p)]
        assert all(p[n][0].length == 1024 for n in sorted(p)[1:])
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
    total = sum(r.length for r in rows)
    assert len(at) <= 1.02 * -(-total // 1024) + 1
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == total and len(whole) == len(at)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_added_token_in_a_text(spark):
    from tokenizers import Tokenizer

    text = "a<|endoftext|> b  \n\n c's"
    row = packing.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path(), with_ids=True).first()
    assert list(row.ids) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids + [2]


def best_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted(counts.elements(), reverse=True):
        fitting = [i for i, g in enumerate(gaps) if g >= x]
        if fitting:
            gaps[min(fitting, key=gaps.__getitem__)] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_best_two_fit_uses_everything_once():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = collections.Counter(rng.integers(1, 101, 500).tolist())
        patterns = packing.best_two_fit(counts, 100)
        used = collections.Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= 100 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in patterns) <= 1.01 * best_fit_decreasing(counts, 100) + 1


def test_best_two_fit_replaces_the_smallest():
    # greedy fills 6 + 3; the pair 2 + 2 fills the gap that 3 leaves more tightly
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_a_group_of_one_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(300).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    rows = packing.pack(pieces).collect()
    assert collections.Counter(collections.Counter(r.sequence_id for r in rows).values()) == {3: 166, 2: 1}
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500


# --- mixing


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        per = rest / sum(weight[s] for s in order if s not in capped) if len(capped) < len(order) else 0
        over = {s for s in order if s not in capped and per * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else per * weight[s] for s in order}
        capped |= over


def test_mixing_targets_and_takes(docs, empty):
    rows = mixing.mix_report(docs).collect()
    sizes = collections.defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    wanted = expected_targets(dict(sizes))
    assert len(rows) == len(corpus()) and mixing.mix_report(docs).exceptAll(mixing.mix_report(docs)).isEmpty()
    by_size = collections.defaultdict(list)
    for r in rows:
        assert r.size == 0 or r.taken <= 3 * r.size and r.taken % r.size == 0
        by_size[r.source_size, round(r.target, 6)].append(r)
    for s, size in sizes.items():
        taken = sum(r.taken for r in by_size[size, round(wanted[s], 6)])
        # whole documents: off by less than the longest document of the source
        assert abs(taken - wanted[s]) <= max(r.size for r in by_size[size, round(wanted[s], 6)])
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_rows_agree_with_the_report(docs):
    plan = mixing.Mix(docs, levels=2)
    out = plan.shards()
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text, r.source) for r in out.collect())
    text = {(r[0], r[3]): r[1] for r in corpus()}
    wanted = collections.Counter()
    for r in plan.chosen().collect():
        wanted[(r.doc_id, text[r.doc_id, r.source], r.source)] += r.copies
    assert got == +wanted


def test_the_report_counts_the_rows_of_a_stored_mix(docs, monkeypatch):
    stored, store = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: stored.setdefault(name, store(df, name)))
    trees, tree = [], mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: trees.append(a) or tree(*a))
    rows = mixing.mix_report(docs).collect()
    assert len(trees) == 1 and "mixed" in stored
    mixed = stored["mixed"].select(*docs.columns, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("size")).collect()
    got, wanted = collections.Counter(), collections.Counter(r.doc_id for r in mixed if r.size)
    for r in rows:
        if r.size:
            got[r.doc_id] += r.taken // r.size
    assert +got == wanted and sum(wanted.values()) > 0
    # what isn't dealt isn't reported
    monkeypatch.setattr(mixing, "materialize", lambda df, name: store(df.limit(0) if name == "mixed" else df, name))
    none = mixing.mix_report(docs).collect()
    assert len(none) == len(corpus()) and sum(r.taken for r in none) == 0


@pytest.mark.parametrize(("fan", "most"), [(2, 1), (3, 10**6)])
def test_edges_are_found_by_descending(spark, monkeypatch, fan, most):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 60).cast("int")).alias("text"), F.when(F.col("id") % 3 < 2, "hot").otherwise("rare").alias("source"))
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    wanted = collections.Counter(map(tuple, mixing.Mix(rows).chosen().collect()))
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
    plan = mixing.Mix(rows, levels=5)
    assert collections.Counter(map(tuple, plan.chosen().collect())) == wanted
    assert collections.Counter(map(tuple, plan.counted(plan.shards("draw").select("draw.*")).collect())) == wanted


def test_the_report_shares_what_is_dealt_among_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "c", None)] * 3 + [(2, "d", "t")], "doc_id long, text string, source string")
    plan = mixing.Mix(rows)
    by_row = lambda df: collections.Counter(map(tuple, df.select("doc_id", "source", "size", "copies").collect()))
    assert by_row(plan.counted(plan.shards("draw").select("draw.*"))) == by_row(plan.chosen())


def test_mixing_comes_near_targets_with_many_documents(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 60).cast("int")).alias("text"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    totals = mixing.mix_report(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 1 for r in totals)


def test_splitting_tree_keeps_quotas_and_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 300), (2, 1), (3, 0)], "rank int, blocks long")
    rows = sorted((r["rank"], r.shard, r.begin, r.end) for r in mixing.shard_quotas(quotas, 3, 5).collect())
    ends = {k: [r[3] for r in rows if r[0] == k] for k in range(4)}
    assert all(r[2] == (rows[i - 1][3] if r[1] else 0) for i, r in enumerate(rows))
    assert {k: v[-1] for k, v in ends.items()} == {0: 1000, 1: 300, 2: 1, 3: 0}
    totals = [sum(v[i] - (v[i - 1] if i else 0) for v in ends.values()) for i in range(8)]
    assert max(totals) - min(totals) <= 1
    n, k, m, draws = 50, 20, 30, 4000
    u = spark.range(draws).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(m), mixing.uniform(F.lit(3), F.col("id"))).alias("x"))
    x = np.array([r.x for r in u.collect()])
    assert x.min() >= 0 and x.max() <= 20 and abs(x.mean() - 12) < 0.15 and abs(x.var() - m * k / n * (1 - k / n) * (n - m) / (n - 1)) < 0.3


# --- substring dedup


def expected_removal(rows, k):
    words = [WORD.findall(r[1] or "") for r in rows]
    counts = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if counts[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 3])
def test_substring_dedup(docs, empty, window, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_CHARS", 20_000)
    monkeypatch.setattr(substring, "SLICE_WINDOWS", 3_000)
    got = sorted(map(tuple, substring.remove_repeats(docs, window).collect()), key=str)
    assert got == sorted(expected_removal(corpus(), window), key=str)
    assert substring.remove_repeats(empty, window).count() == 0


def test_repeats_inside_a_document(spark):
    rows = [(1, "a b " * 50, "", "", 0), (2, "q " + "z " * 36, "", "", 0), (3, " ".join(map(str, range(40))), "", "", 0)]
    got = sorted(map(tuple, substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == sorted(expected_removal(rows, 35))


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    texts = [prose(rng, 500, 50) for _ in range(6)]
    chunk = substring.Chunk(texts, 3, 2)
    counts = collections.Counter(chunk.first.tolist())
    for row in range(substring.ROWS):
        cells = chunk.cells(row)
        many = cells.spread(cells.counts > 1)
        assert all(m for m, h in zip(many, chunk.first.tolist(), strict=True) if counts[h] > 1)


# --- n-gram Jaccard join


def expected_classes(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], least[find(i)], links[i]) for i in range(len(rows))], len(members)


def near_rows():
    rng = np.random.default_rng(9)
    rows = corpus()
    base = prose(rng, 120).split()
    for i in range(60):
        words = list(base)
        for j in rng.choice(120, i % 6, replace=False):
            words[j] = f"n{i}_{j}"
        rows.append((1000 + i, " ".join(words), "en", "z", 0))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_join(spark, empty, block, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS)
    wanted, n_classes = expected_classes(rows)
    joined = minhash_join.JaccardJoin(docs)
    assert sorted(map(tuple, joined.report().collect()), key=str) == sorted(wanted, key=str)
    kept = joined.kept()
    assert kept.columns == docs.columns and kept.count() == n_classes
    if block == 16:
        assert minhash_join.join(empty).count() == 0 and minhash_join.keep_one(empty).count() == 0


def test_long_runs_are_compared_in_blocks():
    """Blocks two by two, passing over what is in one component, give the components of all pairs."""
    rng = np.random.default_rng(5)
    for drift in (3, 9, 60):
        values = [rng.integers(0, 16, minhash_join.TREES * minhash_join.DEPTH)]
        for i in range(120):  # each a change of an earlier one, so that components are chains and hubs
            new = values[rng.integers(0, len(values))].copy() if i % 7 else rng.integers(0, 16, len(values[0]))
            new[rng.choice(len(new), drift % 40, replace=False)] = rng.integers(0, 16, drift % 40)
            values.append(new)
        low = np.array(values, np.uint8)
        nibbles = low[:, ::2] << 4 | low[:, 1::2]
        wanted = minhash_join.components(minhash_join.likeness(nibbles) >= minhash_join.LIKELY)
        for block in (5, 16, 500):
            assert (minhash_join.run_components(nibbles, block) == wanted).all()


def test_recall_decides_the_depth():
    depth = minhash_join.stop_depth()
    assert minhash_join.recall(depth) >= minhash_join.RECALL > minhash_join.recall(depth + 1)
    assert minhash_join.stop_depth([]) == minhash_join.stop_depth([0.97, 1.0]) == minhash_join.DEPTH > minhash_join.stop_depth([0.82, 0.97]) > minhash_join.stop_depth([0.8, 0.97])


@pytest.mark.parametrize(("changes", "deepest"), [((1,), True), ((1, 8), False)])
def test_the_forest_adapts_to_the_corpus(spark, changes, deepest):
    """Copies with one changed word of 400 stop the forest at full depth; some with changes all over, near the threshold,
    let it go on; a hot group of close copies does not hide those. All links are found in both."""
    rng = np.random.default_rng(31)
    base = [prose(rng, 400).split() for _ in range(30)]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(base)]
    for i, w in enumerate([*base, *[base[0]] * 60]):
        own = list(w)
        for j in np.linspace(3, 390, changes[i % len(changes)]).astype(int):
            own[j] = f"n{i}_{j}"
        rows.append((100 + i, " ".join(own), "en", "b", 0))
    wanted, _ = expected_classes(rows)
    joined = minhash_join.JaccardJoin(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, joined.report().collect()), key=str) == sorted(wanted, key=str)
    assert (joined.depth == minhash_join.DEPTH) == deepest
    assert all(r >= minhash_join.RECALL for r in joined.report_recall().values()) and joined.bands


def test_no_sample_decides_what_is_found(spark, monkeypatch):
    """A pair at the threshold that no tree's full prefix brings together is found, though the sample doesn't show it."""
    rng = np.random.default_rng(37)
    trees, depth = minhash_join.TREES, minhash_join.DEPTH
    for n in range(20):
        left = [[f"w{n}_{k}_{x}" for x in rng.integers(0, 9999, 49)] for k in range(200)]
        right = [[*x[:20], "other", *x[21:]] for x in left]
        both = [minhash_join.signatures(minhash_join.shingles([" ".join(x) for x in side])).reshape(-1, trees, depth) for side in (left, right)]
        meet = lambda d: (both[0][:, :, :d] == both[1][:, :, :d]).all(axis=2).any(axis=1)
        far = np.flatnonzero(~meet(depth) & meet(minhash_join.stop_depth()))
        if len(far):
            break
    base = [prose(rng, 400).split() for _ in range(20)]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(base)] + [(50 + i, " ".join([*w[:-1], "end"]), "en", "a", 0) for i, w in enumerate(base)]
    rows += [(100, " ".join(left[far[0]]), "en", "a", 0), (101, " ".join(right[far[0]]), "en", "a", 0)]
    wanted, _ = expected_classes(rows)
    monkeypatch.setattr(minhash_join, "SAMPLE", 1)
    got = list(map(tuple, minhash_join.join(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))
    assert (101, 100, 1) in got and sorted(got, key=str) == sorted(wanted, key=str)


def test_contracted_links_keep_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    first, others = minhash_join.contract(a, b)
    root = {int(x): int(r) for r, x in zip(first, others, strict=True)}
    assert all(root.get(int(x), int(x)) == root.get(int(y), int(y)) for x, y in zip(a, b, strict=True))
    assert all(r < x for x, r in root.items()) and not set(root) & set(root.values())


def test_a_hot_group_does_not_stop_the_forest(spark):
    rng = np.random.default_rng(12)
    trees, depth = minhash_join.TREES, minhash_join.DEPTH
    first = rng.integers(0, 2**16, trees * depth)
    second = first.copy()
    # alike in 4 of 5 values, but no tree's prefix of 4 agrees, and one tree's prefix of 3
    second[[3, *range(depth, trees * depth, depth)]] ^= 1
    hot = rng.integers(0, 2**16, trees * depth)
    rows = []
    for nid, values in enumerate([first, second] + [hot] * 60):
        low = (values & 15).astype(np.uint8)
        rows.append((nid, bytearray(values.astype(">u2").tobytes()), bytearray((low[::2] << 4 | low[1::2]).tobytes())))
    nodes = spark.createDataFrame(rows, "nid long, signature binary, nibbles binary").repartition(3)
    links = {tuple(r) for r in minhash_join.forest_links(nodes).collect()}
    assert (0, 1) in links and {b for a, b in links if a == 2} == set(range(3, 62))


def thue_morse():
    """Two words of 1024 letters that agree under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, other = thue_morse()
    rest = " ".join(f"r{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"a b c d {one}"), (4, f"a b c d {other}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    short = docs.where("doc_id > 2")
    assert {(r.doc_id, r.class_id, r.n_links) for r in minhash_join.join(short).collect()} == {(3, 3, 0), (4, 4, 0)}


# --- top-k search


def test_topk_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), (centres[i % 6] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(90)]  # ties and a hot vector
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, []), (None, [0.0] * 16), (950, [1.0, 2.0]), (951, [2.0, 1.0]), (1000, [float("inf")] * 16), (1050, [1e18] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, qv in good:
        if q % 50:
            continue
        scores = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v, strict=True)))), i) for i, v in good if i != q and len(v) == len(qv)))[:5]
        if q != 1050:  # beyond 64 bits everything ties
            assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)], q
    assert set(got) == {q for q, v in good if q % 50 == 0}
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cover_tree_covers(monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(500, 8))
    tree = topk.CoverTree(points, np.arange(500))
    todo, seen = [tree], 0
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.index] - node.centre, axis=1).max() <= node.radius + 1e-9
        assert (points[node.index] == node.centre).all(axis=1).any()
        if node.children:
            centres = np.array([c.centre for c in node.children])
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.diag(np.full(len(centres), np.inf))
            assert np.nanmin(apart) >= node.radius / topk.BASE - 1e-9 and (centres == node.centre).all(axis=1).any()
            assert max(c.radius for c in node.children) <= node.radius / topk.BASE + 1e-9
            assert sorted(np.concatenate([c.index for c in node.children])) == sorted(node.index)
        else:
            seen += len(node.index)
        todo += node.children
    assert seen == 500


# --- classifiers


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = prose(rng, 60, 300).split()
        if bad:
            words[int(rng.integers(0, 60))] = "awful" + str(rng.integers(0, 3))
            words[int(rng.integers(0, 60))] = "### |"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not bad), int(bad)))
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0), (None, "awful0 awful1", "", "", 0), (5002, prose(rng, 50000), "", "", 0)]
    labels += [(3, 1, 0), (99999, 1, 1), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_held_out_rows(spark, module):
    docs, labels = labelled(spark)
    score = quality.quality if module is quality else toxicity.toxicity
    model = module.train(docs, labels, lambda c: F.col(c) % 4 != 1)
    rows = score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 1]
    right = sum(r.predicted == (int(r.doc_id % 3 != 0) if module is quality else int(r.doc_id % 3 == 0)) for r in held)
    assert right >= 0.95 * len(held)
    again = module.train(docs.repartition(5), labels.repartition(3), lambda c: F.col(c) % 4 != 1)
    assert np.array_equal(model, again)


def test_classifier_without_labels(spark):
    docs, labels = labelled(spark, 40)
    model = toxicity.train(docs, labels.limit(0), lambda c: F.lit(True))
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, model).collect()} == {0.5}
    assert toxicity.drop_toxic(docs.limit(0), model).columns == docs.columns


def test_indicators_are_distinct():
    find = nbsvm.Indicators(toxicity.SETTINGS)
    text = "abcabcabc abc"
    (_, orders), bits = toxicity.SETTINGS.kinds[0], toxicity.SETTINGS.bits
    assert sorted(find(text)) == sorted(set(char_ngrams(text, orders, bits).tolist())) and len(find(text)) > 10
    assert len(find(None)) == 0


def test_ratios_by_counting():
    s = nbsvm.Settings(kinds=(("word", (1,)),), bits=12, least_count=2)
    texts, y = ["a b", "a c", "a d", "b c", "c a"], np.array([1.0, 1.0, -1.0, -1.0, 1.0])
    find = nbsvm.Indicators(s)
    rows = [find(t) for t in texts]
    got = nbsvm.log_count_ratios(rows, y, s)
    total = {v: (1 << s.bits) + sum(len(t.split()) for t, x in zip(texts, y, strict=True) if x == v) for v in (1, -1)}
    for word in "abcd":
        n = {v: 1 + sum(word in t.split() for t, x in zip(texts, y, strict=True) if x == v) for v in (1, -1)}
        wanted = np.log((n[1] / total[1]) / (n[-1] / total[-1])) if sum(n.values()) >= 4 else 0
        assert got[find(word)[0]] == pytest.approx(wanted, abs=1e-6)


def test_dual_coordinate_descent_against_a_plain_solver():
    rng = np.random.default_rng(4)
    s = nbsvm.Settings(kinds=(("word", (1,)),), bits=6, cost=0.3, epochs=400)
    rows = [np.unique(rng.integers(0, 64, 12)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.3, 1.0, -1.0)
    ratios = rng.normal(size=64).astype(np.float32)
    w, bias = nbsvm.dual_coordinate_descent(rows, y, ratios, s)
    x = np.zeros((60, 65))
    for i, index in enumerate(rows):
        x[i, index] = ratios[index]
    x[:, 64] = 1  # the bias
    share = (y > 0).mean()
    most = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * s.cost
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):  # projected gradient on the same dual
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    best = x.T @ (alpha * y)
    primal = lambda v: 0.5 * v @ v + (most * np.maximum(0, 1 - y * (x @ v))).sum()
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    own = np.append(np.where(ratios != 0, w / ratios, 0), bias)
    assert primal(own) == pytest.approx(dual, rel=1e-3) and primal(best) == pytest.approx(dual, rel=1e-3)
    assert np.allclose(x @ own, x @ best, atol=1e-2)


# --- languages


def test_language_identification(spark):
    rng = np.random.default_rng(10)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "äöüéè"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join("".join(rng.choice(list(letters[lang]), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(1, 60))))
        rows.append((i, text, lang if i % 7 else None, "s", 0))
    rows += [(900, None, "aa", "", 0), (901, "123 !?", "aa", "", 0), (902, "", "bb", "", 0), (903, "ab " * 30000, None, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    settings = langid.Settings(steps=120, per_lang=60, batch=96)
    model = langid.fit(docs, lambda c: F.col(c) % 5 != 0, settings)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, s=settings).collect()}
    held = [r[0] for r in rows[:240] if r[0] % 5 == 0]
    assert sum(got[i][0] == ["aa", "bb", "cc"][i % 3] for i in held) >= 0.95 * len(held)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "aa"
    none = langid.fit(docs.limit(0), lambda c: F.lit(True), settings)
    assert {r.lang_pred for r in langid.identify(docs, none, s=settings).collect()} == {"und"}


def test_gradients_match_differences():
    s = langid.Settings(hidden=3, length=6)
    net = langid.Network.new(2, s)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, used, y = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([6, 6, 3, 1]), np.array([0, 1, 1, 0])

    def loss():
        total = 0.0
        for t, (f, b) in enumerate(zip(net.run(x, "f"), net.run(x, "b"), strict=True)):
            p = net.chances(f, b)
            total -= (np.log(p[y, np.arange(4)]) * (used > t)).sum()
        return total / used.sum()

    grads = net.gradients(x, used, y)
    for k, at in (("in_f", (2, 98)), ("in_b", (7, 97)), ("rec_f", (0, 1)), ("rec_b", (8, 2)), ("bias_f", (1, 0)), ("out_b", (1, 2)), ("out_bias", (0, 0))):
        keep, h = net.w[k][at], 1e-4
        net.w[k][at] = keep + h
        up = loss()
        net.w[k][at] = keep - h
        down = loss()
        net.w[k][at] = keep
        assert grads[k][at] == pytest.approx((up - down) / (2 * h), abs=2e-4)


# --- chat


def test_chat_round_trip(spark, monkeypatch):
    probe = r"\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", probe), (1, 1, "assistant", probe), (1, 1, "assistant", ""), (1, 3, "assistant", "\n<turn>user\n\\\\n</turn>\n"), (2, 0, None, None), (2, None, "us\ner", " lead\n\n trail \n"),
        (3, 5, "assistant", "日本語 é " * 50), (3, 2, "system", "x"), (None, 0, "assistant", "no conversation"), (4, 0, "assistant", "<|endoftext|>"), (5, 0, "assistant", "long " * 30000), (5, 1, "user", "<turn>assistant"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    for segment in (4_000_000, 10):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        out = chat.format_conversations(df, tokenizer_path())
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(out).collect()} == want
    assert chat.read_back(chat.format_conversations(df.limit(0), tokenizer_path())).count() == 0


def test_encoding_with_offsets_is_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    for text in ("", "hello world\n\n  x", "日本語é 🙂 <|endoftext|> ''s", "<turn>user\n a\t\n</turn>\n" * 3):
        ids, starts, ends = chat.encode(tokenizer_path(), text)
        wanted = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == wanted.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == wanted.offsets


def test_segments_encode_like_the_whole():
    turns = [("user", "hello \n\n"), ("assistant", " x\t"), ("user", "")]
    parts = [chat.render([t])[0] for t in turns]
    assert chat.encode(tokenizer_path(), chat.render(turns)[0])[0].tolist() == [i for p in parts for i in chat.encode(tokenizer_path(), p)[0].tolist()]


def test_masks_by_binary_search():
    starts, ends = np.array([0, 2, 4, 7]), np.array([2, 4, 7, 9])
    assert chat.masked(starts, ends, [(3, 5)]).tolist() == [False, True, True, False]
    assert chat.masked(starts, ends, [(2, 2), (7, 8)]).tolist() == [False, False, False, True]


def test_words():
    words = Words(["a bb\tccc", "", None, "é  x y"])
    assert np.diff(words.first).tolist() == [3, 0, 0, 2]
    assert len(Words(["x " * 5]).windows(6)[0]) == 0 and len(words.windows(3)[0]) == 1


def test_scratch_is_dropped(spark):
    from pathlib import Path

    from cryptolode.llm import common

    common.drop_scratch(spark)
    stored = common.materialize(spark.range(3), "numbers")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in stored.inputFiles()}
    assert stored.count() == 3 and Path(folder.replace("//", "/")).is_dir()
    assert common.drop_scratch(spark) == 1 and not Path(folder.replace("//", "/")).exists()


def test_stored_conversations_read_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 20)
    rows = spark.createDataFrame([(i, t, "user" if t % 2 else "assistant", f"text {i} {t} " * 5) for i in range(6) for t in range(4)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows, tokenizer_path())
    stored = formatted.orderBy(F.col("segment").desc(), "conv_id").cache()
    assert sorted(map(tuple, chat.read_back(stored, in_order=False).collect())) == sorted(map(tuple, chat.read_back(formatted).collect()))


def test_letters():
    assert langid.has_letter("1é") and langid.has_letter("a") and not langid.has_letter("1²_ -")
