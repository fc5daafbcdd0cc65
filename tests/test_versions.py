"""Renames against all pairs, and blame against following each line by hand."""

import itertools
import random

import numpy as np
import pytest

from cryptolode.operators import versions


def test_the_longest_run_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(40), rng.randint(0, 12))
        got = versions.longest_run(values)
        assert all(values[a] < values[b] and a < b for a, b in itertools.pairwise(got))
        best = [1] * len(values)
        for i, j in itertools.combinations(range(len(values)), 2):
            if values[i] < values[j]:
                best[j] = max(best[j], best[i] + 1)
        assert len(got) == max(best, default=0)


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(out))
        kind = rng.choice(["insert", "delete", "move", "repeat"])
        if kind == "insert":
            out[at:at] = [rng.choice([rng.randrange(1000), 7, 8]) for _ in range(rng.randint(1, 3))]
        elif kind == "delete":
            del out[at : at + rng.randint(1, 3)]
        elif kind == "move" and out:
            out.insert(rng.randint(0, len(out) - 1), out.pop(rng.randrange(len(out))))
        else:
            out[at:at] = out[at : at + 2]
    return out


def test_matches_keep_order_and_leave_no_equal_neighbours():
    rng = random.Random(2)
    for _ in range(300):
        old = [rng.choice([rng.randrange(1000), 7, 8]) for _ in range(rng.randint(0, 15))]
        new = edited(rng, old)
        got = versions.matched(np.array(old, np.int64), np.array(new, np.int64)).tolist()
        pairs = [(n, o) for n, o in enumerate(got) if o >= 0]
        assert all(a[1] < b[1] for a, b in itertools.pairwise(pairs)) and all(new[n] == old[o] for n, o in pairs)
        anchors = [x for x in new if new.count(x) == 1 and old.count(x) == 1]
        assert len({new[n] for n, _ in pairs} & set(anchors)) >= len(versions.longest_run([old.index(x) for x in anchors]))
        # what stands next to a match on both sides, unmatched, is not equal
        used = {o for _, o in pairs}
        for n, o in [(-1, -1), *pairs, (len(new), len(old))]:
            for step in (1, -1):
                a, b = n + step, o + step
                if 0 <= a < len(new) and 0 <= b < len(old) and got[a] < 0 and b not in used:
                    assert new[a] != old[b]
    same = np.arange(5)
    assert versions.matched(same, same).tolist() == [0, 1, 2, 3, 4] and versions.matched(same[:0], same).tolist() == [-1] * 5


def followed(history):
    """(author, commit) of each line of the last version, from version to version."""
    owners = []
    for i, (author, commit, lines) in enumerate(history):
        was = versions.matched(np.array(history[i - 1][2], np.int64), np.array(lines, np.int64)) if i else [-1] * len(lines)
        owners = [owners[o] if o >= 0 else (author, commit) for o in was]
    return owners


def test_blame_follows_lines_through_versions(spark):
    rng = random.Random(3)
    rows, want = [], []
    for f in range(4):
        lines, history = [rng.randrange(1000) for _ in range(12)], []
        for v in range([1, 2, 9, 17][f]):
            history.append((f"a{v % 3}", f"c{f}-{v}", lines))
            rows.append((f"f{f}", 10 + 2 * v, f"a{v % 3}", f"c{f}-{v}", "\n".join(map(str, lines)) + ("\n" if v % 2 else "")))
            lines = edited(rng, lines)
        want += [(f"f{f}", n, *owner) for n, owner in enumerate(followed(history), 1)]
    rows += [("empty", 1, "a", "c", None), ("gone", 1, "a", "c1", "x\ny"), ("gone", 2, "b", "c2", "")]
    df = spark.createDataFrame(rows, "path string, version int, author string, commit string, text string").repartition(3)
    assert sorted(tuple(r) for r in versions.blame(df).collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_renames_against_all_pairs(spark, threshold):
    rng = random.Random(4)
    base = [[f"line {rng.randrange(60)}" for _ in range(rng.randint(1, 14))] for _ in range(12)]
    removed = [(f"a/{i}", "\n".join(x)) for i, x in enumerate(base)] + [("a/copy", "\n".join(base[0])), ("a/empty", ""), ("a/blank", " \n\n"), ("a/null", None)]
    added = [(f"b/{i}", "\n".join([*x[: rng.randint(0, len(x))], *(f"new {rng.randrange(9)}" for _ in range(rng.randint(0, 3)))])) for i, x in enumerate(base)]
    added += [("b/same", "\n".join(base[0]) + "  \n"), ("b/again", "\n".join(reversed(base[0]))), ("b/blank", "\n \n"), ("b/null", None)]
    sets = lambda rows: {p: {x.rstrip(" ") for x in (t or "").split("\n")} - {""} for p, t in rows}
    old, want = sets(removed), {}
    for p, own in sets(added).items():
        close = [(-len(own & s) / len(own | s), q) for q, s in old.items() if own and s and len(own & s) / len(own | s) >= threshold]
        if close:
            want[p] = (min(close)[1], round(-min(close)[0], 9))
    df = [spark.createDataFrame(x, "path string, text string") for x in (removed, added)]
    assert {r.path: (r.source, round(r.similarity, 9)) for r in versions.renamed(*df, threshold).collect()} == want and want


def test_renames_move_no_pairs_of_sets(spark, monkeypatch):
    """Many files that share some of their lines: in small blocks and portions as in one, and no plan joins sets to pairs."""
    rng = random.Random(6)
    removed = [(f"a/{i}", "\n".join(str(rng.randrange(40)) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    added = [(f"b/{i}", "\n".join(str(rng.randrange(40)) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    sets = lambda rows: {p: set(t.split("\n")) for p, t in rows}
    want = {}
    for p, own in sets(added).items():
        alike, q = min((-len(own & s) / len(own | s), q) for q, s in sets(removed).items())
        if alike <= -0.5:
            want[p] = (q, round(-alike, 9))
    df = [spark.createDataFrame(x, "path string, text string") for x in (removed, added)]
    for block, pairs in ((6_000_000, 1_000_000), (150, 7)):
        monkeypatch.setattr(versions, "PAIRS", pairs)
        found = versions.renamed(*df, block=block)
        assert {r.path: (r.source, round(r.similarity, 9)) for r in found.collect()} == want and len(want) > 20
        assert "array_intersect" not in found._jdf.queryExecution().toString()


def test_snapshots(spark):
    text = "\n".join(f"line {i}" for i in range(10))
    before = [("keep", text), ("edit", text + "!"), ("old", text + "\nmine"), ("lost", "nothing like it")]
    after = [("keep", text), ("edit", text + "?"), ("new", text + "\nmine\nmore"), ("fresh", "else")]
    df = [spark.createDataFrame(x, "path string, text string") for x in (before, after)]
    got = {(r.path, r.state, r.source) for r in versions.snapshot_changes(*df).collect()}
    assert got == {("edit", "modified", None), ("new", "renamed", "old"), ("lost", "removed", None), ("fresh", "new", None)}


def test_lines_are_matched_in_arrays():
    import tracemalloc

    old = np.arange(200_000) * 7
    new = np.delete(old, np.arange(0, 200_000, 3))
    tracemalloc.start()
    was = versions.matched(old, new)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (old[was] == new).all() and peak < 200 * len(old)  # bytes a line
