"""What patterns' matches hold, and packs of rules against trying every rule on every line."""

import itertools
import random
import re

import pytest

from cryptolode.functions.literals import Pack, fold, least_width, required
from cryptolode.functions.regex_dialect import to_python
from cryptolode.operators import detect
from cryptolode.plans import bindings
from cryptolode.schema import RULE_SCHEMA

CASES = [
    (r"\bmd5\b", {"md5"}, 3), (r"(?i)MD5|SHA1", {"md5", "sha1"}, 3), (r"(?:md|sha)[-_]?(?:5|1)\(", {"md5(", "md-5(", "md_5(", "md1(", "md-1(", "md_1(", "sha5(", "sha-5(", "sha_5(", "sha1(", "sha-1(", "sha_1("}, 4),
    (r"\w+@\w+", {"@"}, 3), (r"a*|b", None, 0), (r"x(?:foo)+y?", {"xfoo"}, 4), (r"[^a]rsa.*key", {"rsa"}, 7), (r"(?:ab){3}", {"ababab"}, 6), (r"\d{1,3}(?:\.\d{1,3}){3}", None, 7),
    (r"\b(?:md)?", None, 0), (r"", None, 0), (r"0x6a09e667|\x30b", {"0x6a09e667", "0b"}, 2), (r"[[:alpha:]]+z", {"z"}, 2), (r"É+", {"É"}, 1), (r"\pL{3}id", {"id"}, 5), (r"(?i)\pLk", None, 2), (r"a{0,2}bc?d", {"bd", "bcd"}, 2),
]


@pytest.mark.parametrize("pattern, texts, width", CASES)
def test_requirements(pattern, texts, width):
    got = required(pattern)
    if pattern.startswith(r"\d{1,3}"):  # any spelling of the dots between digits will do
        assert got and all("." in t or t.isdigit() for t in got)
    elif pattern.startswith("a{0,2}"):
        assert got and all(t.endswith(("bd", "bcd")) for t in got)
    else:
        assert got == (None if texts is None else frozenset(texts))
    assert least_width(pattern) == width


def random_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "class", "group", "dot", "edge"] if depth < 2 else ["text", "class"])
        atom = {"text": "".join(rng.choice("abAB") for _ in range(rng.randint(1, 3))), "class": rng.choice(["[ab]", "[^a]", "[a-c]", r"\w", r"\d"]), "dot": ".", "edge": r"\b"}.get(kind)
        if kind == "group":
            atom = "(?:" + "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 3))) + ")"
        # repetitions of repetitions take Python's matcher exponential time
        quantifier = "" if kind in ("text", "edge") else rng.choice(["", "", "?", "{2}", "{1,2}"] if kind == "group" else ["", "?", "*", "+", "{2}", "{1,2}", "{0,1}", "{2,}"])
        parts.append(atom + quantifier)
    return "".join(parts)


def test_every_match_holds_what_is_required():
    rng = random.Random(8)
    tried = 0
    for _ in range(800):
        pattern, flags = random_pattern(rng), rng.choice(["", "i"])
        texts, width = required(pattern, flags), least_width(pattern)
        line = "".join(rng.choice("abAB c1") for _ in range(14))
        for m in to_python(pattern, flags).finditer(line):
            assert len(m[0]) >= width
            # what is required stands in the match itself, since look-arounds beyond it aren't allowed
            assert texts is None or any(t in fold(m[0]) for t in texts), (pattern, flags, m[0], texts)
            tried += 1
    assert tried > 400


def test_packs_leave_no_match_out(spark):
    rng = random.Random(9)
    rules = [(random_pattern(rng), rng.choice(["", "i"])) for _ in range(60)] + [("É|é", "i"), ("foo bar|baz", ""), (r"(?i)needle[0-9]", ""), (r"^$", "")]
    texts = ["\n".join("".join(rng.choice("abAB c1é") for _ in range(rng.randint(0, 40))) for _ in range(12)) + rng.choice(["", "\n", "\r\n", "NEEDLE7\r\nx foo bar baz"]) for _ in range(20)] + ["", "\n", "İK needle1\nNeedle2"]
    pack = Pack(rules)
    for text in texts:
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        tried = pack.worth_trying(text, lines)
        for n, rule in enumerate(pack.compiled):
            assert {i for i, line in enumerate(lines) if rule.search(line)} <= set(tried.get(n, [])), (rules[n], text)
    rows = [tuple({"rule_ordinal": n, "rule_id": f"R{n}", "language": "any", "detector_type": "regex", "pattern": p, "flags": f, "file_globs": []}.get(x.name) for x in RULE_SCHEMA.fields) for n, (p, f) in enumerate(rules)]
    files = spark.createDataFrame([(f"f{i}", "go", t) for i, t in enumerate(texts)], "path string, language string, text string")
    got = {(r.path, r.rule_ordinal, r.line_number, r.match_ordinal, r.column) for r in detect.detect_pack(files, spark.createDataFrame(rows, RULE_SCHEMA)).collect()}
    want = set()
    for (i, text), (n, (p, f)) in itertools.product(enumerate(texts), enumerate(rules)):
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        for k, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
            want |= {(f"f{i}", n, k, at, len(line[: m.start()].encode()) + 1) for at, m in enumerate(to_python(p, f).finditer(line))}
    assert got == want


def test_matches_leave_in_portions_and_without_lines_where_none_are_asked_for(spark):
    taken = []

    def rows():
        for k in range(3000):
            taken.append(k)
            yield "f", "go", 0, "R", 1, k + 1, k, "x" * 10_000, ["x" * 10_000]

    first = next(detect.portions(rows(), detect.MATCH_SCHEMA))
    assert len(taken) == first.num_rows == detect.PORTION_CHARACTERS // 20_000
    assert sum(x.num_rows for x in detect.portions(rows(), detect.MATCH_SCHEMA)) == 3000
    pack = [tuple({"rule_ordinal": 0, "rule_id": "R", "language": "any", "detector_type": "regex", "pattern": "a|$", "flags": "", "file_globs": []}.get(x.name) for x in RULE_SCHEMA.fields)]
    files = spark.createDataFrame([("f", "go", "éa\n" + "a é" * 3000), ("g", "go", None), ("h", "go", "")], "path string, language string, text string")
    whole, places = (detect.detect_pack(files, spark.createDataFrame(pack, RULE_SCHEMA), snippets=s) for s in (True, False))
    assert ", ".join(f"{n} {t}" for n, t in places.dtypes) == detect.PLACE_SCHEMA
    got = sorted(tuple(r) for r in places.collect())
    assert got == sorted(tuple(r) for r in whole.select(*places.columns).collect()) and len(got) == 3003
    assert got[-1][5] == 12_001  # bytes, not characters


def test_few_rules_of_a_large_pack_are_tried():
    rules = [(rf"\b{s}[a-z]{{2,}}\b|\b[a-z]{{3,}}{s}\b", "i") for s in bindings.SYLLABLES]
    assert len(rules) == 700
    pack = Pack(rules)
    assert not pack.always and not pack.short
    tried = pack.worth_trying("a balance of words\nnothing here\nBALLAD", ["a balance of words", "nothing here", "BALLAD"])
    assert tried[bindings.SYLLABLES.index("bal")] == [0, 2] and len(tried) < 10
    assert all(re.search("(?i)" + bindings.SYLLABLES[n], "a balance of words nothing here BALLAD") for n in tried)


def test_positions_refuse_patterns_that_can_match_nothing(spark):
    from pyspark.sql import functions as F

    for pattern in (r"\b(?:md)?", "x*", "a|b?"):
        with pytest.raises(ValueError):
            detect.match_columns(F.lit("ab md md5 x"), pattern)


def test_a_rule_may_have_many_examples(spark):
    import time

    from cryptolode.sources import rules

    n = 60_000
    pack = spark.sql(f"SELECT 'R' AS rule_id, 'x[0-9]*7$' AS pattern, '' AS flags, 'regex' AS detector_type, transform(sequence(1, {n}), k -> concat('x', k)) AS examples_match, array('x7', 'x7', 'y', 'x1') AS examples_no_match")
    began = time.time()
    wrong = [(r.example, r.expected) for r in rules.self_test(pack).collect()]
    assert time.time() - began < 60  # comparing all with all takes minutes
    assert sorted(x for x, e in wrong if not e) == ["x7"]
    assert {x for x, e in wrong if e} == {f"x{k}" for k in range(1, n + 1) if k % 10 != 7} and len(wrong) == n * 9 // 10 + 1
