"""Points in ranges of all widths, and facets under each other's filters, against plain loops."""

import collections
import random

from pyspark.sql import functions as F

from cryptolode.operators import gate, lifecycle


def test_points_in_ranges(spark):
    rng = random.Random(6)
    points = [(n, f"f{n % 3}", rng.choice([rng.randint(-40, 400), rng.randint(0, 10**6)])) for n in range(300)] + [(999, "none", 5)]
    ranges = []
    for n in range(120):
        low = rng.choice([rng.randint(-50, 400), rng.randint(0, 10**6)])
        ranges.append((n, f"f{rng.randrange(4)}", low, low + rng.choice([0, 0, 1, 15, 16, 17, 300, 10**6, -1])))
    got = gate.within(spark.createDataFrame(points, "p int, file string, at int"), spark.createDataFrame(ranges, "r int, file string, low int, high int"), "at", "low", "high", "file")
    want = sorted((p, r) for p, f, at in points for r, g, low, high in ranges if f == g and low <= at <= high)
    assert sorted((x.p, x.r) for x in got.collect()) == want and len(want) > 300
    assert gate.within(spark.createDataFrame(points, "p int, file string, at int"), spark.createDataFrame([], "r int, file string, low int, high int"), "at", "low", "high", "file").count() == 0


def test_violations_are_counted_without_pairs(spark):
    rng = random.Random(8)
    severities, safeties = ["info", " HIGH", "medium", "critical", "odd", None], ["vulnerable", " Grover_Weakened", "hybrid", "quantum_safe", None]
    found = [(f"f{n}", f"F{n % 3}", rng.choice([None, rng.randint(-40, 90), rng.randint(0, 10**6)]), rng.choice(severities), rng.choice(safeties)) for n in range(400)]
    ranges = []
    for n in range(150):
        low = rng.choice([None, rng.randint(-50, 90), rng.randint(0, 10**6)])
        high = None if low is None or n % 7 == 0 else low + rng.choice([0, 1, 2, 15, 16, 17, 63, 300, 10**6, -1])
        ranges.append((f"f{rng.randrange(4)}", low, high, f"r{n % 40}", rng.choice([None, [], ["Vulnerable "], ["grover_weakened", None, "hybrid"]]), rng.choice([None, "low", "Medium", "odd"])))
    findings = spark.createDataFrame(found, "finding_id string, file_path string, line_number int, severity string, quantum_safety string").withColumns({"algorithm": F.lit("X"), "rule_id": F.lit("R")})
    for some in (ranges, ranges + ranges[:9], []):
        forbidden = spark.createDataFrame(some, "file string, line int, line_end int, reason string, allow_safety array<string>, allow_severity string")
        want = {(r.reason, r.n) for r in gate.violations(findings, forbidden).groupBy("reason").agg(F.count("*").alias("n")).collect()}
        assert {tuple(r) for r in gate.violation_counts(findings, forbidden).select("reason", "n").collect()} == want
        assert bool(want) == bool(some)
        tolerated = {r.finding_id for r in gate._inside(findings, forbidden).where("tolerated").collect()}
        none = spark.createDataFrame([], "id string, file string, line int, algorithm array<string>, severity array<string>, quantum_safety array<string>, rule_id_prefix string")
        left = gate.unexplained(findings, none, forbidden, spark.createDataFrame([], "file string"))
        assert {r.finding_id for r in left.collect()} == {x[0] for x in found} - tolerated and bool(tolerated) == bool(some)
    # a thousand ranges over one line's thousand findings: a row a range and node, where pairs would be a million
    hot = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("finding_id"), F.lit("h").alias("file_path"), F.lit(7).alias("line_number"), F.lit("low").alias("severity"), F.lit("vulnerable").alias("quantum_safety"))
    wide = spark.range(1000).select(F.lit("H").alias("file"), F.lit(0).alias("line"), F.lit(1023).alias("line_end"), F.concat(F.lit("r"), "id").alias("reason"), F.array().cast("array<string>").alias("allow_safety"), F.lit(None).cast("string").alias("allow_severity"))
    assert gate._range_nodes(gate._ranges(wide)).count() == 1000
    assert {r.n for r in gate.violation_counts(hot, wide).collect()} == {1000}


def test_recall_without_pairs(spark):
    rng = random.Random(9)
    severities, safeties = ["info", "High", "medium", None, *(f"s{n}" for n in range(9))], ["vulnerable", "Hybrid", "quantum_safe", None, *(f"q{n}" for n in range(9))]
    found = [(f"F{rng.randrange(3)}", rng.choice(["RSA", "md-5", "DES-EDE"]), rng.choice(["PY_A", "PY_B", "GO_A", ""]), rng.choice([None, *range(0, 120, 3)]), rng.choice(severities), rng.choice(safeties)) for _ in range(150)]
    instances = []
    for n in range(250):
        labels = rng.choice([["rsa"], ["MD5", "m.d.5"], ["3DES", "RSA"], []])
        instances.append((f"i{n}", f"f{rng.randrange(4)}", rng.choice([None, rng.randint(-2, 125)]), labels, rng.choice([[], ["HIGH ", "medium"], ["s1", "s2", "s3"]]), rng.choice([[], ["vulnerable", "hybrid"], ["q5"]]), rng.choice([None, "", "PY_", "PY_A", "P%"])))
    findings = spark.createDataFrame(found, "file_path string, algorithm string, rule_id string, line_number int, severity string, quantum_safety string")
    asked = spark.createDataFrame(instances, "id string, file string, line int, algorithm array<string>, severity array<string>, quantum_safety array<string>, rule_id_prefix string")
    plain = lambda x: {"DESEDE": "3DES"}.get(x.upper().replace("-", "").replace(".", ""), x.upper().replace("-", "").replace(".", ""))

    def among(value, wanted):
        return True if not wanted else None if value is None else value.lower() in [w.strip().lower() for w in wanted]

    want = {}
    for name, file, line, labels, severity, safety, prefix in instances:
        rights = []
        for f, algorithm, rule, at, s, q in found:
            if f.lower() == file and plain(algorithm) in map(plain, labels) and rule.startswith(prefix or "") and (line is None or at is not None and abs(at - line) <= 2):
                a, b = among(s, severity), among(q, safety)
                rights.append(False if a is False or b is False else None if a is None or b is None else True)
        want[name] = "matched" if True in rights else "mismatched" if False in rights else "missed"
    assert {r.id: r.outcome for r in gate.recall(asked, findings).collect()} == want
    assert set(want.values()) == {"matched", "mismatched", "missed"}
    # a thousand findings that one line has are one row to look at, in the plan's widest join too
    crowd = findings.limit(1).crossJoin(spark.range(1000)).drop("id").withColumns({"file_path": F.lit("f"), "line_number": F.lit(5), "algorithm": F.lit("RSA")})
    ask = spark.createDataFrame([("i", "f", 5, ["RSA"], [], [], None)], asked.schema)
    assert gate._met(ask, crowd).count() == 1


def test_facets_under_the_filters_of_the_others(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, t string, u int")
    got = {(r.facet, r.value): r.n for r in lifecycle.all_facets(df, {"s": F.col("s").isin("a", "b"), "t": F.col("t") == "x", "u": F.lit(True)}).collect()}
    want = collections.Counter()
    for s, t, u in rows:
        if t == "x":
            want["s", s] += 1
        if s in ("a", "b"):
            want["t", t] += 1
        if s in ("a", "b") and t == "x":
            want["u", str(u)] += 1
    assert got == dict(want)
    assert lifecycle.all_facets(df.limit(0), {"s": F.lit(True)}).count() == 0
