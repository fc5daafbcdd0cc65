"""Sources, detection, fusion, graphs, plans, gates and reports on small original fixtures."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cryptolode.operators import agility, detect, fuse, gate, graph, lifecycle, plan, sbom, suppress
from cryptolode.sinks import reports
from cryptolode.sources import files, manifests, notebook, rules, tls
from cryptolode.streaming import detect_stream

FINDING = "finding_id string, channel string, algorithm string, rule_id string, category string, usage_type string, severity string, quantum_safety string, file_path string, line_number int, column int, confidence double, snippet string, language string, position long"


def finding(i, **k):
    base = {
        "finding_id": f"f{i}", "channel": "ast", "algorithm": "RSA", "rule_id": "R", "category": "crypto-api", "usage_type": "signing", "severity": "high", "quantum_safety": "vulnerable",
        "file_path": "a/x.py", "line_number": i, "column": 1, "confidence": 0.8, "snippet": "s", "language": "python", "position": i,
    }
    return tuple((base | k)[c.split()[0]] for c in FINDING.split(", "))


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def tree(spark, tmp_path, content):
    for path, text in content.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    return files.text_files(files.read_tree(spark, str(tmp_path)))


def test_tree_routing_and_lines(spark, tmp_path):
    found = tree(spark, tmp_path, {"a/x.PY": "one\r\ntwo\n", "b.unknown": "x", "Dockerfile": "FROM x", "bin.go": b"a\0b", "sub/web.nginx.conf": "#", "big.c": b"x" * (5 * 1024 * 1024 + 1)})
    rows = {r.path: (r.language, r.text) for r in found.collect()}
    assert rows == {"a/x.PY": ("python", "one\r\ntwo\n"), "Dockerfile": ("dockerfile", "FROM x"), "bin.go": ("go", ""), "sub/web.nginx.conf": ("nginx", "#")}
    assert {(r.path, r.line_number, r.line) for r in files.lines(found).collect()} == {("a/x.PY", 1, "one"), ("a/x.PY", 2, "two"), ("Dockerfile", 1, "FROM x"), ("sub/web.nginx.conf", 1, "#")}
    assert files.read_tree(spark, str(tmp_path), only=["Dockerfile"]).count() == 1


def test_own_rules_pass_their_examples(spark):
    pack = rules.load_rules(spark)
    assert rules.self_test(pack).count() == 0 and pack.count() >= 15
    bare = rules.without_examples(pack)
    new, gone = rules.coverage_ratchet(pack, bare)
    assert new.count() == gone.count() == 0
    assert {r.rule_id: r.confidence for r in pack.collect()}["PY_MD5_STRUCTURE"] == 0.95


@pytest.mark.parametrize("text", ["- {id: A, language: x, severity: bad, detector: {type: regex, pattern: a}}", "- {id: A, language: x, severity: low, detector: {type: other}}", "{language: x}"])
def test_bad_rules_are_refused(text):
    with pytest.raises(ValueError):
        rules.parse_rules(text)


SOURCES = {
    "app/hash.py": "import hashlib\n# é\nh = hashlib.md5(b'x'); g = hashlib.md5(b'y')\nk = hashlib.sha1(z)  # crypto-ignore: PY_SHA1_CALL\n",
    "app/é.py": "érsa = hashlib.md5(1)\n",
    "web/site.conf": "ssl_protocols TLSv1 TLSv1.2;\n",
    "web/nginx.conf": "ssl_protocols TLSv1 TLSv1.2;\n",
    "app/own.py": "h0 = 0x6a09e667\ns = rotr(w, 7) ^ rotr(w, 18)\nc = pow(m, e, n)\n",
    "app/gap.py": "import os\nfrom cryptography import x509\nimport rsa\n",
    "app/safe.py": "import oqs; import rsa\n",
}


def test_detection_in_both_ways(spark, tmp_path):
    source = tree(spark, tmp_path, SOURCES)
    pack = rules.load_rules(spark)
    found = detect.detect_pack(source, pack)
    rows = {(r.path, r.rule_id, r.line_number, r.column, r.match_ordinal) for r in found.collect()}
    assert {("app/hash.py", "PY_MD5_CALL", 3, 5, 0), ("app/hash.py", "PY_MD5_CALL", 3, 28, 1), ("app/é.py", "PY_MD5_CALL", 1, 9, 0), ("web/nginx.conf", "NGINX_OLD_TLS", 1, 1, 0)} <= rows
    assert not any(p == "web/site.conf" for p, *_ in rows)
    literal = detect.detect_literal(source, [("PY_MD5_CALL", r"\bhashlib\.(?:md5\b|new\(\s*[\"']md5[\"'])")])
    assert {tuple(r) for r in literal.select("path", "line_number", "column", "match_ordinal").collect()} == {(p, n, c, m) for p, rule, n, c, m in rows if rule == "PY_MD5_CALL"}
    assert found.where("rule_id = 'PY_SHA1_CALL'").first().snippet_context == ["import hashlib", "# é", "h = hashlib.md5(b'x'); g = hashlib.md5(b'y')", "k = hashlib.sha1(z)  # crypto-ignore: PY_SHA1_CALL"]
    full = detect.to_findings(found, pack, "job")
    kept = suppress.unsuppressed(full, files.lines(source).select("path", "line_number", "line"))
    assert full.where("rule_id = 'PY_SHA1_CALL'").count() == 1 and kept.where("rule_id = 'PY_SHA1_CALL'").count() == 0 and kept.count() == full.count() - 1
    made = fuse.promote(full.withColumn("position", F.col("rule_ordinal") * 1000 + F.col("line_number")))
    assert [(r.file_path, r.rule_id, round(r.confidence, 4)) for r in made.collect()] == [("app/own.py", "HANDROLLED_SHA256_PROMOTED", 0.94)]
    assert detect.sentinel(source, kept).count() == 0
    quiet = detect.sentinel(source.where("path in ('app/gap.py', 'app/safe.py')"), kept.limit(0))
    assert [(r.path, r.line_number, r.column, r.library) for r in quiet.collect()] == [("app/gap.py", 2, 1, "cryptography")]


def test_a_line_with_a_control_character_keeps_its_matches(spark):
    text = "é\x01md5(a)\x01\x01 md5(b) \x02\x01md5(c)\x01\nmd5(d)"
    files = spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")
    pattern = r"\bmd5\("
    want = [(n, len(line[: m.start()].encode()) + 1, k, line) for n, line in enumerate(text.split("\n"), 1) for k, m in enumerate(re.finditer(pattern, line))]
    got = detect.detect_literal(files, [("MD5", pattern)]).select("line_number", "column", "match_ordinal", "snippet").collect()
    assert len(want) == 4 and sorted(map(tuple, got)) == want
    found = detect.detect_literal(files, [("MD5", pattern)]).select(F.col("path").alias("file_path"))
    assert detect.sentinel(files, found, [("python", "md5", "md5")]).isEmpty()


def test_directives(spark):
    text = ["x # crypto-ignore", "y", "z # crypto-ignore: A, B", "w // crypto-ignore:C", "v", "u crypto-ignore:", "t crypto-ignore: ", "s crypto-ignore: A because"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text, 1)], "path string, line_number int, line string")
    got = [r.suppressed for r in suppress.directives(lines).orderBy("line_number").collect()]
    assert got == [["*"], ["*"], ["A", "B"], ["C"], ["C"], ["*"], [], ["A because"]]


def test_ignored_paths(spark):
    patterns = suppress.parse_ignore("*.log\n!keep.log\n/gen/\ndocs/**/x\n[a].py\n")
    paths = {"a.log": True, "d/keep.log": False, "gen/a": True, "x/gen/a": False, "docs/q/r/x": True, "[a].py": True, "a.py": False, "node_modules/keep.log": True, "a/node_modules/b.py": False, "build": False, "build/x": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.x for r in df.select("path", suppress.is_excluded(F.col("path"), patterns).alias("x")).collect()} == paths


def test_fusion(spark):
    own = findings(
        spark, finding(1, algorithm="RSA-2048", confidence=0.85), finding(2, channel="sbom", algorithm="RSA", confidence=0.7, severity="info"), finding(3, algorithm="MD5", confidence=0.85),
        finding(4, algorithm="MD5", confidence=0.85, severity="odd"), finding(5, algorithm="?", confidence=0.0, rule_id="Q"), finding(6, algorithm="DES", severity="odd"),
    )
    got = {r.algorithm_class: (r.channels, r.corroboration, round(r.confidence, 4), r.severity, len(r.findings)) for r in fuse.fuse(own, ["finding_id"]).collect()}
    assert got == {"RSA": (["ast", "sbom"], 2, 0.955, "high", 2), "MD5": (["ast"], 1, 0.9775, "high", 2), "UNCLASSIFIED:Q": (["ast"], 1, 0.5, "high", 1), "DES": (["ast"], 1, 0.8, "", 1)}
    with_ = {r.finding_id: (r.cluster_corroboration, round(r.cluster_confidence, 4)) for r in fuse.with_cluster(own, fuse.clusters(own)).collect()}
    assert with_["f1"] == (2, 0.955) and with_["f5"] == (1, 0.5)


def test_promotion_rules(spark):
    sig = {"category": "crypto-fingerprint"}
    own = findings(
        spark, finding(1, rule_id="A", algorithm="RSA", confidence=0.35, category="handrolled-crypto", line_number=9), finding(2, rule_id="B", algorithm="DH", confidence=0.95, **sig),
        finding(3, rule_id="A", algorithm="AES", file_path="b", confidence=0.9, **sig), finding(4, rule_id="A", algorithm="AES", file_path="b", confidence=0.5, **sig),
        finding(5, rule_id="A", algorithm="AES", file_path="c", confidence=0.0, **sig), finding(6, rule_id="B", algorithm="AES-", file_path="c", confidence=0.9, **sig),
        finding(7, rule_id="A", algorithm="MD5", file_path="d", usage_type="handrolled", **sig), finding(8, rule_id="B", algorithm="MD5", file_path="d", **sig),
    )
    got = [(r.file_path, r.rule_id, r.algorithm, r.line_number, r.confidence, r.severity) for r in fuse.promote(own).collect()]
    assert got == [("a/x.py", "HANDROLLED_DH_PROMOTED", "DH", 9, 0.95, "high")]


def test_agility(spark):
    card = agility.scorecard(findings(spark).limit(0), []).first()
    assert (card.total_score, card.grade) == (100, "Agile")
    own = findings(
        spark, finding(1, rule_id="PY_IMPORT_RSA"), finding(2, rule_id="GO_USE_TLS", algorithm="TLS"), finding(3, rule_id="X_HARDCODED", algorithm="aes", file_path="b"), finding(4, file_path="c"), finding(5, file_path="d")
    )
    card = agility.scorecard(own, []).first()
    assert (card.library_score, card.concentration_score, card.diversity_score, card.hardcoded_score, card.grade) == (20, 25, 25, 0, "Manageable")
    assert card.libraries == ["RSA", "TLS"] and card.algorithms == ["AES", "RSA"]


REPO = {
    "pkg/rsa/key.go": "package rsa\n", "cmd/main.go": 'package main\nimport (\n\t"fmt"\n\tx "example.com/m/pkg/rsa"\n)\nvar s = "a/b"\n', "one.go": 'import "example.com/rsa"\n',
    "lib/helper.py": "import os\n", "lib/__init__.py": "", "app.py": "from lib import helper as h, other  # note\nimport lib.helper\n", "lib/user.py": "from . import helper\nfrom ..app import x\n", "mylib/helper.py": "",
    "web/a.ts": "import { x } from './b'\nconst y = require('../web/c.js')\nimport z from 'react'\n", "web/b/index.ts": "", "web/b.js": "", "web/c.js": "", "node_modules/q/i.js": "import './j'\n", "Web/Up.JS": "import './b'\n",
}


def test_graph_of_a_repository(spark):
    nodes, edges = graph.build(spark.createDataFrame(list(REPO.items()), "path string, text string"))
    got = {(r.importer, r.importee) for r in edges.collect()}
    assert got == {
        ("cmd/main.go", "pkg/rsa/key.go"), ("one.go", "pkg/rsa/key.go"), ("app.py", "lib/helper.py"), ("app.py", "mylib/helper.py"), ("app.py", "lib/__init__.py"), ("lib/user.py", "lib/helper.py"), ("lib/user.py", "app.py"),
        ("web/a.ts", "web/b.js"), ("web/a.ts", "web/c.js"), ("app.py", "mylib/helper.py"), ("web/up.js", "web/b.js"),
    }
    assert nodes.count() == 13 and graph.counts(nodes, edges).first().n_edges == 10


def test_reach(spark):
    edges = [("d1", "x"), ("d2", "x"), ("d3", "x"), *[(f"t{i}", f"d{i % 3 + 1}") for i in range(5)], ("x", "t0"), ("x", "x")]
    nodes = [("x",), ("p/a",), ("p/b",), *[(e[0],) for e in edges]]
    reach = graph.impact(spark.createDataFrame(nodes, "node string"), spark.createDataFrame(edges, "importer string, importee string"), spark.createDataFrame([("x",), ("p/a",)], "node string"))
    got = {r.node: (r.direct, r.transitive, r.siblings, r.blast_radius, r.band, r.affected_files[:2]) for r in reach.collect()}
    assert got == {"x": (3, 8, 8, 35, "Medium", ["d1", "d2"]), "p/a": (0, 0, 1, 1, "Low", [])}


def test_closure_against_search(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    wanted = set()
    for start in {b for _, b in edges}:
        seen, todo = {start}, [start]
        while todo:
            here = todo.pop()
            for a, b in edges:
                if b == here and a != b and a not in seen:
                    seen.add(a)
                    todo.append(a)
        wanted |= {(start, x) for x in seen - {start}}
    got = graph.transitive_importers(spark.createDataFrame(sorted(edges), "importer string, importee string"))
    assert {(r.node, r.importer) for r in got.collect()} == wanted
    assert graph.transitive_importers(spark.createDataFrame(sorted(edges), "importer string, importee string"), hops=1).where("hop > 1").count() == 0


def test_plan(spark):
    own = findings(spark, finding(1, severity="critical", confidence=0.9), finding(2, severity="low", file_path="b.py", algorithm="?"), finding(3, channel="sbom", confidence=0.7))
    ready = fuse.with_cluster(own.where("channel = 'ast'"), fuse.clusters(own)).withColumn("blast_radius", F.when(F.col("finding_id") == "f1", 80).otherwise(0)).withColumn("band", F.when(F.col("finding_id") == "f1", "High").otherwise("Low"))
    items = plan.score_items(ready, F.lit(27), F.lit("Difficult"))
    got = [(r.finding_id, r["rank"], r.score, r.corroboration, r.priority_band) for r in plan.ranked(items).orderBy("rank").collect()]
    assert got == [("f1", 1, 25 + 22 + 28 + 7, 2, "Immediate"), ("f2", 2, 6 + 16 + 0 + 7, 1, "Monitor")]
    assert tuple(plan.summary(items).first()) == (2, 1, 1, 1, 1, 82)
    assert [(r.phase, r.n, r.effort_days, r.ranks) for r in plan.phases(plan.ranked(items)).orderBy("phase").collect()] == [(1, 1, 2, [1]), (3, 1, 2, [2])]
    assert len(items.where("finding_id = 'f1'").first().rationale) == 4
    signals = plan.cluster_signals(fuse.fuse(own, ["finding_id", "file_path", "line_number", "column", "rule_id", "algorithm", "severity"]))
    assert {r.key: r.cluster_corroboration for r in signals.collect()} == {"id:f1": 2, "id:f2": 1, "id:f3": 2}


def test_ranks_are_a_total_order(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("finding_id"), (F.col("id") % 7).cast("int").alias("score"), (F.col("id") % 5).cast("long").alias("blast_radius"), F.concat(F.lit("p"), F.col("id") % 11).alias("file_path"), (F.col("id") % 3).cast("int").alias("line_number"), F.lit("r").alias("rule_id"))
    got = [r.finding_id for r in plan.ranked(rows).orderBy("rank").collect()]
    wanted = sorted(rows.collect(), key=lambda r: (-r.score, -r.blast_radius, r.file_path, r.line_number, r.rule_id, r.finding_id))
    assert got == [r.finding_id for r in wanted]


def test_lifecycle(spark):
    own = findings(spark, finding(1, snippet="x"), finding(2, snippet="x"), finding(3, snippet="y"))
    base = lifecycle.baseline(own.where("finding_id = 'f1'"))
    assert [r.finding_id for r in lifecycle.beyond_baseline(own, base).collect()] == ["f3"] and lifecycle.accepted_count(own, base).first().suppressed == 2
    assert lifecycle.exit_code(own, "critical").first().exit_code == 0 and lifecycle.exit_code(own, "").first().exit_code == 1 and lifecycle.exit_code(own.limit(0), "").first().exit_code == 0
    snapshots = [spark.createDataFrame(x, "path string, digest string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "1"), ("c", "2"), ("d", "1")])]
    changes = lifecycle.snapshot_diff(*snapshots)
    assert {(r.path, r.state) for r in changes.collect()} == {("a", "removed"), ("c", "modified"), ("d", "new")}
    users = spark.createDataFrame([("u", "x/c"), ("c", "d"), ("v", "pkg.d"), ("w", "a")], "path string, module string")
    assert {(r.path, r.state) for r in lifecycle.expand_importers(changes, users).collect()} == {("a", "removed"), ("c", "modified"), ("d", "new"), ("u", "modified")}
    runs = spark.createDataFrame([("p", 1, "a"), ("p", 3, "b"), ("q", 2, "c")], "project string, at int, run string")
    assert {(r.project, r.run) for r in lifecycle.latest(runs, "project", "at", "run").collect()} == {("p", "b"), ("q", "c")}
    assert [r.change for r in lifecycle.trend(runs.withColumn("v", F.col("at") * 2), "project", "at", "v").orderBy("project", "at").collect()] == [None, 4, None]
    assert [r.id for r in lifecycle.page(spark.range(10), [F.col("id")], 99, 4, 10).collect()] == [8, 9]


def test_enrichment_fills_only_what_is_empty(spark):
    overlay = spark.createDataFrame([("R", "old", "", "", ["a"], [1], 1), ("R", "new", "t", "", [], [2], 2)], "rule_id string, recommendation string, migration_target string, vertical_context string, references array<string>, cwe array<int>, ordinal int")
    own = findings(spark, finding(1), finding(2, rule_id="S")).withColumns({"recommendation": F.when(F.col("finding_id") == "f1", "mine").otherwise(""), "migration_target": F.lit(""), "vertical_context": F.lit(""), "references": F.array().cast("array<string>"), "cwe": F.lit(None).cast("array<int>")})
    got = {r.finding_id: (r.recommendation, r.migration_target, r.references, r.cwe, r.enriched) for r in lifecycle.enrich(own, overlay).collect()}
    assert got == {"f1": ("mine", "t", [], [2], True), "f2": ("", "", [], None, False)}


MANIFESTS = {
    "requirements.txt": "# c\nRSA[x]>=1 ; python_version > '3'\n-r y\npkg @ http://z\nrequests==2 # why\n", "requirements-dev.txt": "ecdsa\n", "Pipfile": '[packages]\njwt = "*"\npython = "3"\n[other]\nz = "1"\n[dev-packages]\n"paramiko" = {version = "1"}\n',
    "pyproject.toml": '[project]\nname = "x"\ndependencies = [\n  "rsa>=1",\n  # no\n  "bcrypt",\n]\noptional = "q"\n[tool.poetry.dependencies]\npython = "3"\npyjwt = "^2"\n', "svc/pyproject.toml": '[project]\ndependencies = ["a>1", "b"]\n',
    "package.json": '{\n "dependencies": {"node-rsa": "1"},\n "devDependencies": {"node-rsa": "1", "x": "2"}\n}', "bad/package.json": "{", "go.mod": "module m\nrequire one/two v1 // indirect\nrequire (\n\tfilippo.io/age v1.2\n\t// no v2\n)\n", "vendor/go.mod": "require a/b v1\n",
}


def test_overlay_folders(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {rule_id: R, recommendation: first, cwe: [1]}\n- {rule_id: S, recommendation: other}\n")
    (tmp_path / "b.YML").write_text("{rule_id: R, recommendation: last}\n")
    (tmp_path / "c.yml").write_text("{note: nothing}\n")
    overlay = rules.load_overlay(spark, str(tmp_path))
    assert [(r.rule_id, r.recommendation, r.cwe) for r in overlay.orderBy("ordinal").collect()] == [("R", "first", [1]), ("S", "other", []), ("R", "last", [])]
    assert rules.load_overlay(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "d.yml").write_text("- {recommendation: x}\n")
    with pytest.raises(ValueError):
        rules.load_overlay(spark, str(tmp_path))


def test_most_recent_and_by_score(spark):
    rows = spark.createDataFrame([(i, i // 2, "f", 1, f"x{i}") for i in range(9)], "k int, score int, file_path string, line_number int, finding_id string")
    assert [r.k for r in lifecycle.most_recent(rows, "score", "k", 3).collect()] == [8, 7, 6]
    assert [r.k for r in lifecycle.by_score(rows).collect()] == [8, 6, 7, 4, 5, 2, 3, 0, 1]


def test_manifests(spark):
    found = manifests.dependencies(spark.createDataFrame(list(MANIFESTS.items()), "path string, text string"))
    got = {(r.manifest, r.package, r.version, r.line) for r in found.collect()}
    assert got == {
        ("requirements.txt", "RSA", ">=1", 2), ("requirements.txt", "pkg", "", 4), ("requirements.txt", "requests", "==2", 5), ("requirements-dev.txt", "ecdsa", "", 1), ("Pipfile", "jwt", "*", 2), ("Pipfile", "paramiko", '{version = "1"}', 7),
        ("pyproject.toml", "rsa", ">=1", 4), ("pyproject.toml", "bcrypt", "", 6), ("pyproject.toml", "pyjwt", "^2", 11), ("svc/pyproject.toml", "a", ">1", 2), ("svc/pyproject.toml", "b", "", 2),
        ("package.json", "node-rsa", "1", 2), ("package.json", "x", "2", 3), ("go.mod", "one/two", "v1", 2), ("go.mod", "filippo.io/age", "v1.2", 4),
    }
    assert found.where("package = 'node-rsa'").count() == 2
    flagged = sbom.fan_out(found, sbom.knowledge(spark))
    assert {(r.rule_id, r.quantum_safety) for r in flagged.where("package = 'RSA'").collect()} == {("SBOM_PYTHON_RSA_RSA", "vulnerable")}
    assert {r.quantum_safety for r in sbom.fan_out(spark.createDataFrame([("go", "github.com/cloudflare/CIRCL", "v1", "go.mod", 1)], "ecosystem string, package string, version string, manifest string, line int"), sbom.knowledge(spark)).collect()} == {"quantum_safe"}
    assert sbom.knowledge(spark).count() == 35


def test_notebooks(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "code", "source": "c = 3\n"}, {"cell_type": "code"}]})
    own = spark.createDataFrame([("n.ipynb", book), ("bad.ipynb", "{")], "path string, text string")
    cells = notebook.cell_lines(own)
    assert [tuple(r) for r in cells.orderBy("line_number").collect()] == [("n.ipynb", 1, 1, "a = 1", 1), ("n.ipynb", 1, 2, "b = 2", 2), ("n.ipynb", 2, 1, "c = 3", 4), ("n.ipynb", 3, 1, "", 6)]
    assert notebook.as_source(own).first().text == "a = 1\nb = 2\n\nc = 3\n\n"
    assert notebook.in_cells(findings(spark, finding(4, file_path="n.ipynb")), cells).first().snippet == "[cell 2] s"


def test_tls(spark):
    rows = [("h:443", "1.2", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "RSA", 1024, "SHA1-RSA", datetime(2024, 1, 5), "CN=a", "CN=a", True, False), ("k:443", "1.3", "TLS_AES_128_GCM_SHA256", "Ed25519", 256, "Ed25519", datetime(2025, 1, 1), "CN=a", "CN=b", False, False)]
    got = {(r.file_path, r.rule_id, r.severity) for r in tls.findings(spark.createDataFrame(rows, tls.OBSERVATION_SCHEMA), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {("h:443", r, s) for r, s in (("TLS_VERSION_TLS10", "critical"), ("TLS_WEAK_CIPHER", "critical"), ("TLS_CERT_CLASSICAL_KEY", "high"), ("TLS_CERT_RSA_WEAK", "critical"), ("TLS_CERT_SHA1_SIG", "high"), ("TLS_CERT_EXPIRING", "critical"), ("TLS_CERT_SELF_SIGNED", "medium"))}
    df = spark.createDataFrame([("https://a.b:8443/x",), ("c",), ("[::1]:9",), ("[::2]",)], "t string")
    host, port = tls.target(F.col("t"))
    assert [tuple(r) for r in df.select(host, port).collect()] == [("a.b", 8443), ("c", 443), ("::1", 9), ("::2", 443)]


def test_gate(spark):
    instances = spark.createDataFrame(
        [("i1", "A/x.py", 3, ["rsa"], ["high"], ["vulnerable"], "floor", "python", None), ("i2", "a/x.py", 40, ["MD5"], [], [], "floor", "python", None), ("i3", "b.rb", None, ["RSA"], ["low"], [], "floor", "ruby", "R"), ("i4", "c.jl", 1, ["RSA"], [], [], "ast", "julia", None)],
        "id string, file string, line int, algorithm array<string>, severity array<string>, quantum_safety array<string>, tier string, language string, rule_id_prefix string",
    )
    own = findings(spark, finding(5), finding(1, file_path="b.rb"), finding(9, file_path="z.py", algorithm="DES"), finding(12, file_path="y.py", algorithm="DES", severity="low"))
    assert {(r.id, r.outcome) for r in gate.recall(instances, own, ["python"]).collect()} == {("i1", "matched"), ("i2", "missed"), ("i3", "mismatched"), ("i4", "skipped")}
    assert tuple(gate.recall_counts(gate.recall(instances, own, ["python"])).first()) == (1, 1, 1, 1)
    forbidden = spark.createDataFrame([("z.py", 8, 10, "why", [], None), ("y.py", None, None, "whole", ["vulnerable"], "medium")], "file string, line int, line_end int, reason string, allow_safety array<string>, allow_severity string")
    assert [(r.finding_id, r.reason) for r in gate.violations(own, forbidden).collect()] == [("f9", "why")]
    excluded = spark.createDataFrame([("none",)], "file string")
    assert [r.finding_id for r in gate.unexplained(own, instances, forbidden, excluded).collect()] == ["f9"]
    deps = spark.createDataFrame([("go.mod", "p", "RSA")], "file_path string, package string, algorithm string")
    expected = spark.createDataFrame([("go.mod", "P", ["RSA", "DES"])], "manifest string, package string, algorithms_include array<string>")
    wrong = spark.createDataFrame([("GO.mod", "p")], "manifest string, package string")
    assert {r.problem for r in gate.dependencies(expected, wrong, deps).collect()} == {"missing DES", "must not be flagged"}


def test_reports(spark, tmp_path):
    own = findings(spark, finding(1, severity="critical", snippet="<b>"), finding(2, severity="low", rule_id="S"), finding(3, severity="critical")).withColumn("message", F.concat(F.lit("<m> "), "finding_id")).withColumn("cwe", F.array(F.lit(327)))
    log = json.loads(reports.render(own, "sarif"))
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R", "S"] and len(run["results"]) == 3 and run["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == "<m> f3"
    path = tmp_path / "r.sarif"
    path.write_text(json.dumps(log))
    back = reports.read_sarif(spark, str(path))
    assert sorted(r.severity for r in back.collect()) == ["critical", "critical", "low"]
    reports.write_jsonl(own, str(tmp_path / "out"))
    (tmp_path / "out" / "bad.json").write_text("{oops\n")
    assert reports.read_jsonl(spark, str(tmp_path / "out")).count() == 3
    assert "## Critical (2)" in reports.render(own, "md") and "&lt;m&gt;" in reports.render(own, "html") and reports.render(own, "text").startswith("critical: 2  low: 1") and len(json.loads(reports.render(own, "json"))) == 3
    assert len(reports.render(own, "jsonl").splitlines()) == 3 and "…and 1 more" in reports.comment(own, 2) and reports.annotations(own, 2).count() == 2
    with pytest.raises(ValueError):
        reports.render(own, "pdf")
    many = own.unionByName(own).unionByName(own.withColumn("severity", F.lit("odd")))
    for form in reports.FORMATS:
        reports.write(many, form, str(tmp_path / form))
        parts = "".join(p.read_text() for p in sorted((tmp_path / form).glob("part-*")))
        assert parts == reports.render(many, form)
        if form == "sarif":
            results = json.loads(parts)["runs"][0]["results"]
            assert [r["message"]["text"] for r in results] == sorted(r["message"]["text"] for r in results) and len(results) == 9
        elif form == "json":
            assert len(json.loads(parts)) == 9
        elif form == "md":
            assert [x for x in parts.splitlines() if x.startswith("## ")] == ["## Critical (4)", "## Low (2)", "## Other (3)"] and parts.count("<m>") == 9
    none = own.limit(0)
    assert json.loads(reports.render(none, "sarif"))["runs"][0]["results"] == [] == json.loads(reports.render(none, "json")) and reports.render(none, "text") == "no findings\n" and reports.render(none, "jsonl") == ""
    reports.write_scorecard(agility.scorecard(own.withColumn("module", F.lit("m")), ["module"]), str(tmp_path / "card"))
    assert spark.read.json(str(tmp_path / "card")).first()["module"] == "m"
    lang = spark.createDataFrame([("go",), ("go",), ("c",)], "language string")
    row = reports.scan_summary(lang, lang.limit(1), own).first()
    assert (row.files_scanned, row.files_skipped, row.n_findings, row.by_language) == (3, 1, 3, {"go": 2, "c": 1})
    reports.write_scored(own.withColumn("scan_run_id", F.lit("s1")), str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 3


def test_findings_become_report_lines_where_they_are(spark):
    own = findings(spark, *[finding(5, snippet=m) for m in ("b", "a", "a", "c", "a")], finding(9)).withColumn("finding_id", F.lit("f")).repartition(4)
    for form in ("json", "sarif"):
        read = json.loads(reports.render(own, form))
        assert len(read if form == "json" else read["runs"][0]["results"]) == 6
    assert json.loads(reports.render(own.limit(0), "json")) == []
    stored = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("finding_id"), F.lit("a").alias("file_path"))
    plan = reports.document(stored, "jsonl")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stream_finds_each_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"path": f"f{i % 2}.py", "text": "hashlib.md5(x)\n", "arrived": "2024-01-01T00:00:00Z"} for i in range(4)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    found = detect_stream.detect_once(detect_stream.arriving_files(spark, str(source)), [("MD5", r"\bmd5\b")])
    job = detect_stream.write(found, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["f0.py", "f1.py"]
