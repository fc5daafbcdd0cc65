"""Structural queries, certificates and keys, ground truth and settings."""

import base64

import pytest
from pyspark.sql import functions as F

from cryptolode.operators import detect, structure, tokens
from cryptolode.plans import bindings
from cryptolode.schema import RULE_SCHEMA
from cryptolode.sources import rules, truth, x509

CASES = [
    ("python", "call:hashlib.md5", "import hashlib\nx = hashlib.md5(a)\n# hashlib.md5(b)\ns = 'hashlib.md5(c)'\ny = hashlib . md5 (d)\n", [(2, 5), (5, 5)]),
    ("python", "import:cryptography", "from cryptography.x import y\nimport cryptographyx\nimport cryptography\n", [(1, 1), (3, 1)]),
    ("python", "attr:ssl.PROTOCOL_TLSv1", "a = ssl.PROTOCOL_TLSv1\nssl.PROTOCOL_TLSv1()\n", [(1, 5)]),
    ("python", "call:f", "f((\nprint 'python 2'\n", [(1, 1)]),
    ("go", "call:md5.New", 'é := md5.New() // md5.New()\n/* md5.New()\n*/ x.md5.New()\ns := `md5.New()`\n', [(1, 7)]),
    ("go", "import:crypto/des", 'import (\n\t"crypto/des"\n\t// "crypto/des"\n\t"crypto/desx"\n)\n', [(2, 2)]),
    ("javascript", "new:RSA", "const a = new RSA(1); // new RSA(2)\nnew lib.RSA();\nnewRSA(3)\n", [(1, 11), (2, 1)]),
    ("javascript", "import:crypto", "import c from 'crypto'\nconst d = require('crypto')\nimport e from 'crypto-js'\n", [(1, 1), (2, 11)]),
    ("csharp", "memberref:CipherMode.ECB", 'x.Mode = CipherMode.ECB;\nvar s = "CipherMode.ECB";\nCipherMode.ECB();\n', [(1, 10)]),
    ("php", "call:md5", "$a = md5($b); # md5(1)\n$x->md5(2);\n$s = 'md5(3)';\nX::md5(4);\n", [(1, 6)]),
    ("ruby", "require:digest/md5", "require 'digest/md5'\n# require 'digest/md5'\nrequire 'digest/md5x'\n", [(1, 1)]),
    ("ruby", "const:Digest::MD5", "Digest::MD5.hexdigest(x)\nDigest::MD5x\n", [(1, 1)]),
    ("c", "include:openssl/des.h", "#include <openssl/des.h>\n// #include <openssl/des.h>\n", [(1, 1)]),
    ("java", "import:java.util.Random", "import java.util.Random;\nimport java.util.Randomx;\n", [(1, 1)]),
    ("rust", "call:md5::compute", "let d = md5::compute(x);\n", [(1, 9)]),
    ("scala", "import:tsec.cipher.*", "import tsec.cipher.aes.AES\nimport tsec.other\n", [(1, 1)]),
    *bindings.STRUCTURES,
]


def test_structural_queries(spark):
    """Each text is a file, looked at with its own rule of a language that no other file has rules of."""
    found = {}
    for lang in {c[0] for c in CASES}:
        own = [(n, *c) for n, c in enumerate(CASES) if c[0] == lang]
        names = ("rule_ordinal", "rule_id", "language", "detector_type", "query")
        pack = [tuple(dict(zip(names, (n, str(n), lang, "ast", query), strict=True)).get(f.name) for f in RULE_SCHEMA) for n, _, query, _, _ in own]
        files = spark.createDataFrame([(str(n), lang, text) for n, _, _, text, _ in own], "path string, language string, text string")
        for r in structure.detect_structure(files, spark.createDataFrame(pack, RULE_SCHEMA)).where("path = rule_id").collect():
            found.setdefault(int(r.path), []).append((r.line_number, r.column))
            assert r.snippet == CASES[int(r.path)][2].split("\n")[r.line_number - 1]
    assert [(c[:2], c[3], sorted(found.get(n, []))) for n, c in enumerate(CASES) if sorted(found.get(n, [])) != c[3]] == []


def test_structural_findings_supersede(spark):
    files = spark.createDataFrame([("a.py", "python", "h = hashlib.md5(x)\n"), ("b.go", "go", "x")], "path string, language string, text string")
    pack = rules.load_rules(spark)
    found = structure.detect_structure(files, pack)
    assert [(r.path, r.rule_id, r.line_number, r.column) for r in found.collect()] == [("a.py", "PY_MD5_STRUCTURE", 1, 5)]
    deep, flat = (detect.to_findings(f(files, pack), pack) for f in (structure.detect_structure, detect.detect_pack))
    same = deep.withColumn("rule_id", F.lit("PY_MD5_CALL"))
    assert {(r.layer_ordinal, r.rule_id) for r in detect.supersede(flat, same).collect()} == {(0, "PY_MD5_CALL")}


def test_files_are_dealt_by_their_bytes(spark, monkeypatch):
    """More files go to more tasks, whole, and their tokens are the same."""
    files = spark.createDataFrame([(f"p{i}", "python", f"x = lib.md5({i})\ny = 'z'\n") for i in range(60)], "path string, language string, text string")
    found = []
    for portion in (10**9, 100):
        monkeypatch.setattr(tokens, "PORTION", portion)
        cut = tokens.tokens(files).withColumn("part", F.spark_partition_id())
        found.append(sorted(map(tuple, cut.drop("part").collect())))
        assert cut.groupBy("path").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
        assert (cut.select("part").distinct().count() > 5) == (portion == 100)
    assert found[0] == found[1] and found[0]


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def oid(text):
    return der(6, bytes.fromhex(text))


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = "2a864886f70d010101"
RSA_INFO = der(0x30, der(0x30, oid(RSA), der(5)), der(3, b"\0" + der(0x30, number(1 << 2047), number(65537))))
EC_INFO = der(0x30, der(0x30, oid("2a8648ce3d0201"), oid("2b81040022")), der(3, b"\0\4abc"))
UNKNOWN = der(0x30, der(0x30, oid("608648016503040312")), der(3, b"\0x"))


def certificate(info, sig, request=False):
    name = der(0x30)
    head = [number(0), name, info] if request else [der(0xA0, number(2)), number(5), der(0x30, oid(sig)), name, der(0x30), name, info]
    return der(0x30, der(0x30, *head), der(0x30, oid(sig)), der(3, b"\0x"))


def pem(kind, body):
    return f"-----BEGIN {kind}-----\n".encode() + base64.encodebytes(body) + f"-----END {kind}-----\n".encode()


def test_certificates_and_keys(spark):
    ssh = b"openssh-key-v1\0" + b"\0\0\0\7ssh-rsa"
    pkcs8 = der(0x30, number(0), der(0x30, oid(RSA), der(5)), der(4, der(0x30, number(0), number(1 << 1023))))
    contents = {
        "chain.pem": b"text\n" + pem("CERTIFICATE", certificate(RSA_INFO, "2a864886f70d010105")) + pem("CERTIFICATE", certificate(UNKNOWN, "608648016503040312")),
        "csr.pem": pem("CERTIFICATE REQUEST", certificate(EC_INFO, "2a8648ce3d040302", True)), "bare.der": certificate(EC_INFO, "2b6570"), "pub.der": RSA_INFO,
        "keys.pem": pem("RSA PRIVATE KEY", b"junk") + pem("PRIVATE KEY", pkcs8) + pem("PRIVATE KEY", der(0x30, number(0), der(0x30, oid("608648016503040312")), der(4))) + pem("OPENSSH PRIVATE KEY", ssh) + pem("ENCRYPTED PRIVATE KEY", b"x"),
        "ec.pem": pem("EC PRIVATE KEY", der(0x30, number(1), der(4, b"k"), der(0xA0, oid("2a8648ce3d030107")))), "rsapub.pem": pem("RSA PUBLIC KEY", der(0x30, number(1 << 4095), number(3))), "bad.pem": b"-----BEGIN CERTIFICATE-----\n!!\n-----END CERTIFICATE-----", "empty.pem": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")
    got = {(r.file_path, r.rule_id, r.key_size, r.line_number) for r in x509.findings(df).collect()}
    pem_lines = contents["chain.pem"].count(b"\n")
    assert pem_lines > 2
    assert got == {
        ("chain.pem", "X509_CERT_PUBKEY_RSA", 2048, 2), ("chain.pem", "X509_CERT_SIG_RSA", None, 2), ("csr.pem", "X509_CSR_PUBKEY_ECDSA", 384, 1), ("csr.pem", "X509_CSR_SIG_ECDSA", None, 1), ("bare.der", "X509_CERT_PUBKEY_ECDSA", 384, 1),
        ("bare.der", "X509_CERT_SIG_ED25519", None, 1), ("pub.der", "X509_PUBLIC_KEY_RSA", 2048, 1), ("keys.pem", "X509_PRIVATE_KEY_RSA", None, 1), ("keys.pem", "X509_PRIVATE_KEY_RSA", 1024, 4),
        ("keys.pem", "X509_PRIVATE_KEY_RSA", None, contents["keys.pem"][: contents["keys.pem"].index(b"-----BEGIN OPENSSH")].count(b"\n") + 1), ("ec.pem", "X509_PRIVATE_KEY_ECDSA", 256, 1), ("rsapub.pem", "X509_PUBLIC_KEY_RSA", 4096, 1),
    }
    assert "weak today" in x509.findings(df).where("file_path = 'chain.pem' and rule_id like '%SIG%'").first().message


def test_truth_and_settings(spark, tmp_path, monkeypatch):
    path = tmp_path / "truth.yaml"
    path.write_text("instances:\n- {id: a, file: x.py, line: 3, algorithm: RSA, severity: [high]}\nforbidden:\n- {file: y.go, line: 1, line_end: 4, reason: r, allow: {quantum_safety: safe, max_severity: low}}\ndeps:\n  expect:\n  - {manifest: go.mod, package: p, algorithms_include: [RSA, DES]}\n")
    loaded = truth.load_truth(spark, str(path))
    assert loaded["instances"].first().language == "python" and loaded["forbidden"].first().allow_safety == ["safe"] and loaded["expected"].first().algorithms_include == ["RSA", "DES"] and loaded["excluded"].count() == 0
    for bad in ("nonsense: 1\n", "instances:\n- {id: a, file: x}\n", "instances:\n- {id: a, file: x, algorithm: y}\n- {id: a, file: x, algorithm: y}\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            truth.load_truth(spark, str(path))
    (tmp_path / ".cryptolode.yaml").write_text("severity_threshold: low\nexit_on: high\noutput_format: json\n")
    monkeypatch.setenv("CRYPTOLODE_EXIT_ON", "critical")
    (tmp_path / "sub").mkdir()
    settings = truth.Config.load(str(tmp_path / "sub"), output_format="md")
    assert (settings.severity_threshold, settings.exit_on, settings.output_format, settings.baseline) == ("low", "critical", "md", "")
