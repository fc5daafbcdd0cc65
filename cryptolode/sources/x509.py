"""Certificates and keys as findings: PEM blocks and bare DER, read as far as their algorithms.

A small reader of DER finds object identifiers and key sizes; unknown algorithms are never reported, since they may be
the post-quantum ones. Files are read in one Arrow pass; a block that can't be read gives nothing, but a typed block of an
old kind names its algorithm itself.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATERIAL = "path string, rule_id string, algorithm string, key_size int, usage_type string, line_number int, detail string"
BLOCK = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----\s*(.*?)-----END \1-----", re.S)
# fixed values: object identifiers (in hex of DER) of key algorithms, curves and signatures
KEYS = {"2a864886f70d010101": "RSA", "2a864886f70d01010a": "RSA", "2a8648ce3d0201": "ECDSA", "2a8648ce380401": "DSA", "2b6570": "Ed25519", "2b656e": "ECDH"}
CURVES = {"2b81040021": ("P-224", 224), "2a8648ce3d030107": ("P-256", 256), "2b81040022": ("P-384", 384), "2b81040023": ("P-521", 521)}
SIGNATURES = {
    "2a864886f70d010102": ("RSA", "md2WithRSAEncryption"),
    "2a864886f70d010104": ("RSA", "md5WithRSAEncryption"),
    "2a864886f70d010105": ("RSA", "sha1WithRSAEncryption"),
    "2a864886f70d01010b": ("RSA", "sha256WithRSAEncryption"),
    "2a864886f70d01010c": ("RSA", "sha384WithRSAEncryption"),
    "2a864886f70d01010d": ("RSA", "sha512WithRSAEncryption"),
    "2a864886f70d01010a": ("RSA", "RSASSA-PSS"),
    "2a8648ce380403": ("DSA", "dsaWithSHA1"),
    "608648016503040302": ("DSA", "dsaWithSHA256"),
    "2a8648ce3d0401": ("ECDSA", "ecdsa-with-SHA1"),
    "2a8648ce3d040302": ("ECDSA", "ecdsa-with-SHA256"),
    "2a8648ce3d040303": ("ECDSA", "ecdsa-with-SHA384"),
    "2a8648ce3d040304": ("ECDSA", "ecdsa-with-SHA512"),
    "2b6570": ("Ed25519", "Ed25519"),
}
SSH_KEYS = {b"ssh-rsa": "RSA", b"ssh-dss": "DSA", b"ssh-ed25519": "Ed25519", b"ecdsa-sha2-nistp256": "ECDSA", b"ecdsa-sha2-nistp384": "ECDSA", b"ecdsa-sha2-nistp521": "ECDSA"}


def values(data: bytes) -> list[tuple[int, bytes]]:
    """Tag and content of the DER values that stand one after another."""
    out, at = [], 0
    while at < len(data):
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            raise ValueError("a value is cut off")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def inside(data: bytes) -> list[tuple[int, bytes]]:
    """The values inside the one value that data is."""
    return values(values(data)[0][1])


def bits(number: bytes) -> int:
    return int.from_bytes(number, "big").bit_length()


def identified(algorithm: bytes, key: bytes | None) -> tuple[str, int | None] | None:
    """Algorithm and size by an AlgorithmIdentifier's content; key: DER of an RSA public key or of its numbers."""
    parts = values(algorithm)
    name = KEYS.get(parts[0][1].hex())
    if name == "RSA":
        numbers = inside(key) if key else []
        return name, bits(numbers[0][1]) if numbers else None
    if name == "ECDSA":
        return name, CURVES.get(parts[1][1].hex(), ("", None))[1] if len(parts) > 1 else None
    if name == "DSA":
        return name, bits(values(parts[1][1])[0][1]) if len(parts) > 1 and parts[1][1] else None
    return (name, None) if name else None


def public_key(info: bytes) -> tuple[str, int | None] | None:
    """Of a SubjectPublicKeyInfo's content."""
    algorithm, key = values(info)[:2]
    return identified(algorithm[1], key[1][1:])


def signature(algorithm: bytes) -> tuple[str, str] | None:
    return SIGNATURES.get(values(algorithm)[0][1].hex())


def row(kind: str, found: tuple[str, int | None] | None, usage: str, detail: str = "") -> list[tuple]:
    return [(f"X509_{kind}_{found[0].upper()}", found[0], found[1], usage, detail)] if found else []


def certificate(der: bytes, request: bool) -> list[tuple]:
    body, signed = inside(der)[:2]
    fields = values(body[1])
    if not request and fields[0][0] == 0xA0:
        fields = fields[1:]  # the version
    info = fields[2] if request else fields[5]
    kind, who = ("CSR", "") if request else ("CERT", "self-issued" if fields[2][1] == fields[4][1] else "")
    named = signature(signed[1])
    return row(f"{kind}_PUBKEY", public_key(info[1]), "certificate", who) + row(f"{kind}_SIG", (named[0], None) if named else None, "certificate", named[1] if named else "")


def private_key(kind: str, der: bytes) -> list[tuple]:
    typed = {"RSA PRIVATE KEY": "RSA", "EC PRIVATE KEY": "ECDSA", "DSA PRIVATE KEY": "DSA"}.get(kind)
    if typed:
        size = None
        try:
            parts = inside(der)
            if typed == "RSA":
                size = bits(parts[1][1])
            elif typed == "ECDSA":
                size = next((CURVES.get(values(x)[0][1].hex(), ("", None))[1] for tag, x in parts if tag == 0xA0), None)
        except (ValueError, IndexError):
            pass  # an encrypted body: the kind of block says what it is
        return row("PRIVATE_KEY", (typed, size), "key_storage")
    if kind == "OPENSSH PRIVATE KEY":
        name = next((v for k, v in SSH_KEYS.items() if k in der[:400]), "SSH")
        return row("PRIVATE_KEY", (name, None), "key_storage")
    _, algorithm, key = inside(der)[:3]
    found = identified(algorithm[1], None)
    if found and found[0] == "RSA":
        found = ("RSA", bits(inside(key[1])[1][1]))
    return row("PRIVATE_KEY", found, "key_storage")


def material(kind: str, der: bytes) -> list[tuple]:
    """(rule_id, algorithm, key_size, usage_type, detail) of a block; nothing if it is unknown or can't be read."""
    try:
        if kind.endswith("CERTIFICATE REQUEST"):
            return certificate(der, True)
        if kind.endswith("CERTIFICATE"):
            return certificate(der, False)
        if kind == "PUBLIC KEY":
            return row("PUBLIC_KEY", public_key(values(der)[0][1]), "key_storage")
        if kind == "RSA PUBLIC KEY":
            return row("PUBLIC_KEY", ("RSA", bits(inside(der)[0][1])), "key_storage")
        if kind in ("RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"):
            return private_key(kind, der)
    except (ValueError, IndexError):
        pass
    return []


def scan(files: DataFrame) -> DataFrame:
    """files (path, content: binary) of certificates and keys, a row for each algorithm in use. A block's line is that
    of its first mark; a file without blocks is tried as a certificate, then as a public key."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                content = bytes(content or b"")
                blocks = list(BLOCK.finditer(content))
                for m in blocks:
                    body = b"".join(x for x in m[2].splitlines() if b":" not in x)
                    try:
                        der = base64.b64decode(body, validate=False)
                    except binascii.Error:
                        der = b""
                    out += [(path, r, a, n, u, content.count(b"\n", 0, m.start()) + 1, d) for r, a, n, u, d in material(m[1].decode(), der)]
                if not blocks and content:
                    bare = material("CERTIFICATE", content) or material("PUBLIC KEY", content)
                    out += [(path, r, a, n, u, 1, d) for r, a, n, u, d in bare]
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in MATERIAL.split(", ")])
            yield frame.assign(key_size=frame["key_size"].astype("Int32"))

    return files.select("path", "content").mapInPandas(found, MATERIAL)


def findings(files: DataFrame) -> DataFrame:
    """The rows as findings: all of these algorithms fall to quantum computers."""
    weak = F.lower("detail").rlike("md2|md5|sha1")
    cwe = F.when(F.startswith(F.col("rule_id"), F.lit("X509_PRIVATE")), F.array(F.lit(327), F.lit(798))).otherwise(F.array(F.lit(327)))
    message = F.concat("algorithm", F.when(F.col("key_size").isNotNull(), F.concat(F.lit("-"), "key_size")).otherwise(""), F.lit(", which is quantum-vulnerable"), F.when(weak, F.lit("; its digest is weak today")).otherwise(""))
    return scan(files).select(
        "rule_id", F.lit("x509").alias("language"), "algorithm", "key_size", "usage_type", F.lit("vulnerable").alias("quantum_safety"), F.lit("critical").alias("severity"), F.lit("certificate").alias("category"),
        F.col("path").alias("file_path"), "line_number", F.lit(1).alias("column"), F.lit(0.99).alias("confidence"), message.alias("message"), cwe.alias("cwe"), "detail",
    )
