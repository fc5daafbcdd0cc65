"""Scalar functions of findings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels too general to be a class
GENERIC_LABELS = ("TLS", "CIPHER", "HASH", "HMAC", "MAC", "RNG", "SIGNATURE", "ANY", "UNKNOWN", "NA")
# fixed values: labels and the class that each stands for
CLASS_ALIASES = {
    "3DES": "DES",
    "TRIPLEDES": "DES",
    "DES_EDE3": "DES",
    "SHA-1": "SHA1",
    "SHA-2": "SHA2",
    "SHA-256": "SHA256",
    "SHA-384": "SHA384",
    "SHA-512": "SHA512",
    "SHA-3": "SHA3",
    "SHA-3-256": "SHA3",
    "SHA3-256": "SHA3",
    "CURVE25519": "X25519",
    "AES-GCM": "AES",
    "AES-CBC": "AES",
    "AES-CCM": "AES",
}
# fixed values: endings that don't make another class: sizes, curves, paddings, digests
CLASS_ENDINGS = r"[-_](1024|2048|3072|4096|512|256|224|384|P256|P384|P521|K1|R1|OAEP|PKCS1V15|PSS)$|-(MD5|SHA1|SHA256|SHA384|SHA512)$"
# fixed values: classes that are known as they stand
KNOWN_CLASSES = (
    "RSA ECDSA ECDH ECC DSA DH DES RC4 RC2 MD5 MD4 MD2 SHA1 SHA2 SHA3 SHA256 SHA384 SHA512 AES "
    "ML-KEM ML-DSA SLH-DSA FALCON ED25519 X25519 POLY1305 CHACHA20 BCRYPT ARGON2 PBKDF2 X509"
).split()


def strip(text: Column) -> Column:
    """Text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def mapped(value: Column, pairs: dict) -> Column:
    """The mapped value, or null."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[value]


def class_key(algorithm: Column) -> Column:
    """The class under which findings of an algorithm meet; empty for general and unknown labels."""
    a = F.upper(strip(F.coalesce(algorithm, F.lit(""))))
    cut = F.regexp_replace(a, CLASS_ENDINGS, "")
    return (
        F.when((a == "") | a.isin(*GENERIC_LABELS), F.lit(""))
        .when(a.isin(*CLASS_ALIASES), mapped(a, CLASS_ALIASES))
        .when(cut != a, cut)
        .when(a.isin(*KNOWN_CLASSES), a)
        .otherwise(F.lit(""))
    )


def alnum_key(label: Column) -> Column:
    """ASCII letters and digits of a label, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(label, F.lit("")), "[^A-Za-z0-9]", ""))


def normal_algorithm(label: Column) -> Column:
    """alnum_key, with all names of triple DES as one."""
    key = alnum_key(label)
    return F.when(key.isin("TRIPLEDES", "DESEDE", "TDEA"), F.lit("3DES")).otherwise(key)


def rule_segment(name: Column) -> Column:
    """A name as part of a rule id: a character of n bytes beyond letters and digits becomes n underscores."""
    two = F.regexp_replace(name, "[\u0080-߿]", "__")
    three = F.regexp_replace(two, "[ࠀ-￿]", "___")
    four = F.regexp_replace(three, "[^\u0000-￿]", "____")
    return F.upper(F.regexp_replace(four, "[^A-Za-z0-9]", "_"))


def confidence_or_half(confidence: Column) -> Column:
    return F.when(confidence > 0, confidence).otherwise(F.lit(0.5))


def noisy_or(confidence: Column, cap: float = 0.99) -> Column:
    """Aggregate: the chance that one of independent signals is true; of none, 0."""
    p = F.least(confidence_or_half(confidence), F.lit(1.0))
    none = F.product(1 - p)
    return F.when(none.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(cap), 1 - none))


def fingerprint(rule_id: Column, path: Column, snippet: Column, line: Column) -> Column:
    """What identifies a finding when lines move: rule, file and trimmed snippet, or the line if there is none."""
    text = strip(F.coalesce(snippet, F.lit("")))
    text = F.when(text == "", F.concat(F.lit("L"), line.cast("string"))).otherwise(text)
    return F.sha2(F.concat(rule_id, F.lit("\0"), path, F.lit("\0"), text, F.lit("\0")), 256)


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def directory(path: Column) -> Column:
    """All before the last slash, or `.`."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def finding_key(finding_id: Column, path: Column, line: Column, column: Column, rule_id: Column, algorithm: Column, severity: Column) -> Column:
    """The id, or what stands for it in findings without one."""
    parts = F.concat_ws("|", normal_path(path), line.cast("string"), column.cast("string"), rule_id, F.upper(algorithm), severity)
    return F.when(F.coalesce(finding_id, F.lit("")) != "", F.concat(F.lit("id:"), finding_id)).otherwise(parts)


def round2(value: Column) -> Column:
    """Two places, half away from zero in binary arithmetic."""
    return F.round(value * 100) / 100


def bands(value: Column, steps: list[tuple[float, object]], below: object) -> Column:
    """The label of the first step that the value reaches."""
    out = F.lit(below)
    for least, label in reversed(steps):
        out = F.when(value >= least, F.lit(label)).otherwise(out)
    return out


def blast_radius(transitive: Column, direct: Column, siblings: Column) -> Column:
    return 3 * transitive + direct + siblings


def impact_band(radius: Column) -> Column:
    return bands(radius, [(200, "Catastrophic"), (50, "High"), (10, "Medium")], "Low")


def quantum_safety(named: Column, legacy_safe: Column) -> Column:
    """A rule's class: as named, else by its older flag, else vulnerable."""
    return F.when(F.coalesce(named, F.lit("")) != "", named).when(F.coalesce(legacy_safe, F.lit(False)), F.lit("quantum_safe")).otherwise(F.lit("vulnerable"))


def rule_confidence(confidence: Column, detector: Column) -> Column:
    """A rule's confidence; of rules without one, by detector."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) == 0, F.when(detector == "ast", F.lit(0.95)).otherwise(F.lit(0.7))).otherwise(confidence)


def dependency_safety(algorithm: Column, ready: Column) -> Column:
    """The quantum-safety class of an algorithm that a dependency has."""
    # fixed values: labels by class; all others are vulnerable
    broken = ("md5", "md4", "md2", "sha-1", "sha1", "rc4", "rc2", "des", "ripemd", "ripemd160", "ripemd-160")
    weakened = ("3des", "tripledes", "desede", "aes-128", "aes128", "blowfish")
    a = F.lower(algorithm)
    return F.when(ready, F.lit("quantum_safe")).when(a.isin(*broken), F.lit("classically_broken")).when(a.isin(*weakened), F.lit("grover_weakened")).otherwise(F.lit("vulnerable"))


def sarif_level(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin("critical", "high"), F.lit("error")).when(s == "medium", F.lit("warning")).otherwise(F.lit("note"))


def security_severity(severity: Column) -> Column:
    # fixed values: the numbers that code-scanning services sort alerts by
    return F.coalesce(mapped(F.lower(severity), {"critical": "9.5", "high": "8.1", "medium": "5.5", "low": "3.0"}), F.lit("1.0"))


def severity_of_level(level: Column) -> Column:
    """Severity of a report's level where the report has no severity itself."""
    return F.when(level == "error", F.lit("high")).when(level == "warning", F.lit("medium")).when(level == "note", F.lit("low")).otherwise(F.lit("info"))


def shorten(text: Column, most: int = 400) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def check_conclusion(mode: Column, any_critical: Column) -> Column:
    return F.when((mode == "block") & any_critical, F.lit("failure")).otherwise(F.lit("neutral"))


def is_library_rule(rule_id: Column) -> Column:
    """Whether a rule reports that a library is imported, by its id."""
    return F.upper(rule_id).rlike("_(IMPORT|REQUIRE|USE|OPEN)(_|$)")


def library_of(rule_id: Column) -> Column:
    """The library that such a rule's id names: what follows the first mark in the order of marks, or else what is
    before a mark at the end, without the id's first part."""
    rule, out = F.upper(rule_id), None
    for mark in ("_IMPORT_", "_REQUIRE_", "_USE_", "_OPEN_"):
        at = F.instr(rule, mark)
        tail = F.substring(rule, at + len(mark), F.length(rule))
        out = F.when(at > 0, tail) if out is None else out.when(at > 0, tail)
    body = F.regexp_replace(rule, "_(IMPORT|REQUIRE|USE|OPEN)$", "")
    inner = F.when(F.contains(body, F.lit("_")), F.regexp_replace(body, "^[^_]*_", "")).otherwise(body)
    return out.when(rule.rlike("_(IMPORT|REQUIRE|USE|OPEN)$"), inner).otherwise(F.lit(""))


def is_hardcoded(category: Column, rule_id: Column) -> Column:
    return F.contains(F.lower(category), F.lit("hardcoded")) | F.contains(F.upper(rule_id), F.lit("HARDCODED"))


# fixed values: name part, and prices of a thousand input and output tokens; the last is for all other models
TOKEN_PRICES = [
    ("gpt-4o-mini", "0.000150", "0.000600"),
    ("gpt-4o", "0.002500", "0.010000"),
    ("gpt-4.1", "0.002000", "0.008000"),
    ("gpt-3.5", "0.000500", "0.001500"),
    ("claude-haiku", "0.000250", "0.001250"),
    ("claude-sonnet", "0.003000", "0.015000"),
    ("claude-opus", "0.015000", "0.075000"),
    ("gemini-1.5-flash", "0.000075", "0.000300"),
    ("gemini-1.5-pro", "0.001250", "0.005000"),
    ("", "0.001", "0.003"),
]


def token_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of a model call, by the first entry of TOKEN_PRICES whose name part the model's name contains."""
    out = None
    for part, into, outof in reversed(TOKEN_PRICES):
        each = [n.cast("decimal(12,0)") * F.lit(price).cast("decimal(8,6)") for n, price in ((input_tokens, into), (output_tokens, outof))]
        cost = F.bround((each[0] + each[1]) / F.lit(1000).cast("decimal(4,0)"), 6).cast("decimal(18,6)")
        out = cost if out is None else F.when(F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit(part)), cost).otherwise(out)
    return out
