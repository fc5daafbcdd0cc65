"""Recorded TLS observations as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip

OBSERVATION_SCHEMA = "endpoint string, version string, cipher string, key_alg string, key_bits int, sig_alg string, not_after timestamp, subject string, issuer string, accepts_tls10 boolean, accepts_tls11 boolean"
# fixed values: parts of weak suites' names, what they mean, severity, quantum safety; the first that fits counts
WEAK_CIPHERS = [
    ("_RC4_", "RC4", "critical", "classically_broken"),
    ("_3DES_", "3DES", "critical", "grover_weakened"),
    ("_DES_", "DES", "critical", "classically_broken"),
    ("_NULL_", "NULL", "critical", "classically_broken"),
    ("_CBC_", "CBC", "medium", "vulnerable"),
]
DAY = 86400


def target(text: Column) -> tuple[Column, Column]:
    """Host and port (443 if none) of an address, without scheme and path; brackets hold addresses of version 6."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"/.*$", "")
    host = F.coalesce(F.nullif(F.regexp_extract(bare, r"^\[([^\]]*)\]", 1), F.lit("")), F.regexp_extract(bare, r"^([^:]*)", 1))
    return host, F.coalesce(F.nullif(F.regexp_extract(bare, r"(?:^\[[^\]]*\]|^[^:\[]*):([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(443))


def weak_cipher(name: Column) -> Column:
    """struct(algorithm, severity, quantum_safety) of a weak suite, else null."""
    return F.coalesce(*[F.when(F.contains(F.upper(name), F.lit(part)), F.struct(F.lit(a).alias("algorithm"), F.lit(s).alias("severity"), F.lit(q).alias("quantum_safety"))) for part, a, s, q in WEAK_CIPHERS])


def findings(observations: DataFrame, as_of: Column) -> DataFrame:
    """rule_id, algorithm, severity, quantum_safety, category, usage_type, confidence, file_path and snippet of each
    observation's problems: one pass, each row giving an array."""

    def row(when: Column, rule: str, algorithm: Column, severity: Column, safety: str, category: str, usage: str, confidence: float, snippet: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule_id"), algorithm.alias("algorithm"), severity.alias("severity"), F.lit(safety).alias("quantum_safety"), F.lit(category).alias("category"), F.lit(usage).alias("usage_type"), F.lit(confidence).alias("confidence"), snippet.alias("snippet")))

    key, sig, left = F.col("key_alg"), F.col("sig_alg"), F.col("not_after").cast("double") - as_of.cast("double")
    weak = weak_cipher(F.col("cipher"))
    classical = (key == "RSA") | F.startswith(key, F.lit("ECDSA")) | (key == "DSA")
    sized = F.concat(F.lit("RSA-"), F.col("key_bits").cast("string"))
    none = F.lit("")
    found = [
        row(F.col("accepts_tls10"), "TLS_VERSION_TLS10", F.lit("TLS 1.0"), F.lit("critical"), "vulnerable", "weak-protocol", "transport", 1.0, F.lit("server accepts TLS 1.0")),
        row(F.col("accepts_tls11"), "TLS_VERSION_TLS11", F.lit("TLS 1.1"), F.lit("high"), "vulnerable", "weak-protocol", "transport", 1.0, F.lit("server accepts TLS 1.1")),
        F.when(weak.isNotNull(), F.struct(F.lit("TLS_WEAK_CIPHER").alias("rule_id"), weak["algorithm"].alias("algorithm"), weak["severity"].alias("severity"), weak["quantum_safety"].alias("quantum_safety"), F.lit("weak-cipher").alias("category"), F.lit("transport").alias("usage_type"), F.lit(1.0).alias("confidence"), F.col("cipher").alias("snippet"))),
        row(classical, "TLS_CERT_CLASSICAL_KEY", key, F.lit("high"), "vulnerable", "crypto-api", "certificate", 0.9, F.concat(key, F.lit(" leaf key"))),
        row((key == "RSA") & (F.col("key_bits") > 0) & (F.col("key_bits") < 2048), "TLS_CERT_RSA_WEAK", sized, F.lit("critical"), "vulnerable", "weak-key-size", "certificate", 1.0, sized),
        row(F.contains(F.lower(sig), F.lit("sha1")), "TLS_CERT_SHA1_SIG", sig, F.lit("high"), "vulnerable", "weak-hash", "signature", 1.0, sig),
        row(left <= 0, "TLS_CERT_EXPIRED", none, F.lit("critical"), "unknown", "cert-validation", "certificate", 1.0, F.lit("expired")),
        row((left > 0) & (left < 30 * DAY), "TLS_CERT_EXPIRING", none, F.when(left < 7 * DAY, F.lit("critical")).otherwise(F.lit("high")), "unknown", "cert-validation", "certificate", 1.0, F.lit("expiring")),
        row(F.col("subject") == F.col("issuer"), "TLS_CERT_SELF_SIGNED", sig, F.lit("medium"), "unknown", "cert-validation", "certificate", 1.0, F.lit("self-signed")),
    ]
    each = observations.select(F.col("endpoint").alias("file_path"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return each.select("f.*", "file_path")
