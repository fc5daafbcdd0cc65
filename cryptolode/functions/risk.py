"""Risk and priority scores, as columns; formulas are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bands, mapped

#: The context that a service without settings assumes.
SERVICE_CONTEXT = {"environment": "production", "exposure": "internal", "data_sensitivity": "confidential", "business_criticality": "high", "runtime_activity": "unknown"}

# fixed values: points of each factor and its weight
ALGORITHM_POINTS = {"MD5": 9, "SHA1": 7, "RC4": 9, "DES": 8, "3DES": 8, "RSA": 8, "DSA": 8, "ECC": 8, "ECDSA": 8, "ECDH": 8, "AES": 4, "AES-CBC": 5, "AES-ECB": 7, "TLS": 6}
USAGE_POINTS = {"key_exchange": 9, "signing": 8, "key_storage": 8, "key_generation": 8, "encryption": 7, "tls_config": 7, "hashing": 5, "test_helper": 2}
EXPOSURE_POINTS = {"public": 10, "partner": 8, "internal": 5, "dev": 2}
SENSITIVITY_POINTS = {"regulated": 10, "confidential": 7, "internal": 4, "public": 1}
ENVIRONMENT_POINTS = {"production": 10, "staging": 6, "dev": 3, "test": 1}
BUSINESS_POINTS = {"critical": 10, "high": 7, "medium": 4, "low": 2}
ACTIVITY_POINTS = {"active": 10, "inactive": 2}
CONTROL_POINTS = {"hsm": 3, "vault": 2, "key_rotation": 1}
COMPLIANCE_TAGS = ("pci", "pci-dss", "hipaa", "fedramp", "soc2")
WEIGHTS = {"algorithm": 1.0, "usage": 1.2, "exposure": 1.5, "sensitivity": 1.3, "environment": 1.4, "business": 1.0, "activity": 0.8, "compliance": 0.6, "controls": 1.0}


def points(value: Column, table: dict[str, int], otherwise: int) -> Column:
    return F.coalesce(mapped(F.lower(value), table), F.lit(otherwise))


def algorithm_points(algorithm: Column, key_size: Column, quantum_safety: Column) -> Column:
    label = F.upper(algorithm)
    base = F.coalesce(mapped(label, ALGORITHM_POINTS), F.lit(5))
    base = F.when((label == "RSA") & (key_size < 2048), F.least(F.lit(10), base + 2)).otherwise(base)
    safety = F.lower(quantum_safety)
    return (
        F.when(safety == "quantum_safe", F.least(base, F.lit(2)))
        .when(safety == "hybrid", F.least(base, F.lit(5)))
        .when(safety == "grover_weakened", F.least(base, F.lit(6)))
        .when(safety == "classically_broken", F.greatest(base, F.lit(7)))
        .otherwise(base)
    )


def risk_score_v1(
    algorithm: Column, key_size: Column, quantum_safety: Column, usage_type: Column, exposure: Column, data_sensitivity: Column, environment: Column,
    business_criticality: Column, runtime_activity: Column, compliance: Column, controls: Column, excepted: Column,
) -> Column:
    """0 to 100. compliance and controls are arrays of tags; an active exception makes the score 0."""
    tagged = F.arrays_overlap(F.transform(compliance, F.lower), F.array(*map(F.lit, COMPLIANCE_TAGS)))
    credit = F.least(F.lit(6), F.aggregate(F.transform(controls, lambda c: F.coalesce(mapped(F.lower(c), CONTROL_POINTS), F.lit(0))), F.lit(0), lambda a, b: a + b))
    factors = {
        "algorithm": algorithm_points(algorithm, key_size, quantum_safety),
        "usage": points(usage_type, USAGE_POINTS, 5),
        "exposure": points(exposure, EXPOSURE_POINTS, 5),
        "sensitivity": points(data_sensitivity, SENSITIVITY_POINTS, 4),
        "environment": points(environment, ENVIRONMENT_POINTS, 5),
        "business": points(business_criticality, BUSINESS_POINTS, 4),
        "activity": points(runtime_activity, ACTIVITY_POINTS, 5),
        "compliance": F.when(F.coalesce(tagged, F.lit(False)), F.lit(8)).otherwise(F.lit(0)),
        "controls": -F.coalesce(credit, F.lit(0)),
    }
    raw = None
    for name, value in factors.items():
        part = value * F.lit(WEIGHTS[name])
        raw = part if raw is None else raw + part
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int")
    return F.when(F.coalesce(excepted, F.lit(False)), F.lit(0)).otherwise(score)


def service_score(algorithm: Column, key_size: Column, quantum_safety: Column, usage_type: Column) -> Column:
    """risk_score_v1 in the assumed context."""
    c = {k: F.lit(v) for k, v in SERVICE_CONTEXT.items()}
    none = F.array().cast("array<string>")
    return risk_score_v1(algorithm, key_size, quantum_safety, usage_type, c["exposure"], c["data_sensitivity"], c["environment"], c["business_criticality"], c["runtime_activity"], none, none, F.lit(False))


def risk_level(score: Column) -> Column:
    return bands(score, [(90, "Severe"), (75, "Critical"), (55, "High"), (35, "Medium"), (15, "Low")], "Safe")


#: Formulas by version: functions from columns to a column.
FORMULAS: dict[str, Callable[..., Column]] = {"v1": risk_score_v1}


def severity_points(severity: Column) -> Column:
    return F.coalesce(mapped(severity, {"critical": 25, "high": 20, "medium": 12, "low": 6, "info": 2}), F.lit(6))


def impact_points(band: Column, radius: Column) -> Column:
    reached = bands(radius, [(200, 35), (50, 28), (10, 16), (1, 5)], 0)
    low = F.when(radius > 0, F.lit(5)).otherwise(F.lit(0))
    return F.when(band == "Low", low).otherwise(F.coalesce(mapped(band, {"Catastrophic": 35, "High": 28, "Medium": 16}), reached))


def priority_score(severity: Column, confidence: Column, corroboration: Column, band: Column, radius: Column, agility: Column) -> Column:
    sure = F.round(confidence * 20).cast("int") + F.when(corroboration > 1, (corroboration - 1) * 3).otherwise(F.lit(0))
    rigid = F.least(F.lit(10), F.greatest(F.lit(0), F.floor((100 - agility) / 10).cast("int")))
    return F.least(F.lit(100), severity_points(severity) + F.least(F.lit(25), sure) + impact_points(band, radius) + rigid).cast("int")


def priority_band(score: Column) -> Column:
    return bands(score, [(80, "Immediate"), (60, "Scheduled"), (40, "Backlog")], "Monitor")
