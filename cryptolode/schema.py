"""The findings relation, the rule relation, and the orders of severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
}


def _schema(fields: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


FINDING_SCHEMA = _schema(
    "finding_id string, scan_job_id string, rule_id string, language string, algorithm string, usage_type string, category string, "
    "message string, quantum_safety string, severity string, key_size int, file_path string, line_number int, column int, snippet string, "
    "snippet_context array<string>, confidence double, recommendation string, migration_target string, vertical_context string, "
    "references array<string>, cwe array<int>, git_blame_author string, git_blame_commit string, detected_at timestamp, delta_state string"
)
#: Order columns that a finding carries beside its fields: rule-major within a file, then line, then match.
ORDER_COLUMNS = ("rule_ordinal", "line_number", "match_ordinal")

RULE_SCHEMA = _schema(
    "rule_ordinal int, rule_id string, language string, category string, layer string, severity string, algorithm string, usage_type string, "
    "quantum_safe boolean, quantum_safety string, key_size int, detector_type string, pattern string, query string, flags string, message string, "
    "recommendation string, references array<string>, cwe array<int>, confidence double, file_globs array<string>, "
    "examples_match array<string>, examples_no_match array<string>"
)

# fixed values: severities from the lowest, and quantum-safety classes that count as a risk
SEVERITIES = ("info", "low", "medium", "high", "critical")
RISK_TAGGED = ("vulnerable", "grover_weakened", "classically_broken")


def severity_rank(severity: Column, lowest: int = 0, unknown: int = 0) -> Column:
    """Rank of a severity from `lowest` for info; other strings, and null, rank `unknown`."""
    rank = F.lit(unknown)
    for n, name in reversed(list(enumerate(SEVERITIES, lowest))):
        rank = F.when(severity == name, F.lit(n)).otherwise(rank)
    return rank


def fusion_rank(severity: Column) -> Column:
    return severity_rank(severity, lowest=1)


def threshold_rank(severity: Column) -> Column:
    return severity_rank(severity)


def gate_rank(severity: Column) -> Column:
    """As thresholds have it, but an unknown severity is above all."""
    return severity_rank(F.lower(F.trim(severity)), unknown=5)


def is_risk(quantum_safety: Column) -> Column:
    return F.lower(F.trim(quantum_safety)).isin(*RISK_TAGGED)


def complete(findings: DataFrame) -> DataFrame:
    """All fields of FINDING_SCHEMA: absent strings are empty, other absent fields null; a missing id is a digest of
    where and what was found, so that recomputing a row gives the same id."""
    have = set(findings.columns)
    columns = []
    for f in FINDING_SCHEMA.fields:
        column = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        columns.append((F.coalesce(column, F.lit("")) if isinstance(f.dataType, T.StringType) else column).alias(f.name))
    out = findings.select(*columns, *[c for c in findings.columns if c not in FINDING_SCHEMA.names])
    made = F.sha2(F.concat_ws("\0", "rule_id", "file_path", "line_number", "column", "snippet", "algorithm"), 256)
    return out.withColumn("finding_id", F.when(F.col("finding_id") == "", made).otherwise(F.col("finding_id")))
