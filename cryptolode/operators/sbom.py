"""Dependencies as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dependency_safety, rule_segment

CONFIDENCE = 0.7
LIBRARY_SCHEMA = "ecosystem string, package string, algorithms array<string>, severity string, category string, deprecated boolean, pq_ready boolean, notes string"


def knowledge(spark: SparkSession, path: str | None = None) -> DataFrame:
    """What packages implement, from a YAML list."""
    from pathlib import Path

    import yaml

    rows = yaml.safe_load((Path(path) if path else Path(__file__).parent.parent / "knowledge" / "libraries.yaml").read_text())
    return spark.createDataFrame(
        [(r["ecosystem"], r["package"], r["algorithms"], r.get("severity", "info"), r.get("category", "crypto-dependency"), bool(r.get("deprecated")), bool(r.get("pq_ready")), r.get("notes", "")) for r in rows],
        LIBRARY_SCHEMA,
    )


def fan_out(dependencies: DataFrame, libraries: DataFrame) -> DataFrame:
    """dependencies (ecosystem, package, version, manifest, line) that are known, a finding for each algorithm.

    libraries is a reference table; the planner broadcasts it while its size allows.
    """
    known = libraries.withColumn("name", F.lower("package")).drop("package")
    joined = dependencies.withColumn("name", F.lower("package")).join(known, ["ecosystem", "name"])
    each = joined.withColumn("algorithm", F.explode("algorithms"))
    safety = dependency_safety(F.col("algorithm"), F.col("pq_ready"))
    risk = F.when(safety == "grover_weakened", F.lit("weakened by Grover's algorithm")).when(safety == "classically_broken", F.lit("broken today")).otherwise(F.lit("quantum-vulnerable"))
    message = (
        F.when(F.col("pq_ready"), F.format_string("%s (%s) has post-quantum %s: a target, not a risk. %s", "package", "version", "algorithm", "notes"))
        .when(F.col("deprecated"), F.format_string("%s (%s) is deprecated and has %s. %s", "package", "version", "algorithm", "notes"))
        .otherwise(F.format_string("%s (%s) has %s, which is %s.", "package", "version", "algorithm", risk))
    )
    rule = F.concat_ws("_", F.lit("SBOM"), F.upper("ecosystem"), rule_segment(F.col("package")), rule_segment(F.col("algorithm")))
    return each.select(
        rule.alias("rule_id"), F.col("ecosystem").alias("language"), "algorithm", F.lit("dependency").alias("usage_type"), safety.alias("quantum_safety"),
        F.when(F.coalesce("severity", F.lit("")) == "", F.lit("info")).otherwise(F.col("severity")).alias("severity"), F.col("manifest").alias("file_path"),
        F.col("line").alias("line_number"), F.lit(1).alias("column"), F.concat("package", F.lit("@"), "version").alias("snippet"), F.lit(CONFIDENCE).alias("confidence"),
        "category", message.alias("message"), "package",
    )
