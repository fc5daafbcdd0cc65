"""Fusion of independent channels' findings, and promotion of weak signals that agree within a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alnum_key, class_key, confidence_or_half, noisy_or
from ..schema import fusion_rank

CLUSTER_COLUMNS = ["algorithm_class", "channels", "corroboration", "confidence", "severity", "findings"]
PROMOTION_CAP = 0.95
# fixed values: categories of signals, and the shape of what is made from them
SIGNAL_CATEGORIES = ("handrolled-crypto", "crypto-fingerprint")
PROMOTED_USAGE = "handrolled"
PROMOTED_RULE = ("HANDROLLED_", "_PROMOTED")


def channels_of(**channels: DataFrame) -> DataFrame:
    """The channels' findings together, with the column `channel`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("channel", F.lit(name)) for name, df in channels.items()))


def clusters(findings: DataFrame, members: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """findings (channel, rule_id, algorithm, severity, confidence, ...) that have a class, one row per class (and group, with `by`).

    All findings of a class count towards its confidence, also several of one channel; severities that are none of the
    known count as empty. With `members`, those columns of the findings are collected into `findings`; without, a class
    of any size stays one small row, since everything is aggregated before the shuffle.
    """
    own = findings.withColumn("algorithm_class", class_key(F.col("algorithm"))).where("algorithm_class <> ''")
    rank = fusion_rank(F.col("severity"))
    worst = F.max(F.when(rank > 0, F.struct(rank.alias("rank"), F.col("severity").alias("name"))))["name"]
    extra = [F.collect_list(F.struct(*members)).alias("findings")] if members else []
    return own.groupBy(*by, "algorithm_class").agg(
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.countDistinct("channel").cast("int").alias("corroboration") if not members else F.size(F.collect_set("channel")).alias("corroboration"),
        noisy_or(F.col("confidence")).alias("confidence"),
        F.coalesce(worst, F.lit("")).alias("severity"),
        F.count("*").alias("n_findings"),
        *extra,
    )


def passthrough(findings: DataFrame, members: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings without a class, each a cluster of its own."""
    own = findings.where(class_key(F.col("algorithm")) == "")
    extra = [F.array(F.struct(*members)).alias("findings")] if members else []
    return own.select(
        *by, F.concat(F.lit("UNCLASSIFIED:"), "rule_id").alias("algorithm_class"), F.array("channel").alias("channels"), F.lit(1).alias("corroboration"),
        confidence_or_half(F.col("confidence")).alias("confidence"), "severity", F.lit(1).cast("long").alias("n_findings"), *extra,
    )


def fuse(findings: DataFrame, members: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """All clusters; order by corroboration (falling), then class."""
    return clusters(findings, members, by).unionByName(passthrough(findings, members, by))


def with_cluster(findings: DataFrame, found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings with their cluster's confidence, corroboration and channels (cluster_*); those without a class are alone.

    `found` (of clusters) has a row per class, so this is a join with a small table and needs no list of members.
    """
    own = found.select(*by, F.col("algorithm_class").alias("_class"), F.col("confidence").alias("_conf"), F.col("corroboration").alias("_corr"), F.col("channels").alias("_chan"))
    joined = findings.withColumn("_class", class_key(F.col("algorithm"))).join(own, [*by, "_class"], "left")
    alone = F.col("_class") == ""
    return joined.select(
        *findings.columns,
        F.when(alone, confidence_or_half(F.col("confidence"))).otherwise(F.col("_conf")).alias("cluster_confidence"),
        F.when(alone, F.lit(1)).otherwise(F.col("_corr")).alias("cluster_corroboration"),
        F.when(alone, F.array("channel")).otherwise(F.col("_chan")).alias("cluster_channels"),
    )


def promote(findings: DataFrame) -> DataFrame:
    """New findings for files in which at least two rules' signals point to one algorithm.

    findings: file_path, rule_id, algorithm, category, usage_type, quantum_safety, confidence, language, line_number,
    column, snippet, and position (the order of emission in the file). RSA and DH signals of a file, which modular
    exponentiation can't tell apart, meet under the label of the most confident of them. Two groupings, by (file, key,
    rule) and by (file, key); a signal that fires often is reduced before the second.
    """
    made = (F.col("usage_type") == PROMOTED_USAGE) | F.col("rule_id").rlike(f"^{PROMOTED_RULE[0]}.*{PROMOTED_RULE[1]}$")
    signals = findings.where(F.col("category").isin(*SIGNAL_CATEGORIES) & ~made).withColumn("key", alnum_key(F.col("algorithm"))).where("key <> ''")
    # the signal that counts: highest confidence, then first
    best = F.struct(F.col("confidence").alias("c"), (-F.col("position")).alias("p"), "algorithm", "quantum_safety")
    first = F.struct(F.col("position").alias("p"), "language", "line_number", "column", "snippet")
    by_rule = signals.groupBy("file_path", "key", "rule_id").agg(F.max(best).alias("best"), F.min(first).alias("first"), F.max("confidence").alias("confidence"))
    pair = F.col("key").isin("RSA", "DH")
    by_file = signals.where(pair).groupBy("file_path").agg(F.countDistinct("key").alias("kinds"), F.max(best).alias("ruling")).where("kinds = 2")
    merged = by_rule.join(by_file.select("file_path", alnum_key(F.col("ruling.algorithm")).alias("ruling")), "file_path", "left")
    merged = merged.withColumn("key", F.when(pair & F.col("ruling").isNotNull(), F.col("ruling")).otherwise(F.col("key")))
    again = merged.groupBy("file_path", "key", "rule_id").agg(F.max("best").alias("best"), F.min("first").alias("first"), F.max("confidence").alias("confidence"))
    counted = F.col("confidence") > 0
    groups = again.groupBy("file_path", "key").agg(
        F.sort_array(F.collect_set(F.when(counted, F.col("rule_id")))).alias("rules"),
        F.least(F.lit(PROMOTION_CAP), 1 - F.product(F.when(counted, 1 - F.least(F.col("confidence"), F.lit(1.0))))).alias("confidence"),
        F.max("best").alias("best"), F.min("first").alias("first"),
    ).where(F.size("rules") >= 2)
    text = F.format_string("%s implemented by hand: %d signals agree in this file (%s), confidence %.2f.", "best.algorithm", F.size("rules"), F.array_join("rules", ", "), "confidence")
    return groups.select(
        "file_path", F.concat(F.lit(PROMOTED_RULE[0]), "key", F.lit(PROMOTED_RULE[1])).alias("rule_id"), F.col("best.algorithm").alias("algorithm"),
        F.lit(PROMOTED_USAGE).alias("usage_type"), F.col("best.quantum_safety").alias("quantum_safety"), F.lit("high").alias("severity"), "first.language",
        "first.line_number", "first.column", "first.snippet", "confidence", F.lit(SIGNAL_CATEGORIES[0]).alias("category"), text.alias("message"), F.array(F.lit(327)).alias("cwe"),
    )
