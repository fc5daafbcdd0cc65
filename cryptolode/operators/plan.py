"""The migration plan: findings as ranked work items, their summary and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.risk import priority_band, priority_score
from ..functions.scalars import finding_key, round2, strip
from .graph import stored

RANKS_LISTED, MOST_DAYS = 20, 60


def key_of() -> Column:
    return finding_key(*(F.col(c) for c in ("finding_id", "file_path", "line_number", "column", "rule_id", "algorithm", "severity")))


def cluster_signals(clusters: DataFrame) -> DataFrame:
    """key, cluster_confidence, cluster_corroboration, cluster_channels: the last cluster (by corroboration, falling, then
    class) that has a finding. clusters' `findings` hold the finding's own fields."""
    each = clusters.select("confidence", "corroboration", "channels", "algorithm_class", F.explode("findings").alias("f"))
    key = finding_key(*(F.col(f"f.{c}") for c in ("finding_id", "file_path", "line_number", "column", "rule_id", "algorithm", "severity")))
    last = F.struct((-F.col("corroboration")).alias("c"), "algorithm_class")
    picked = each.groupBy(key.alias("key")).agg(F.max_by(F.struct("confidence", "corroboration", "channels"), last).alias("s"))
    return picked.select("key", F.col("s.confidence").alias("cluster_confidence"), F.col("s.corroboration").alias("cluster_corroboration"), F.col("s.channels").alias("cluster_channels"))


def recommended_action(rule_id: Column, category: Column, usage_type: Column, algorithm: Column) -> Column:
    rule, kind, algo = F.upper(rule_id), F.lower(category), F.upper(strip(algorithm))
    tls = "Turn off old TLS versions and weak suites, and test clients against TLS 1.3."
    return (
        F.when(F.contains(kind, F.lit("hardcoded")) | F.contains(rule, F.lit("HARDCODED")), F.lit("Take the key out of the code into a secret store and rotate it."))
        .when(F.contains(kind, F.lit("dependency")) | (usage_type == "dependency") | F.startswith(rule, F.lit("SBOM_")), F.lit("Review what uses this package; upgrade or replace it with one that supports post-quantum algorithms."))
        .when(algo.isin("MD5", "MD4", "MD2", "SHA1", "SHA-1"), F.lit("Use SHA-256 or SHA-3 for integrity, and a password hash for passwords."))
        .when(algo.isin("DES", "3DES", "TRIPLEDES", "RC4", "RC2"), F.lit("Use AES-GCM or ChaCha20-Poly1305, without fallbacks."))
        .when(algo.isin("RSA", "RSA-1024", "DSA", "DH", "ECDSA", "ECDH", "ECC"), F.lit("Put the call behind a provider interface and plan a hybrid or post-quantum replacement."))
        .when((algo == "TLS") | F.contains(rule, F.lit("TLS")), F.lit(tls))
        .otherwise(F.lit("Review the primitive, put it behind an interface and cover the replacement with a test."))
    )


def rationale(severity: Column, rule_id: Column, confidence: Column, corroboration: Column, channels: Column, band: Column, radius: Column, grade: Column, agility: Column) -> Column:
    parts = [
        F.format_string("%s severity, rule %s", F.when(F.coalesce(severity, F.lit("")) == "", F.lit("unknown")).otherwise(severity), rule_id),
        F.when(corroboration > 1, F.format_string("seen by %s, confidence %.2f", F.array_join(channels, "+"), confidence)).otherwise(F.format_string("one channel, confidence %.2f", confidence)),
        F.when(F.coalesce(band, F.lit("")) != "", F.format_string("%s reach, score %d", band, radius)),
        F.when(F.coalesce(grade, F.lit("")) != "", F.format_string("agility %s (%d of 100)", grade, agility)),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def score_items(findings: DataFrame, agility: Column, grade: Column | None = None) -> DataFrame:
    """findings with the columns of their cluster (cluster_*), their impact (band, blast_radius) where known: scored."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sure = F.when(zero("cluster_confidence") != 0, F.col("cluster_confidence")).when(zero("confidence") != 0, F.col("confidence")).otherwise(F.lit(0.5))
    agreed = F.when(zero("cluster_corroboration") != 0, F.col("cluster_corroboration")).otherwise(F.lit(1))
    named = F.when(F.size("cluster_channels") > 0, F.col("cluster_channels")).otherwise(F.array(F.lit("ast")))
    out = findings.withColumns({"sure": sure, "corroboration": agreed, "channels": named, "blast_radius": zero("blast_radius"), "agility": agility})
    out = out.withColumn("score", priority_score(F.col("severity"), F.col("sure"), F.col("corroboration"), F.col("band"), F.col("blast_radius"), F.col("agility")))
    why = rationale(*(F.col(c) for c in ("severity", "rule_id", "sure", "corroboration", "channels", "band", "blast_radius")), grade if grade is not None else F.lit(""), F.col("agility"))
    act = recommended_action(*(F.col(c) for c in ("rule_id", "category", "usage_type", "algorithm")))
    return out.withColumns({"priority_band": priority_band(F.col("score")), "fused_confidence": round2(F.col("sure")), "action": act, "rationale": why}).drop("sure", "cluster_confidence", "cluster_corroboration", "cluster_channels")


def ranked(items: DataFrame) -> DataFrame:
    """Items with their rank among all.

    The order is global, but no task sees all rows: they are stored once, dealt into ranges of the whole order (whose
    bounds Spark samples) and numbered within each partition, and the partitions' counts, one row each, are added up.
    """
    order = [F.col("score").desc(), F.col("blast_radius").desc(), F.col("file_path"), F.col("line_number"), F.col("rule_id"), F.col("finding_id")]
    # stored before, or else sampling the bounds would compute the items a second time
    dealt = stored(stored(items, "items").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(base, "_part").withColumn("rank", F.col("_base") + nth).drop("_part", "_base")


def summary(items: DataFrame) -> DataFrame:
    """One row: how many items of each kind, and the highest score."""
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.col("score") >= 80).alias("immediate"), F.count_if(F.col("corroboration") >= 2).alias("corroborated"),
        F.count_if(F.col("band").isin("High", "Catastrophic")).alias("high_reach"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.coalesce(F.max("score"), F.lit(0)).alias("top_score"),
    )


def phase(score: Column, corroboration: Column, severity: Column, radius: Column) -> Column:
    return F.when((score >= 80) | (corroboration >= 2) | (severity == "critical"), F.lit(1)).when((radius >= 10) | (score >= 40), F.lit(2)).otherwise(F.lit(3))


PHASE_NAMES = {1: "Confirm", 2: "Isolate", 3: "Close"}


def phases(items: DataFrame) -> DataFrame:
    """phase, name, n, effort_days and the first ranks of each phase that has items (ranked). Ranks beyond the listed are
    cut before they meet, by a window that keeps the first of each partition."""
    own = items.withColumn("phase", phase(F.col("score"), F.col("corroboration"), F.col("severity"), F.col("blast_radius")))
    sizes = own.groupBy("phase").agg(F.count("*").alias("n"))
    first = own.select("phase", "rank").withColumn("nth", F.row_number().over(W.partitionBy("phase").orderBy("rank"))).where(F.col("nth") <= RANKS_LISTED)
    listed = first.groupBy("phase").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    name = F.element_at(F.array(*map(F.lit, PHASE_NAMES.values())), F.col("phase"))
    return sizes.join(listed, "phase").select("phase", name.alias("name"), "n", F.least(F.col("n") * 2, F.lit(MOST_DAYS)).alias("effort_days"), "ranks")
