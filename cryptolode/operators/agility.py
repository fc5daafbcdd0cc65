"""Crypto-agility: four measures of 0 to 25, by any grouping of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import bands, is_hardcoded, is_library_rule, library_of, strip

# fixed values: labels too general to count as an algorithm
TOO_GENERAL = ("TLS", "CIPHER", "HASH", "HMAC", "MAC", "RNG", "SIGNATURE")


def library_points(n: Column) -> Column:
    return F.when(n == 0, 18).otherwise(bands(n, [(5, 5), (3, 12), (2, 20)], 25))


def concentration_points(share: Column) -> Column:
    return bands(share, [(0.80, 25), (0.50, 18), (0.30, 12)], 5)


def diversity_points(n: Column) -> Column:
    return bands(n, [(7, 5), (5, 12), (3, 18)], 25)


def hardcoded_points(n: Column, share: Column) -> Column:
    return F.when(n == 0, 25).when(share <= 0.02, 20).when(share <= 0.05, 12).when(share <= 0.10, 5).otherwise(0)


def grade(total: Column) -> Column:
    return bands(total, [(75, "Agile"), (50, "Manageable"), (25, "Difficult")], "Brittle")


def libraries(findings: DataFrame, by: list[str]) -> DataFrame:
    """n_libraries and library_score of each group."""
    name = F.when(is_library_rule(F.col("rule_id")), F.nullif(library_of(F.col("rule_id")), F.lit("")))
    out = findings.groupBy(*by).agg(F.countDistinct(name).alias("n_libraries"))
    return out.withColumn("library_score", library_points(F.col("n_libraries")))


def concentration(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings, files and the share of the three files that have most; ties by path."""
    files = findings.groupBy(*by, "file_path").agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy(F.col("n").desc(), "file_path")
    ranked = files.withColumn("nth", F.row_number().over(order))
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_files"), F.sum(F.when(F.col("nth") <= 3, F.col("n")).otherwise(0)).alias("top3"))
    return out.withColumn("concentration_score", concentration_points(F.col("top3") / F.col("n_findings")))


def diversity(findings: DataFrame, by: list[str]) -> DataFrame:
    """n_algorithms and diversity_score of each group."""
    label = F.upper(strip(F.col("algorithm")))
    out = findings.groupBy(*by).agg(F.countDistinct(F.when((label != "") & ~label.isin(*TOO_GENERAL), label)).alias("n_algorithms"))
    return out.withColumn("diversity_score", diversity_points(F.col("n_algorithms")))


def hardcoded(findings: DataFrame, by: list[str]) -> DataFrame:
    """n_hardcoded and hardcoded_score of each group."""
    out = findings.groupBy(*by).agg(F.count_if(is_hardcoded(F.col("category"), F.col("rule_id"))).alias("n_hardcoded"), F.count("*").alias("n"))
    return out.withColumn("hardcoded_score", hardcoded_points(F.col("n_hardcoded"), F.col("n_hardcoded") / F.col("n"))).drop("n")


def scorecard(findings: DataFrame, by: list[str]) -> DataFrame:
    """All measures, total and grade of each group. Without `by`, one row, also for no findings: 100, Agile.

    Three of the measures come out of one grouping, and the files' counts of another, so findings are shuffled twice at
    most, already reduced.
    """
    name = F.when(is_library_rule(F.col("rule_id")), F.nullif(library_of(F.col("rule_id")), F.lit("")))
    label = F.upper(strip(F.col("algorithm")))
    keys = by or ["_all"]
    rows = findings if by else findings.withColumn("_all", F.lit(1))
    # per file: what it has of each measure
    per_file = rows.groupBy(*keys, "file_path").agg(
        F.count("*").alias("n"), F.count_if(is_hardcoded(F.col("category"), F.col("rule_id"))).alias("hard"),
        F.collect_set(name).alias("libs"), F.collect_set(F.when((label != "") & ~label.isin(*TOO_GENERAL), label)).alias("algs"),
    )
    order = W.partitionBy(*keys).orderBy(F.col("n").desc(), "file_path")
    ranked = per_file.withColumn("nth", F.row_number().over(order))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(a) for c, a in (("libs", "libraries"), ("algs", "algorithms"))]
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_files"), F.sum(F.when(F.col("nth") <= 3, F.col("n")).otherwise(0)).alias("top3"), F.sum("hard").alias("n_hardcoded"), *sets)
    if not by:
        one = findings.sparkSession.range(1).select(F.lit(1).alias("_all"))
        out = one.join(out, "_all", "left")
    n = F.coalesce(F.col("n_findings"), F.lit(0))
    empty = n == 0
    scores = {
        "library_score": library_points(F.size("libraries")),
        "concentration_score": concentration_points(F.col("top3") / F.col("n_findings")),
        "diversity_score": diversity_points(F.size("algorithms")),
        "hardcoded_score": hardcoded_points(F.col("n_hardcoded"), F.col("n_hardcoded") / F.col("n_findings")),
    }
    for c, score in scores.items():
        out = out.withColumn(c, F.when(empty, F.lit(25)).otherwise(score))
    out = out.withColumn("total_score", sum((F.col(c) for c in scores), F.lit(0))).withColumn("grade", grade(F.col("total_score"))).withColumn("n_findings", n)
    return out if by else out.drop("_all")
