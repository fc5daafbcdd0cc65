"""The ground-truth gate: findings against what must, must not and may be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import normal_algorithm
from ..schema import RISK_TAGGED, SEVERITIES, gate_rank, is_risk
from .graph import stored

LINE_TOLERANCE = 2


def _folded(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(F.trim(x)))


def _named(findings: DataFrame) -> DataFrame:
    return findings.withColumn("file", F.lower("file_path"))


def _wanted(instances: DataFrame) -> DataFrame:
    """An instance's rows, one for each of its labels: id, file, want_line, alg, prefix, want_severity and want_safety."""
    each = instances.select("id", F.lower("file").alias("file"), F.col("line").alias("want_line"), _folded(F.col("severity")).alias("want_severity"), _folded(F.col("quantum_safety")).alias("want_safety"), F.coalesce("rule_id_prefix", F.lit("")).alias("prefix"), F.explode(F.array_distinct("algorithm")).alias("label"))
    return each.withColumn("alg", normal_algorithm(F.col("label"))).drop("label").distinct()


def _labelled(findings: DataFrame) -> DataFrame:
    return _named(findings).withColumn("alg", normal_algorithm(F.col("algorithm")))


#: Classes whose bits one word holds.
WORD = 62


def _met(instances: DataFrame, findings: DataFrame, tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """id, yes and no: whether some finding at an instance's place (same file, algorithm and rule prefix; near its line if it
    has one) has the severity and safety that it asks for, and whether some has others. A null among them says neither.

    Of the findings of a place only their classes (severity and safety) count, so they are put together as a word of bits,
    and an instance meets a word for each of its labels however many findings or instances a place has."""
    found = _labelled(findings).select("file", "alg", "line_number", "rule_id", F.lower("severity").alias("has_severity"), F.lower("quantum_safety").alias("has_safety"))
    wanted = _wanted(instances)
    # kinds of findings are few; words hold WORD of them each
    nth = F.row_number().over(W.orderBy("has_severity", "has_safety")) - 1
    classes = stored(found.select("has_severity", "has_safety").distinct().withColumn("nth", nth), "classes")
    classes = classes.select("has_severity", "has_safety", F.floor(F.col("nth") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, nth % {WORD})").alias("bit"))
    of_class = classes.withColumnsRenamed({"has_severity": "_severity", "has_safety": "_safety"})
    coded = found.join(of_class, F.col("has_severity").eqNullSafe(F.col("_severity")) & F.col("has_safety").eqNullSafe(F.col("_safety"))).groupBy("file", "alg", "line_number", "rule_id", "word").agg(F.bit_or("bit").alias("bits"))
    # rules by the prefixes that are asked for: each beginning of a rule's id is looked up
    begins = F.transform(F.sequence(F.lit(0), F.length("rule_id")), lambda n: F.substring("rule_id", F.lit(1), n))
    begun = found.select("rule_id").distinct().select("rule_id", F.explode(begins).alias("prefix")).join(wanted.select("prefix").distinct(), "prefix")
    keys = ["file", "alg", "prefix", "want_line", "word"]
    marks = coded.join(begun, "rule_id").groupBy("file", "alg", "prefix", "line_number", "word").agg(F.bit_or("bits").alias("bits"))
    around = F.explode(F.sequence(F.col("line_number") - tolerance, F.col("line_number") + tolerance)).alias("want_line")
    bits = marks.where("line_number IS NOT NULL").select("*", around).unionByName(marks.withColumn("want_line", F.lit(None).cast("int"))).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
    bits = bits.withColumnRenamed("want_line", "_line")
    # what is asked for is of few kinds too: which classes are right, and which aren't
    right = ((F.size("want_severity") == 0) | F.array_contains("want_severity", F.col("has_severity"))) & ((F.size("want_safety") == 0) | F.array_contains("want_safety", F.col("has_safety")))
    asked = wanted.select("want_severity", "want_safety").distinct().crossJoin(classes)
    asked = asked.groupBy(F.col("want_severity").alias("_severities"), F.col("want_safety").alias("_safeties"), F.col("word").alias("_word")).agg(*[F.bit_or(F.when(x, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(n) for n, x in (("yes", right), ("no", ~right))])
    placed = wanted.join(bits, ["file", "alg", "prefix"]).where(F.col("want_line").eqNullSafe(F.col("_line"))).select("id", "want_severity", "want_safety", "word", "bits")
    kind = F.col("want_severity").eqNullSafe(F.col("_severities")) & F.col("want_safety").eqNullSafe(F.col("_safeties")) & (F.col("word") == F.col("_word"))
    return placed.join(asked, kind).select("id", *[(F.col("bits").bitwiseAND(F.col(n)) != 0).alias(n) for n in ("yes", "no")])


def recall(instances: DataFrame, findings: DataFrame, ast_languages: list[str] | None = None) -> DataFrame:
    """id and outcome of each instance: matched, mismatched (found with other labels), missed or skipped.

    instances: id, file, line, algorithm, severity, quantum_safety (arrays; an empty one accepts all), tier, language,
    rule_id_prefix. Those of tier `ast` are skipped for languages without a structural detector.
    """
    best = _met(instances, findings).groupBy("id").agg(F.max("yes").alias("yes"), F.max("no").alias("no"))
    skip = (F.col("tier") == "ast") & ~F.col("language").isin(*(ast_languages or [""])) if "tier" in instances.columns else F.lit(False)
    outcome = F.when(skip, F.lit("skipped")).when(F.col("yes"), F.lit("matched")).when(F.col("no"), F.lit("mismatched")).otherwise(F.lit("missed"))
    return instances.join(best, "id", "left").select("id", outcome.alias("outcome"))


def recall_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("matched", "missed", "mismatched", "skipped")])


#: Lines of the finest bin.
BIN = 16


def within(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: str) -> DataFrame:
    """Pairs of a row of points and one of ranges with low <= point <= high (none of them null) that agree in column `by`.

    A range is put into the bins of a level whose bins are at least as wide as itself, so into two at most; a point is put
    into its bin of each level that some range has. Levels grow by powers of two, so there are few, and a bin holds only
    points and ranges that are near each other.
    """
    width = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    level = F.greatest(F.ceil(F.log2(width / BIN)), F.lit(0)).cast("int")
    bin_of = lambda c: F.floor(F.col(c) / (BIN * F.pow(F.lit(2), F.col("_level")))).cast("long")
    own = ranges.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    own = own.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    used = sorted(r._level for r in own.select("_level").distinct().collect())  # a few dozen numbers at most
    each = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_bin", bin_of(point))
    return each.join(own, [by, "_level", "_bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_level", "_bin")


def _ranges(forbidden: DataFrame) -> DataFrame:
    return forbidden.select(F.lower("file").alias("file"), F.col("line").alias("from_line"), F.coalesce("line_end", "line").alias("to_line"), "reason", "allow_safety", "allow_severity")


def _inside(findings: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Findings in a forbidden range (a place without lines is the whole file), with whether the range tolerates them."""
    ranges = _ranges(forbidden)
    found, placed = _named(findings), F.col("from_line").isNotNull()
    joined = within(found.where("line_number IS NOT NULL"), ranges.where(placed), "line_number", "from_line", "to_line", "file").unionByName(found.join(ranges.where(~placed), "file"))
    safe = (F.size("allow_safety") > 0) & F.array_contains(_folded(F.col("allow_safety")), F.lower(F.trim("quantum_safety")))
    mild = F.col("allow_severity").isNull() | (gate_rank(F.col("severity")) <= gate_rank(F.col("allow_severity")))
    return joined.withColumn("tolerated", F.coalesce(safe & mild, F.lit(False)))


def _most() -> Column:
    """The highest rank that a range tolerates. An unknown severity is above all others, so its rank lets all pass, as none does."""
    return F.when(F.col("allow_severity").isNull(), len(SEVERITIES)).otherwise(gate_rank(F.col("allow_severity")))


#: The level of the node that stands for a whole file, with or without a line.
WHOLE = -1


def _range_nodes(ranges: DataFrame) -> DataFrame:
    """ranges (from_line, to_line) with level and node: the fewest nodes of a binary tree over lines that cover each, two a
    level at most. Node n of level l covers lines n * 2**l to (n + 1) * 2**l - 1; a range without lines is its whole file."""
    low, end = F.col("from_line").cast("long"), F.col("to_line").cast("long") + 1

    def of_level(level: Column) -> Column:
        side = F.pow(F.lit(2), level)
        first, last = F.ceil(low / side), F.floor(end / side) - 1  # the nodes inside the range; an outermost one whose parent isn't is taken
        node = lambda x: F.struct(level.cast("int").alias("level"), x.cast("long").alias("node"))
        inside = first <= last
        return F.array(F.when(inside & (F.pmod(first, F.lit(2)) == 1), node(first)), F.when(inside & (F.pmod(last, F.lit(2)) == 0), node(last)))

    levels = F.sequence(F.lit(0), F.floor(F.log2(end - low)).cast("int") + 1)
    covers = F.when(low.isNull(), F.array(F.struct(F.lit(WHOLE).alias("level"), F.lit(0).cast("long").alias("node")))).when(low < end, F.filter(F.flatten(F.transform(levels, of_level)), lambda x: x.isNotNull()))
    return ranges.withColumn("_at", F.explode(covers)).select(*ranges.columns, "_at.level", "_at.node")


def _point_nodes(points: DataFrame, levels: list[int]) -> DataFrame:
    """points (line_number) with level and node: those that cover them, of these levels."""
    own = F.filter(F.array(*[F.struct(F.lit(x).alias("level"), (F.lit(0).cast("long") if x == WHOLE else F.floor(F.col("line_number") / F.lit(1 << x))).cast("long").alias("node")) for x in levels]).cast("array<struct<level:int,node:bigint>>"), lambda x: x["node"].isNotNull())
    return points.withColumn("_at", F.explode(own)).select(*points.columns, "_at.level", "_at.node")


def _levels(nodes: DataFrame) -> list[int]:
    return sorted(r.level for r in nodes.select("level").distinct().collect())  # a few dozen numbers at most


def violations(findings: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Risk findings in forbidden ranges, with the reason; an interval join within the file."""
    return _inside(findings, forbidden).where(~F.col("tolerated") & is_risk(F.col("quantum_safety"))).drop("file", "from_line", "to_line", "allow_safety", "allow_severity", "tolerated")


def violation_counts(findings: DataFrame, forbidden: DataFrame) -> DataFrame:
    """reason and n, as `violations` has them, without its pairs: findings are counted by node of a tree over their file's
    lines, by safety and rank, and a range adds up the nodes that cover it. So neither many findings in many ranges nor a wide
    range costs more than a few dozen rows for each finding and each range."""
    classes = [(safety, rank) for safety in sorted(RISK_TAGGED) for rank in range(len(SEVERITIES) + 1)]
    safe = F.coalesce(F.array_compact(_folded(F.col("allow_safety"))), F.array().cast("array<string>")).alias("safe")
    nodes = _range_nodes(_ranges(forbidden).groupBy("file", "from_line", "to_line", "reason", safe, _most().alias("most")).agg(F.count("*").alias("times")))
    own = _named(findings).where(is_risk(F.col("quantum_safety"))).select("file", "line_number", F.lower(F.trim("quantum_safety")).alias("safety"), gate_rank(F.col("severity")).alias("rank"))
    is_class = [(F.col("safety") == safety) & (F.col("rank") == rank) for safety, rank in classes]
    by_line = own.groupBy("file", "line_number").agg(*[F.count_if(x).alias(f"n_{i}") for i, x in enumerate(is_class)])
    sums = _point_nodes(by_line, _levels(nodes)).groupBy("file", "level", "node").agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(classes))])
    tolerated = [F.array_contains("safe", safety) & (F.lit(rank) <= F.col("most")) for safety, rank in classes]
    n = sum((F.when(~x, F.col(f"n_{i}")).otherwise(0) for i, x in enumerate(tolerated)), F.lit(0))
    each = nodes.join(sums, ["file", "level", "node"]).select("reason", (n * F.col("times")).alias("n"))
    return each.groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


def _tolerated(findings: DataFrame, forbidden: DataFrame) -> DataFrame:
    """file, line_number, safety and rank of findings that some range tolerates: each once, by the nodes of a tree as in
    `violation_counts`."""
    ranges = _ranges(forbidden).where(F.size("allow_safety") > 0).withColumn("safety", F.explode(F.array_distinct(_folded(F.col("allow_safety")))))
    nodes = _range_nodes(ranges.groupBy("file", "from_line", "to_line", "safety").agg(F.max(_most()).alias("most")))
    best = nodes.groupBy("file", "level", "node", "safety").agg(F.max("most").alias("most"))
    own = _named(findings).select("file", "line_number", F.lower(F.trim("quantum_safety")).alias("safety"), gate_rank(F.col("severity")).alias("rank")).distinct()
    met = _point_nodes(own, _levels(nodes)).join(best, ["file", "level", "node", "safety"]).where("rank <= most")
    return met.select("file", "line_number", "safety", "rank").distinct()


def unexplained(findings: DataFrame, instances: DataFrame, forbidden: DataFrame, excluded: DataFrame) -> DataFrame:
    """Findings (finding_id, ...) that no excluded file, tolerance or instance explains."""
    rest = _named(findings).join(excluded.select(F.lower("file").alias("file")).distinct(), "file", "left_anti")
    classes = _tolerated(findings, forbidden).withColumnsRenamed({"file": "_file", "line_number": "_line", "safety": "_safety", "rank": "_rank"})
    same = (F.col("file") == F.col("_file")) & F.col("line_number").eqNullSafe(F.col("_line")) & (F.lower(F.trim("quantum_safety")) == F.col("_safety")) & (gate_rank(F.col("severity")) == F.col("_rank"))
    allowed = _named(findings).join(classes, same, "left_semi").select("finding_id").distinct()
    # anywhere in the file, where instances that ask for the same stand for one another
    asked = _wanted(instances).select("file", "alg", "prefix").distinct()
    explained = _labelled(findings).join(asked, ["file", "alg"]).where(F.startswith(F.col("rule_id"), F.col("prefix"))).select("finding_id").distinct()
    return rest.drop("file").join(allowed, "finding_id", "left_anti").join(explained, "finding_id", "left_anti")


def dependencies(expected: DataFrame, forbidden: DataFrame, findings: DataFrame) -> DataFrame:
    """manifest, package and problem: expected algorithms that are missing, and packages that must not be flagged."""
    found = findings.select(F.lower("file_path").alias("manifest"), F.lower("package").alias("package"), normal_algorithm(F.col("algorithm")).alias("alg")).distinct()
    wanted = expected.select(F.lower("manifest").alias("manifest"), F.lower("package").alias("package"), F.explode("algorithms_include").alias("label")).withColumn("alg", normal_algorithm(F.col("label")))
    missing = wanted.join(found, ["manifest", "package", "alg"], "left_anti").select("manifest", "package", F.concat(F.lit("missing "), "label").alias("problem"))
    wrong = forbidden.select(F.lower("manifest").alias("manifest"), F.lower("package").alias("package")).join(found, ["manifest", "package"], "left_semi")
    return missing.unionByName(wrong.select("manifest", "package", F.lit("must not be flagged").alias("problem")))
