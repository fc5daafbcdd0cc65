"""Findings as files: JSON lines, SARIF, Markdown, HTML, text, and Parquet by scan.

Rows are formatted by columns, in parallel. A report that is one document is a relation of lines with places: heads and ends
come from counts, and executors write the sorted lines as text.
"""

from __future__ import annotations

import functools
import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, sarif_level, security_severity, severity_of_level, shorten
from ..schema import FINDING_SCHEMA, SEVERITIES, complete, severity_rank

PRODUCER = "cryptolode"


def write_jsonl(findings: DataFrame, path: str) -> None:
    """One JSON object a line, with ids."""
    complete(findings).select(*FINDING_SCHEMA.names).write.json(path, ignoreNullFields=True)


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Findings written as JSON lines; a bad line is passed over, or fails the read if strict."""
    return spark.read.schema(FINDING_SCHEMA).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_scored(findings: DataFrame, path: str) -> None:
    """Write scans' scored findings, by scan; a scan that is written again takes the place of what it was."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_run_id").parquet(path)


def tags(findings: DataFrame) -> Column:
    safety = F.lower("quantum_safety")
    own = (
        F.when(safety == "vulnerable", F.array(F.lit("pqc"), F.lit("quantum-vulnerable")))
        .when(safety == "grover_weakened", F.array(F.lit("pqc"), F.lit("grover-weakened")))
        .when(safety == "classically_broken", F.array(F.lit("classically-broken")))
        .otherwise(F.array().cast("array<string>"))
    )
    cwe = F.transform(F.coalesce("cwe", F.array().cast("array<int>")), lambda x: F.concat(F.lit("external/cwe/cwe-"), x.cast("string")))
    return F.concat(F.array(F.lit("security"), F.lit("cryptography")), own, cwe)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule id: the last finding's description, by order of place."""
    last = F.struct("file_path", "line_number", "column", "finding_id")
    what = F.struct(
        F.col("rule_id").alias("id"), F.struct(F.col("message").alias("text")).alias("shortDescription"),
        F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(security_severity(F.col("severity")).alias("security-severity"), tags(findings).alias("tags")).alias("properties"),
    )
    return findings.groupBy("rule_id").agg(F.max_by(what, last).alias("rule"))


def _result() -> list[Column]:
    mark = fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("line_number"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))
    return [
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(mark.alias(f"{PRODUCER}/v1")).alias("partialFingerprints"),
        F.struct("severity", "quantum_safety", "algorithm", "confidence").alias("properties"),
    ]


def sarif_results(findings: DataFrame) -> DataFrame:
    """A finding as a result; the severity itself travels in its properties, so that reading back loses nothing."""
    return findings.select(*_result())


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the first run: rule_id, message, severity (from the level, if the report has no severity itself),
    file_path, line_number, fingerprint."""
    result = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,partialFingerprints:map<string,string>,properties:struct<severity:string>>"
    runs = spark.read.schema(f"runs array<struct<results:array<{result}>>>").json(path, multiLine=True)
    each = runs.select(F.explode(F.element_at("runs", 1)["results"]).alias("r"))
    place = F.element_at("r.locations", 1)["physicalLocation"]
    return each.select(
        F.col("r.ruleId").alias("rule_id"), F.col("r.message.text").alias("message"), F.coalesce("r.properties.severity", severity_of_level(F.col("r.level"))).alias("severity"),
        place["artifactLocation"]["uri"].alias("file_path"), place["region"]["startLine"].alias("line_number"), F.element_at(F.map_values("r.partialFingerprints"), 1).alias("fingerprint"),
    )


#: Where a line stands within a report: its part, then the place of its finding, then which of several like it.
PLACE = ("part", "file_path", "line_number", "rule_id", "finding_id", "nth")
FIRST, LAST = -1, 99
OTHER = "other"


def report_lines(findings: DataFrame) -> DataFrame:
    """rank (of severity, falling in reports), section (the severity, or `other`), the finding's fields with a short snippet,
    and the row's Markdown line."""
    message = F.regexp_replace(F.replace("message", F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    text = F.format_string("| %s | `%s:%d` | %s | %s |", "rule_id", "file_path", "line_number", "algorithm", message)
    severity = F.lower("severity")
    section = F.when(severity.isin(*SEVERITIES), severity).otherwise(OTHER)
    return complete(findings).select(
        severity_rank(severity, unknown=-1).alias("rank"), section.alias("section"), severity.alias("severity"), "finding_id", "file_path", "line_number", "rule_id", "algorithm", "message",
        shorten(F.col("snippet")).alias("snippet"), text.alias("markdown"),
    )


def _placed(rows: DataFrame, part: Column, line: Column) -> DataFrame:
    """Findings as lines of a part, where they are. Any number tells apart rows that are alike, so that a sort can part them."""
    keys = [F.coalesce(F.col(c), F.lit(0) if c == "line_number" else F.lit("")).alias(c) for c in PLACE[1:-1]]
    return rows.select(part.alias("part"), *keys, F.monotonically_increasing_id().alias("nth"), line.alias("line"))


def _between(rows: DataFrame, part: Column, line: Column) -> DataFrame:
    """Lines that stand alone in their part: headings and ends."""
    return rows.select(part.cast("int").alias("part"), F.lit("").alias("file_path"), F.lit(0).alias("line_number"), F.lit("").alias("rule_id"), F.lit("").alias("finding_id"), F.lit(0).cast("long").alias("nth"), line.alias("line"))


def _fixed(spark: SparkSession, part: int, line: str) -> DataFrame:
    return _between(spark.range(1), F.lit(part), F.lit(line))


def _elements(rows: DataFrame, part: int, element: Column) -> DataFrame:
    """Findings as the elements of a JSON array: all but the first have a comma before them. Which is first, and how many are
    like it, is known by its place and line; those stand before all others of its place."""
    placed, place = _placed(rows, F.lit(part), element), F.struct(*PLACE[:-1])
    first = placed.agg(F.min(place)).scalar()
    like = placed.where(place == first).groupBy(*PLACE[:-1], "line").agg(F.count("*").alias("n"))
    least = like.agg(F.min(F.struct("line", *PLACE[:-1], "n")).alias("least")).where("least IS NOT NULL")
    begun = least.select("least.*", F.explode(F.sequence(F.lit(1).cast("long"), "least.n")).alias("k"))
    begun = begun.select(*PLACE[:-1], (F.col("k") - F.col("n") - 1).alias("nth"), F.concat(F.when(F.col("k") == 1, F.lit("")).otherwise(","), "line").alias("line"))
    rest = placed.where(~((place == first) & (F.col("line") == least.select("least.line").scalar())))
    return begun.unionByName(rest.withColumn("line", F.concat(F.lit(","), "line")))


def _sections(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and one row a section: rank, section, n."""
    rows = report_lines(findings)
    return rows, rows.groupBy("rank", "section").agg(F.count("*").alias("n"))


def _part(step: int) -> Column:
    """The part of a section's head (0), rows (1) and end (2)."""
    return ((F.lit(len(SEVERITIES) - 1) - F.col("rank")) * 3 + step).cast("int")


def _markdown(findings: DataFrame) -> list[DataFrame]:
    rows, sections = _sections(findings)
    head = F.concat(F.lit("\n## "), F.initcap("section"), F.lit(" ("), "n", F.lit(")\n\n| Rule | Place | Algorithm | Message |\n|---|---|---|---|"))
    return [_fixed(findings.sparkSession, FIRST, "# Cryptography findings"), _between(sections, _part(0), head), _placed(rows, _part(1), F.col("markdown"))]


def _text(findings: DataFrame) -> list[DataFrame]:
    rows, sections = _sections(findings)
    counts = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("rank"), F.concat("section", F.lit(": "), "n").alias("count"))))  # a few sections
    head = sections.agg(F.array_join(F.transform(counts, lambda x: x["count"]), "  ").alias("head"))
    line = F.concat(F.lit("["), "severity", F.lit("] "), "file_path", F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("")), F.lit(" "), "rule_id", F.lit(" "), "message")
    return [_between(head, F.lit(FIRST), F.when(F.col("head") == "", F.lit("no findings")).otherwise(F.col("head"))), _placed(rows, _part(1), line)]


def _escaped(column: str) -> Column:
    out = F.coalesce(F.col(column).cast("string"), F.lit(""))
    for character in "&<>\"'":
        out = F.replace(out, F.lit(character), F.lit(html.escape(character)))
    return out


def _html(findings: DataFrame) -> list[DataFrame]:
    rows, sections = _sections(findings)
    cells = [F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>")) for c in ("rule_id", "file_path", "line_number", "algorithm", "message")]
    head = F.concat(F.lit("<h2>"), "section", F.lit(" ("), "n", F.lit(")</h2><table>"))
    return [
        _fixed(findings.sparkSession, FIRST, "<!doctype html><meta charset='utf-8'><title>Cryptography findings</title>"),
        _between(sections, _part(0), head), _placed(rows, _part(1), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))), _between(sections, _part(2), F.lit("</table>")),
    ]


def _json_array(findings: DataFrame) -> list[DataFrame]:
    own = complete(findings).withColumn("snippet", shorten(F.col("snippet")))
    spark = findings.sparkSession
    return [_fixed(spark, FIRST, "["), _elements(own, 0, F.to_json(F.struct(*FINDING_SCHEMA.names))), _fixed(spark, LAST, "]")]


def _jsonl(findings: DataFrame) -> list[DataFrame]:
    return [_placed(complete(findings), F.lit(0), F.to_json(F.struct(*FINDING_SCHEMA.names)))]


def _sarif(findings: DataFrame) -> list[DataFrame]:
    """A SARIF 2.1.0 log of one run."""
    own, spark = complete(findings), findings.sparkSession
    rules = sarif_rules(own).select("rule", "rule_id", F.lit("").alias("file_path"), F.lit(0).alias("line_number"), F.lit("").alias("finding_id"))
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1]
    head += f', "runs": [{{"tool": {{"driver": {{"name": "{PRODUCER}", "rules": ['
    return [
        _fixed(spark, FIRST, head), _elements(rules, 0, F.to_json("rule")), _fixed(spark, 1, ']}}, "results": ['),
        _elements(own, 2, F.to_json(F.struct(*_result()))), _fixed(spark, LAST, "]}]}"),
    ]


FORMATS: dict[str, Callable[[DataFrame], list[DataFrame]]] = {"text": _text, "json": _json_array, "jsonl": _jsonl, "sarif": _sarif, "markdown": _markdown, "md": _markdown, "html": _html}


def document(findings: DataFrame, name: str) -> DataFrame:
    """A report's lines, in no order: the columns of PLACE, which order them, and line (which may hold line ends).

    No findings give the report's head and end. Findings that are alike are each listed; a null line number is 0 in the order.
    """
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known are {', '.join(FORMATS)}")
    return functools.reduce(DataFrame.unionByName, FORMATS[name](findings))


def write(findings: DataFrame, name: str, path: str) -> None:
    """A report as a folder of text files which, one after another by name, are the report. Executors write ranges of it."""
    document(findings, name).orderBy(*PLACE).select("line").write.text(path)


def render(findings: DataFrame, name: str) -> str:
    """A report that is short enough to be read, as one string; `write` is for all others."""
    return "".join(f"{x}\n" for (x,) in document(findings, name).orderBy(*PLACE).select("line").toLocalIterator())


def write_scorecard(card: DataFrame, path: str) -> None:
    """Scorecards as JSON, one a line."""
    card.write.json(path, ignoreNullFields=False)


def scan_summary(files: DataFrame, skipped: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files_scanned, files_skipped, n_findings and files by language."""
    by = files.groupBy("language").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("by_language"), F.coalesce(F.sum("n"), F.lit(0)).alias("files_scanned"))
    return by.crossJoin(skipped.agg(F.count("*").alias("files_skipped"))).crossJoin(findings.agg(F.count("*").alias("n_findings")))  # one row each


def comment(findings: DataFrame, most: int = 20) -> str:
    """A pull request's comment: counts, the first findings, and how many more there are."""
    own = report_lines(findings)
    counts = {r["severity"]: r["n"] for r in own.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    first = own.orderBy("file_path", "line_number", "rule_id").limit(most).collect()
    total = sum(counts.values())
    head = ", ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES) if s in counts) or "none"
    more = [f"\n…and {total - most} more"] if total > most else []
    return "\n".join([f"**{total} findings** ({head})", "", *(r["markdown"] for r in first), *more])


def annotations(findings: DataFrame, most: int = 50) -> DataFrame:
    """The first findings as annotations of a check run."""
    level = F.when(F.lower("severity").isin("critical", "high"), F.lit("failure")).when(F.lower("severity") == "medium", F.lit("warning")).otherwise(F.lit("notice"))
    return complete(findings).orderBy("file_path", "line_number", "rule_id").limit(most).select(F.col("file_path").alias("path"), F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), level.alias("annotation_level"), "message", F.col("rule_id").alias("title"))
