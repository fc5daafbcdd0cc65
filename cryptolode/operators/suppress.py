"""Suppression: excluded paths, and directives inside files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.regex_dialect import ignore_to_regex, to_java
from ..functions.scalars import strip

#: The word that a comment has to suppress findings.
MARKER = "crypto-ignore"
# fixed values: folders at the root that are excluded last, whatever came before
DEFAULT_EXCLUDES = (
    ".git .svn .hg node_modules vendor bower_components bin obj build dist target out __pycache__ .pytest_cache .tox .idea .vscode .vs .terraform"
).split()


def parse_ignore(text: str, defaults: bool = True) -> list[tuple[str, bool, bool]]:
    """(regex, negated, only folders) of an ignore file's lines, in order, with the default folders at the end."""
    found = [x.strip() for x in text.splitlines()]
    found = [x for x in found if x and not x.startswith("#")] + [f"/{d}/" for d in DEFAULT_EXCLUDES if defaults]
    out = []
    for line in found:
        negated = line.startswith("!")
        line = line.removeprefix("!")
        folders, line = line.endswith("/"), line.removesuffix("/")
        rooted, line = line.startswith("/"), line.removeprefix("/")
        out.append((ignore_to_regex(line, rooted), negated, folders))
    return out


def last_match(target: Column, patterns: list[tuple[str, bool, bool]], folder: bool) -> Column:
    """Whether the last pattern that matches excludes; a folder pattern sees a file's folder."""
    out = F.lit(False)
    parent = F.when(F.contains(target, F.lit("/")), F.regexp_replace(target, "/[^/]*$", ""))
    for regex, negated, folders in patterns:
        seen = parent if folders and not folder else target
        out = F.when(F.coalesce(seen.rlike(to_java(regex)), F.lit(False)), F.lit(not negated)).otherwise(out)
    return out


def is_excluded(path: Column, patterns: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file is excluded, itself or by a folder above it: an excluded folder is never entered, so nothing
    inside can be taken back."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    pruned = F.exists(above, lambda d: last_match(d, patterns, True)) & (F.size(parts) > 1)
    return pruned | last_match(path, patterns, False)


def directive(line: Column, marker: str = MARKER) -> Column:
    """A line's directive: null if it has none, an array of rule ids, or an array with `*` for all rules."""
    # fixed value: what a directive looks like
    rx = rf"{re.escape(marker)}(?:\s*:\s*([A-Za-z0-9_\-,\s]+))?"
    named = F.regexp_extract(line, to_java(rx), 1)
    ids = F.filter(F.transform(F.split(named, ","), strip), lambda x: x != "")
    return F.when(F.contains(line, F.lit(marker)), F.when(named == "", F.array(F.lit("*"))).otherwise(ids))


def directives(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """lines (path, line_number, line) with `suppressed`: the directive in force, a line's own before the last line's."""
    own = directive(F.col("line"), marker)
    before = W.partitionBy("path").orderBy("line_number")
    return lines.withColumn("own", own).withColumn("suppressed", F.coalesce("own", F.lag("own").over(before))).drop("own")


def covered(line: Column, before: Column, rule_id: Column, marker: str = MARKER) -> Column:
    """Whether a directive of a finding's line, or else of the line before it, covers the finding's rule."""
    ids = F.coalesce(directive(line, marker), directive(before, marker))
    return F.coalesce(F.array_contains(ids, "*") | F.array_contains(ids, rule_id), F.lit(False))


def unsuppressed_matches(matches: DataFrame, marker: str = MARKER) -> DataFrame:
    """Matches (line_number, rule_id, snippet, snippet_context) that no directive covers: the line before a match is in its
    context, so no text is read again."""
    at = F.least(F.col("line_number"), F.lit(4)) - 1
    before = F.when(at > 0, F.element_at("snippet_context", F.greatest(at, F.lit(1))))
    return matches.where(~covered(F.col("snippet"), before, F.col("rule_id"), marker))


def unsuppressed(findings: DataFrame, lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """Findings (file_path, line_number, rule_id) that no directive of their file's lines covers.

    Only lines with a directive are joined, each with the line below it; where both have one, the line's own counts.
    """
    found = lines.select("path", "line_number", directive(F.col("line"), marker).alias("ids")).where("ids is not null")
    spread = found.select(F.col("path").alias("file_path"), F.explode(F.array(F.struct(F.col("line_number"), F.lit(0).alias("far"), "ids"), F.struct((F.col("line_number") + 1).alias("line_number"), F.lit(1).alias("far"), "ids"))).alias("d"))
    force = spread.groupBy("file_path", F.col("d.line_number").alias("line_number")).agg(F.min_by("d.ids", "d.far").alias("ids"))
    joined = findings.join(force, ["file_path", "line_number"], "left")
    covered = F.array_contains("ids", "*") | F.array_contains(F.col("ids"), F.col("rule_id"))
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("ids")
