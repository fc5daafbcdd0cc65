"""Findings over time: filters, enrichment, baselines, comparisons, scans."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import fingerprint
from ..schema import is_risk, threshold_rank

OVERLAY_TEXTS = ("recommendation", "migration_target", "vertical_context")
OVERLAY_LISTS = ("references", "cwe")
# fixed value: folders that the explorer hides as vendored
VENDORED = r"(^|/)(node_modules|vendor|third_party|bower_components|dist|build)/"


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above; an unknown threshold is the lowest."""
    return findings.where(threshold_rank(F.col("severity")) >= threshold_rank(F.lit(severity)))


def exit_code(findings: DataFrame, level: str) -> DataFrame:
    """One row: exit_code, 1 if any finding reaches the level, which an empty level always is."""
    reached = F.max(threshold_rank(F.col("severity")))
    return findings.agg(F.when(F.coalesce(reached, F.lit(-1)) >= threshold_rank(F.lit(level)), 1).otherwise(0).alias("exit_code"))


def include_only(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def explore(findings: DataFrame, severities: list[str] | None = None, algorithm: str | None = None, path_part: str = "", hide_vendored: bool = True) -> DataFrame:
    """The explorer's filters, together."""
    keep = F.lit(True)
    if severities:
        keep &= F.col("severity").isin(*severities)
    if algorithm is not None:
        keep &= F.col("algorithm") == algorithm
    if path_part:
        keep &= F.contains(F.lower("file_path"), F.lit(path_part.lower()))
    if hide_vendored:
        keep &= ~F.col("file_path").rlike(VENDORED)
    return findings.where(keep)


def adapted(findings: DataFrame) -> DataFrame:
    """For display: an unknown severity is medium, a missing algorithm a dash."""
    known = F.col("severity").isin("critical", "high", "medium", "low", "info")
    return findings.withColumns({"severity": F.when(known, F.col("severity")).otherwise(F.lit("medium")), "algorithm": F.coalesce("algorithm", F.lit("—"))})


def page(rows: DataFrame, order: list[Column], number: int, size: int, total: int) -> DataFrame:
    """A page, counted from 1 and brought into range."""
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def facet(findings: DataFrame, column: str) -> DataFrame:
    """Values of a column and their counts."""
    return findings.groupBy(column).agg(F.count("*").alias("n"))


def all_facets(findings: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """facet, value and n: for each column of filters (column: what is chosen there; F.lit(True) for everything) its values,
    each counted under the filters of all other columns, as explorers show what else could be chosen.

    One pass with grouping sets, a set a column. A value that nothing has under the others' filters isn't listed.
    """
    columns, chosen = list(filters), [F.coalesce(c, F.lit(False)) for c in filters.values()]
    passes = [functools.reduce(Column.__and__, [c for j, c in enumerate(chosen) if j != i], F.lit(True)) for i in range(len(columns))]
    # names of their own, so that a filter may look at a column that is grouped by
    flagged = findings.select(*[F.col(c).cast("string").alias(f"value_{i}") for i, c in enumerate(columns)], *[p.alias(f"passes_{i}") for i, p in enumerate(passes)])
    values = [F.col(f"value_{i}") for i in range(len(columns))]
    counted = flagged.groupingSets([[v] for v in values], *values).agg(
        F.grouping_id().alias("left_out"), *[F.count_if(F.col(f"passes_{i}")).alias(f"n_{i}") for i in range(len(columns))]
    )
    everything = (1 << len(columns)) - 1
    kept = [F.struct(F.lit(everything - (1 << len(columns) - 1 - i)).alias("left_out"), F.lit(c).alias("facet"), v.alias("value"), F.col(f"n_{i}").alias("n")) for i, (c, v) in enumerate(zip(columns, values, strict=True))]
    own = F.filter(F.array(*kept), lambda k: k["left_out"] == F.col("left_out"))[0]
    return counted.select(own.alias("k")).select("k.facet", "k.value", "k.n").where("n > 0")


def top_and_other(findings: DataFrame, column: str, most: int = 8) -> DataFrame:
    """The most frequent values (ties by value) and all others as `other`."""
    counts = facet(findings, column)
    first = counts.orderBy(F.col("n").desc(), column).limit(most).select(column, F.lit(True).alias("top"))
    named = counts.join(F.broadcast(first), column, "left").select(F.when(F.col("top"), F.col(column)).otherwise(F.lit("other")).alias("label"), "n")
    return named.groupBy("label").agg(F.sum("n").alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.lower("severity").alias("severity")).agg(F.count("*").alias("n"))


def enrich(findings: DataFrame, overlay: DataFrame) -> DataFrame:
    """Findings with empty fields filled from the overlay of their rule (the entry of the highest `ordinal`, if several),
    and enriched: whether any field was."""
    fields = [*OVERLAY_TEXTS, *OVERLAY_LISTS]
    last = overlay.groupBy("rule_id").agg(F.max_by(F.struct(*fields), "ordinal").alias("o"))
    joined = findings.join(last, "rule_id", "left")
    filled, any_filled = {}, F.lit(False)
    for c in fields:
        text = c in OVERLAY_TEXTS
        empty = F.coalesce(F.col(c), F.lit("")) == "" if text else F.coalesce(F.size(c), F.lit(0)) <= 0
        there = F.coalesce(F.col(f"o.{c}"), F.lit("")) != "" if text else F.coalesce(F.size(f"o.{c}"), F.lit(0)) > 0
        filled[c] = F.when(empty & there, F.col(f"o.{c}")).otherwise(F.col(c))
        any_filled |= empty & there
    return joined.withColumn("enriched", any_filled).withColumns(filled).drop("o")


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("line_number")))


def baseline(findings: DataFrame) -> DataFrame:
    """One row per fingerprint: fingerprint, rule_id, file_path; in files, by path and fingerprint."""
    first = F.min(F.struct("file_path", "rule_id"))
    return with_fingerprint(findings).groupBy("fingerprint").agg(first.alias("f")).select("fingerprint", "f.rule_id", "f.file_path")


def beyond_baseline(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't accepted; all of several with one fingerprint."""
    return with_fingerprint(findings).join(accepted.select("fingerprint").distinct(), "fingerprint", "left_anti")


def accepted_count(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    return with_fingerprint(findings).join(accepted.select("fingerprint").distinct(), "fingerprint", "left_semi").agg(F.count("*").alias("suppressed"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """Keys that are new, modified or removed between two snapshots: one full join on the key."""
    joined = before.select(F.col(key).alias(key), F.col(digest).alias("_before")).join(after.select(F.col(key).alias(key), F.col(digest).alias("_after")), key, "full")
    state = F.when(F.col("_before").isNull(), F.lit("new")).when(F.col("_after").isNull(), F.lit("removed")).when(F.col("_before") != F.col("_after"), F.lit("modified"))
    return joined.select(key, state.alias("state")).where("state is not null")


def expand_importers(changes: DataFrame, imported: DataFrame) -> DataFrame:
    """changes (path, state) and the files that import one of them (imported: path, module), as modified.

    A file is meant by the last component of the module that is imported, compared with its name without extension.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.[^.]*$", "")
    stems = changes.where("state <> 'removed'").select(stem.alias("stem")).distinct()
    users = imported.select("path", F.regexp_extract("module", r"[^/]*$", 0).alias("stem")).join(stems, "stem", "left_semi").select("path").distinct()
    return changes.unionByName(users.join(changes, "path", "left_anti").withColumn("state", F.lit("modified")))


def with_blame(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """Findings with author and commit of their line (blame: path, line, author, commit)."""
    own = blame.select(F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.col("author").alias("git_blame_author"), F.col("commit").alias("git_blame_commit"))
    return findings.drop("git_blame_author", "git_blame_commit").join(own, ["file_path", "line_number"], "left")


def latest(rows: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """The latest row of each group: an aggregation, so a group of any size comes down to a row before it moves."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), F.struct(at, tie)).alias("r")).select(by, "r.*")


def most_recent(rows: DataFrame, at: str, tie: str, n: int = 50) -> DataFrame:
    """The last n rows, latest first: each task sends n of its own at most."""
    return rows.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def by_score(findings: DataFrame, score: str = "score") -> DataFrame:
    """Findings by falling score, then place; an ordering by ranges, so no task sorts all."""
    return findings.orderBy(F.col(score).desc(), "file_path", "line_number", "finding_id")


def score_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprint and event: created, updated (another score) or resolved, between two scans (fingerprint, score)."""
    joined = before.groupBy("fingerprint").agg(F.max("score").alias("old")).join(after.groupBy("fingerprint").agg(F.max("score").alias("new")), "fingerprint", "full")
    event = F.when(F.col("old").isNull(), F.lit("created")).when(F.col("new").isNull(), F.lit("resolved")).when(F.col("old") != F.col("new"), F.lit("updated"))
    return joined.select("fingerprint", event.alias("event"), F.col("old").alias("old_score"), F.col("new").alias("new_score")).where("event is not null")


def score_history(sightings: DataFrame, patience_ms: int, until: Column, at: str = "scanned_at") -> DataFrame:
    """Events (fingerprint, at, event, old_score, new_score) of sightings (fingerprint, score, and the scan's time) before `until`:
    created, updated (another score), and resolved where a fingerprint isn't seen for longer than the patience.

    The rows of `streaming.score_stream`, with the same defined results, from a table. A fingerprint's scans are sorted in one
    task, a row for each scan, however often it was seen there.
    """
    own = sightings.where(F.col("fingerprint").isNotNull()).select("fingerprint", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), F.unix_millis(at).alias("at"))
    scans = own.where(F.col("at") < F.unix_millis(until)).groupBy("fingerprint", "at").agg(F.max("score").alias("score"))
    order = W.partitionBy("fingerprint").orderBy("at")
    gone = F.col("at") + patience_ms
    around = scans.withColumns({"before": F.lag("at").over(order), "old": F.lag("score").over(order), "after": F.lead("at").over(order)})
    fresh = F.col("before").isNull() | (F.col("at") > F.col("before") + patience_ms)
    seen = F.when(fresh, F.lit("created")).when(~F.col("score").eqNullSafe(F.col("old")), F.lit("updated"))
    given_up = (F.col("after").isNull() | (F.col("after") > gone)) & (gone < F.unix_millis(until))
    rows = F.array(
        F.when(seen.isNotNull(), F.struct(F.col("at").alias("at"), seen.alias("event"), F.when(~fresh, F.col("old")).alias("old_score"), F.col("score").alias("new_score"))),
        F.when(given_up, F.struct(gone.alias("at"), F.lit("resolved").alias("event"), F.col("score").alias("old_score"), F.lit(None).cast("double").alias("new_score"))),
    )
    each = around.select("fingerprint", F.explode(F.array_compact(rows)).alias("e"))
    return each.select("fingerprint", F.timestamp_millis("e.at").alias("at"), "e.event", "e.old_score", "e.new_score")


def readiness(findings: DataFrame, by: list[str]) -> DataFrame:
    """Share of findings that aren't at risk, by group (an extension)."""
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~is_risk(F.col("quantum_safety"))).alias("ready")).withColumn("readiness", F.col("ready") / F.col("n"))


def trend(runs: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each run's value and its change from the run before (an extension)."""
    order = W.partitionBy(by).orderBy(at)
    return runs.withColumn("change", F.col(value) - F.lag(value).over(order))
