"""Rule packs: YAML files, as rows of RULE_SCHEMA."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex_dialect import to_java, to_python
from ..functions.scalars import quantum_safety, rule_confidence
from ..schema import FINDING_SCHEMA, RULE_SCHEMA, SEVERITIES

PACK = str(Path(__file__).parent.parent / "rules")


def parse_rules(text: str, source: str = "") -> list[dict]:
    """The rules of one file, a list or a single mapping; raises on a rule that can't be used."""
    import yaml

    loaded = yaml.safe_load(text)
    rules = loaded if isinstance(loaded, list) else [loaded or {}]
    for rule in rules:
        detector = rule.get("detector") or {}
        wanted = {"regex": "pattern", "ast": "query"}.get(detector.get("type", ""))
        missing = [k for k in ("id", "language", "severity") if not rule.get(k)]
        if missing or not wanted or not detector.get(wanted) or rule["severity"] not in SEVERITIES:
            raise ValueError(f"{source}: rule {rule.get('id')!r} lacks {missing or wanted or 'a known detector'}, or its severity is unknown")
        if wanted == "pattern":
            to_java(detector["pattern"]), to_python(detector["pattern"], detector.get("flags", ""))
    return rules


def load_rules(spark: SparkSession, folder: str = PACK) -> DataFrame:
    """All rules of a folder's YAML files, numbered in the lexical order of files, with classes and confidences filled
    in. A pack is read by the driver: it is a program's configuration, not data."""
    rows = []
    for path in sorted(Path(folder).rglob("*.y*ml")):
        for rule in parse_rules(path.read_text(), str(path)):
            d, examples = rule["detector"], rule.get("examples") or {}
            rows.append((
                len(rows), rule["id"], rule["language"], rule.get("category", ""), rule.get("layer", ""), rule["severity"], rule.get("algorithm", ""),
                rule.get("usage_type", ""), rule.get("quantum_safe"), rule.get("quantum_safety"), rule.get("key_size"), d["type"], d.get("pattern", ""), d.get("query", ""),
                d.get("flags", ""), rule.get("message", ""), rule.get("recommendation", ""), rule.get("references") or [], rule.get("cwe") or [],
                float(rule.get("confidence") or 0), rule.get("file_globs") or [], examples.get("match") or [], examples.get("no_match") or [],
            ))
    rules = spark.createDataFrame(rows, RULE_SCHEMA)
    filled = rules.withColumn("quantum_safety", quantum_safety(F.col("quantum_safety"), F.col("quantum_safe")))
    return filled.withColumn("confidence", rule_confidence(F.col("confidence"), F.col("detector_type")))


def load_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of an overlay folder's YAML files (a list or a single mapping each), for `lifecycle.enrich`: numbered in the
    lexical order of files, so that the last entry of a rule wins. A folder that isn't there has none; an entry without a
    rule_id in a list is an error, a file with a single mapping without one is passed over."""
    import yaml

    from ..operators.lifecycle import OVERLAY_LISTS, OVERLAY_TEXTS

    rows: list[tuple] = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix.lower() in (".yaml", ".yml")) if folder and Path(folder).exists() else []:
        loaded = yaml.safe_load(path.read_text())
        for entry in loaded if isinstance(loaded, list) else [loaded] if (loaded or {}).get("rule_id") else []:
            if not entry.get("rule_id"):
                raise ValueError(f"{path}: an entry without rule_id")
            rows.append((len(rows), entry["rule_id"], *[entry.get(c) or "" for c in OVERLAY_TEXTS], *[entry.get(c) or [] for c in OVERLAY_LISTS]))
    kinds = {f.name: f.dataType.simpleString() for f in FINDING_SCHEMA.fields}
    fields = [f"`{c}` {kinds.get(c, 'string')}" for c in OVERLAY_TEXTS] + [f"`{c}` {kinds.get(c, 'array<string>')}" for c in OVERLAY_LISTS]
    return spark.createDataFrame(rows, ", ".join(["ordinal int", "rule_id string", *fields]))


def languages(rules: DataFrame) -> DataFrame:
    return rules.select("language").distinct()


def self_test(rules: DataFrame) -> DataFrame:
    """Examples that a rule gets wrong: rule_id, example, expected."""

    def examples(column: str, expected: bool) -> Column:
        return F.transform(F.array_distinct(column), lambda x: F.struct(x.alias("example"), F.lit(expected).alias("expected")))

    # each list by itself: a union of structs would compare all with all
    both = F.concat(examples("examples_match", True), examples("examples_no_match", False))
    each = rules.where("detector_type = 'regex'").select("rule_id", "pattern", "flags", F.explode(both).alias("e")).select("rule_id", "pattern", "flags", "e.*")
    each = each.repartition("rule_id", "example")  # a rule may have any number

    @F.pandas_udf("boolean")
    def found(pattern: pd.Series, flags: pd.Series, example: pd.Series) -> pd.Series:
        compiled = {k: to_python(*k) for k in set(zip(pattern, flags, strict=True))}
        return pd.Series([bool(compiled[p, f].search(x)) for p, f, x in zip(pattern, flags, example, strict=True)])

    return each.where(found("pattern", "flags", "example") != F.col("expected")).select("rule_id", "example", "expected")


def without_examples(rules: DataFrame) -> DataFrame:
    return rules.where((F.size("examples_match") == 0) & (F.size("examples_no_match") == 0)).select("rule_id").distinct()


def coverage_ratchet(rules: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules newly without examples, and accepted ones that have examples now (accepted: rule_id)."""
    bare = without_examples(rules)
    return bare.join(accepted, "rule_id", "left_anti"), accepted.join(bare, "rule_id", "left_anti")
