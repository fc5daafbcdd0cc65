"""A scan of a tree: every detector over every file that it applies to, as one findings relation.

    route -> patterns + structure -> inline suppression -> structure supersedes patterns -> promotion -> sentinel
    notebooks -> structure of their code cells        certificates -> their own reader

Each detector is one Arrow pass over whole files of its languages; what follows works on findings, not on files. A file
that a detector can't read gives none of its findings and doesn't disturb the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import complete
from ..sources import files as sources
from ..sources import notebook, x509
from . import detect, fuse, structure, suppress
from .graph import stored

#: Languages with readers of their own, which no rules of a pack are tried on.
OWN_READERS = ("x509", "jupyter")
#: Parts of a scan, in the order in which a file's findings are emitted.
LAYERS = ("structure", "pattern", "promoted", "sentinel")


def source_findings(texts: DataFrame, rules: DataFrame, marker: str = suppress.MARKER) -> DataFrame:
    """Findings of files (path, language, text) by a pack's pattern and structural rules, without those that directives
    cover; a structural finding supersedes a pattern's of the same rule and line."""
    flat, deep = (
        detect.to_findings(suppress.unsuppressed_matches(found, marker), rules) for found in (detect.detect_pack(texts, rules), structure.detect_structure(texts, rules))
    )
    return detect.supersede(flat, deep)


def promoted(findings: DataFrame) -> DataFrame:
    """Findings of several signals that agree in a file, from findings in the order of their emission."""
    position = F.col("layer_ordinal") * F.lit(1 << 60) + F.col("rule_ordinal") * F.lit(1 << 40) + F.col("line_number") * F.lit(1 << 20) + F.col("match_ordinal")
    return fuse.promote(findings.withColumn("position", position.cast("long"))).withColumn("layer_ordinal", F.lit(LAYERS.index("promoted")))


def unmapped(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """One informational finding for each file that imports a known library and in which nothing else was found."""
    hits = detect.sentinel(texts, findings)
    message = F.concat("library", F.lit(" is imported, but no use of it was recognised"))
    return hits.select(
        F.col("path").alias("file_path"), "language", "line_number", "column", "snippet", F.lit("CRYPTO_API_UNMAPPED").alias("rule_id"), F.lit("info").alias("severity"),
        F.lit("coverage-gap").alias("category"), F.lit("library").alias("usage_type"), F.lit("unknown").alias("quantum_safety"), message.alias("message"), F.lit(LAYERS.index("sentinel")).alias("layer_ordinal"),
    )


def notebook_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Structural findings of notebooks' code, at the line of their cell."""
    books = texts.where(F.col("language") == "jupyter")
    found = detect.to_findings(structure.detect_structure(notebook.as_source(books), rules.where("language = 'python'")), rules)
    placed = notebook.in_cells(found, notebook.cell_lines(books))
    return placed.withColumn("line_number", F.col("cell_line")).drop("cell", "cell_line").withColumn("layer_ordinal", F.lit(0))


def scan(files: DataFrame, rules: DataFrame, ignore: str = "", scan_job_id: str = "", marker: str = suppress.MARKER) -> DataFrame:
    """All findings of files (path, size, content), with the fields of FINDING_SCHEMA and layer_ordinal.

    ignore: the text of an ignore file. Files with a NUL in their first bytes count as empty texts. What the detectors
    find is stored, since promotion and the sentinel look at it again.
    """
    own = files.where(~suppress.is_excluded(F.col("path"), suppress.parse_ignore(ignore)))
    texts = sources.text_files(own)
    plain = texts.where(~F.col("language").isin(*OWN_READERS))
    known = rules.select("language").distinct()
    # a file of a language without rules isn't opened; rules for `any` apply to all
    plain = plain.join(F.broadcast(known), "language", "left_semi") if known.where("language = 'any'").isEmpty() else plain
    found = stored(source_findings(plain, rules, marker), "found")
    more = promoted(found)
    quiet = unmapped(plain, found)
    keys = own.where(sources.language(F.col("path")) == "x509").select("path", "content")
    parts = [found, more, quiet, notebook_findings(texts, rules), x509.findings(keys).withColumn("layer_ordinal", F.lit(0))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return complete(out.withColumn("scan_job_id", F.lit(scan_job_id)))
