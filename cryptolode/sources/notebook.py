"""Notebooks: code cells as lines that know their cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELLS = "cells array<struct<cell_type string, source variant>>"


def cell_lines(files: DataFrame) -> DataFrame:
    """path, cell (from 0 among all cells), cell_line (from 1), line and line_number: its place in the code cells put
    together with an empty line between them. A cell's source is a string or an array of strings; what isn't a notebook
    has no lines."""
    cells = files.select("path", F.from_json("text", CELLS).alias("n")).select("path", F.posexplode("n.cells").alias("cell", "c")).where("c.cell_type = 'code'")
    many = F.expr("try_variant_get(c.source, '$', 'array<string>')")
    text = F.coalesce(F.array_join(many, ""), F.expr("try_variant_get(c.source, '$', 'string')"), F.lit(""))
    split = cells.select("path", "cell", F.split(F.regexp_replace(text, "\n$", ""), "\n").alias("lines"))
    above = W.partitionBy("path").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    placed = split.withColumn("above", F.coalesce(F.sum(F.size("lines") + 1).over(above), F.lit(0)))
    each = placed.select("path", "cell", "above", F.posexplode("lines").alias("nth", "line"))
    return each.select("path", "cell", (F.col("nth") + 1).alias("cell_line"), "line", (F.col("above") + F.col("nth") + 1).cast("int").alias("line_number"))


def as_source(files: DataFrame) -> DataFrame:
    """path, language (python) and text of notebooks' code, for the structural detectors."""
    each = cell_lines(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cell", "cell_line", "line"))).alias("rows"))
    gap = lambda r, i: F.when((i > 0) & (r["cell_line"] == 1), F.concat(F.lit("\n"), r["line"])).otherwise(r["line"])
    return each.select("path", F.lit("python").alias("language"), F.array_join(F.transform("rows", gap), "\n").alias("text"))


def in_cells(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings in notebooks' code with their cell, its line, and the cell before the snippet."""
    place = cells.select(F.col("path").alias("file_path"), "line_number", "cell", "cell_line")
    joined = findings.join(place, ["file_path", "line_number"])
    return joined.withColumn("snippet", F.concat(F.format_string("[cell %d] ", "cell"), "snippet"))
