"""Detection on files as they arrive (an extension: the batch functions, on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.scalars import fingerprint
from ..operators.detect import detect_literal
from ..sources.files import language

ARRIVALS = "path string, text string, arrived timestamp"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files described by JSON lines (path, text, arrived) in a folder."""
    return spark.readStream.schema(ARRIVALS).json(folder).withColumn("language", language(F.col("path")))


def detect_once(files: DataFrame, rules: list[tuple[str, str]], delay: str = "1 hour") -> DataFrame:
    """Findings of arriving files, each fingerprint once within the delay; state is bounded by the watermark."""
    found = detect_literal(files.withWatermark("arrived", delay), rules, keep=("arrived",))
    marked = found.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("path"), F.col("snippet"), F.col("line_number")))
    return marked.dropDuplicatesWithinWatermark(["fingerprint"])


def write(findings: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of Parquet files with exactly-once output."""
    return findings.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
