"""Scans in a store that holds each of them once, however often it is written.

A scan's findings are a partition of their own, which is staged and put in place as a whole; writing it again replaces it.
The scan's own row comes last: without it the findings aren't shown, so a write that failed half way is as if it had never
been. Deleting a scan takes its row first, then its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScanStore:
    """Scans (scan_run_id and what else is known of them) and their findings below `path`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_run_id").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        # ids stay texts, whatever they look like
        conf = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, "false")
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(conf, before)

    def write_findings(self, findings: DataFrame) -> None:
        """The findings of the scans in column scan_run_id, in place of those that they had."""
        self._replace(findings, "findings")

    def save(self, scans: DataFrame, findings: DataFrame) -> None:
        """Scans (one row each) with their findings. A scan without findings has none, whatever it had before."""
        ids = [r.scan_run_id for r in scans.select("scan_run_id").collect()]
        empty = set(ids) - {r.scan_run_id for r in findings.select("scan_run_id").distinct().collect()}
        for scan_run_id in empty:
            self._drop("findings", scan_run_id)
        self.write_findings(findings)
        self._replace(scans, "scans")

    def _drop(self, name: str, scan_run_id: str) -> bool:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        place, files = self._place(f"{name}/scan_run_id={escape(scan_run_id)}")
        return files.delete(place, True)

    def delete(self, scan_run_id: str) -> bool:
        """Whether there was such a scan."""
        there = self._drop("scans", scan_run_id)
        self._drop("findings", scan_run_id)
        return there

    def scans(self) -> DataFrame:
        return self._read("scans")

    def findings(self) -> DataFrame:
        """Findings of all scans whose writing has come to its end."""
        return self._read("findings").join(self.scans().select("scan_run_id"), "scan_run_id", "left_semi")
