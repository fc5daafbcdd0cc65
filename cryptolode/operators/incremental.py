"""A table of findings that follows a changing tree: only contents that are new are read and scanned again.

Beside the findings stands a row for each file: path, version (what a listing tells without opening the file, such as its
time and size) and digest of the content. A refresh compares the listing with those rows, reads the files whose version has
changed, scans those whose digest has, and takes back the findings of files that are gone. Both tables are partitioned by a
hash of the path; only partitions with a change are written, each as a whole.

Findings are written before the rows of files. A refresh that is lost in between finds the same files changed again and
writes the same partitions, so nothing is doubled or lost. A scan whose findings depend on their own file alone, as `scan`'s
do, gives the same findings as a scan of the whole tree.

Defined results: an unchanged listing writes nothing; a file with a new version and the same content is read and not scanned;
a file that is listed and can't be read keeps what it had, and is tried again; a file without findings has a row all the
same; null versions are equal; a path is one file.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import stored

BUCKETS = 64
FILES = "path string, version string, digest string, bucket int"


@dataclasses.dataclass(frozen=True)
class Refreshed:
    """How many files were listed, read, scanned, and found to be gone."""

    listed: int
    read: int
    scanned: int
    gone: int


class ScanTable:
    """Findings of a tree at `path`, a folder that the cluster shares. schema: of the findings (file_path among them)."""

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).schema

    def _table(self, name: str, schema) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """path, version, digest and bucket of all files."""
        return self._table("files", FILES).where("path IS NOT NULL")

    def findings(self) -> DataFrame:
        return self._table("findings", self.schema).where("file_path IS NOT NULL").drop("bucket")

    def _bucket(self, path: str):
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _replace(self, name: str, schema, key: str, old: DataFrame, paths: DataFrame, new: DataFrame) -> None:
        """In table `name`, the rows of these paths (path) by those of new. A partition that loses its last row keeps one
        without a path, or else it would not be written."""
        touched = stored(paths.select(self._bucket("path").alias("bucket")).distinct(), "buckets")  # BUCKETS rows at most
        kept = old.join(F.broadcast(touched), "bucket").join(paths.select(F.col("path").alias(key)), key, "left_anti")
        rows = kept.unionByName(new.withColumn("bucket", self._bucket(key)), allowMissingColumns=True).unionByName(touched, allowMissingColumns=True)
        rows = stored(rows.select(*[f.name for f in self.spark.createDataFrame([], schema).schema.fields]), name)  # the table is read for it
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def refresh(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame]) -> Refreshed:
        """listing: path and version of all files that there are. read: from paths (path) their files (path, content, and what
        else scan needs). scan: from files their findings."""
        now, known = stored(listing.select("path", F.col("version").cast("string").alias("version")), "listing"), self.files()
        own = known.select("path", F.col("version").alias("had"), F.col("digest").alias("old"), F.lit(True).alias("known"))
        compared = now.join(own, "path", "left")
        changed = stored(compared.where(F.col("known").isNull() | ~F.col("version").eqNullSafe(F.col("had"))).select("path", "version", "old"), "changed")
        gone = stored(known.join(now, "path", "left_anti").select("path"), "gone")
        contents = stored(read(changed.select("path")).withColumn("digest", F.sha2("content", 256)), "contents")
        seen = stored(contents.select("path", "digest").join(changed, "path"), "seen")
        fresh = seen.where(~F.col("digest").eqNullSafe(F.col("old"))).select("path")
        counts = Refreshed(now.count(), seen.count(), fresh.count(), gone.count())
        if counts.scanned or counts.gone:
            found = scan(contents.join(fresh, "path", "left_semi").drop("digest"))
            self._replace("findings", self.schema, "file_path", self._table("findings", self.schema).where("file_path IS NOT NULL"), fresh.unionByName(gone), found.select(*[c for c in self.schema.names if c != "bucket"]))
        if counts.read or counts.gone:
            self._replace("files", FILES, "path", known, seen.select("path").unionByName(gone), seen.select("path", "version", "digest"))
        return counts
