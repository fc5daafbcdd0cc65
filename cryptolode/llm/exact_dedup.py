"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per digest, then sort-merge
anti-joined with the index (whose side needs no shuffle: it is read by bucket), and what is new is appended with the
batch's name. A batch that is added again under its name (because its result was lost before it was stored) finds what
others have added, and not itself, so it keeps the same rows. A table is deduplicated in batches of descending doc_id
against one index, so the row with the largest doc_id stays and all later batches meet a filled index.

Defined results: null text counts as empty; texts of any length are compared whole, by SHA-256; texts are equal when
identical after lower-casing A-Z only; of equal texts of a batch the row with the largest doc_id stays (null ids are the
smallest); rows that repeat both doc_id and text are one group of which one row is marked kept; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

import functools
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialize, scratch_path, scratch_table, select_rows


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """The persistent index: Parquet files of `buckets` buckets at `path`, registered in the session's catalog.

    Opening an existing path registers its files again, so the index outlives sessions and catalogs; `drop_scratch` only
    takes its name out of the catalog.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 12) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = scratch_table("digest_index")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add groups, each bucket's rows in one sorted file."""
        out = groups.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        (
            out.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """groups: digest and keep_id, one row per digest. Those that no other batch has added (a sort-merge anti-join), and
        append them unless this batch has added them before."""
        # stored, or else the optimiser moves the anti-join below their aggregation, where a text with many copies is hot
        groups = materialize(groups.select("digest", "keep_id"), "text-groups")
        others = self.rows().where(F.col("batch") != batch).select("digest")
        fresh = materialize(groups.join(others.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch)), "fresh")
        mine = self.rows().where(F.col("batch") == batch).select("digest")
        self.append(fresh if mine.isEmpty() else fresh.join(mine.hint("merge"), "digest", "left_anti"))
        return fresh

    def drop(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def index_for(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """A new, empty index in the shared folder; buckets follow the session's shuffle partitions unless given."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Batches in which a table is added.
BATCHES = 2


def add_table(docs: DataFrame, index: DigestIndex, batch: str, batches: int = BATCHES) -> DataFrame:
    """Deduplicate docs (doc_id, text) within themselves and against the index, in batches of descending doc_id named after
    `batch`, and return digest, doc_id, copies (rows with that id and text), keep_id, group_size (rows of docs with that
    text) and fresh (false if the index had the text before)."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"))
    members = materialize(keys.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
    shares = F.array(*[F.lit(n / batches) for n in range(batches - 1, 0, -1)])
    total, cuts = members.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.percentile_approx("doc_id", shares)).first()
    edges = sorted(set(cuts or []), reverse=True)
    fresh = []
    for n, (low, high) in enumerate(zip([*edges, None], [None, *edges], strict=True)):
        own = members.where(F.col("doc_id") >= low) if low is not None else members.where("true")
        own = own.where((F.col("doc_id") < high) | F.col("doc_id").isNull()) if high is not None else own
        fresh.append(index.add(own.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), f"{batch}-{n}"))
    sizes = materialize(members.groupBy("digest").agg(F.sum("copies").alias("group_size")), "text-sizes")
    # after the last append, keep_id of every digest of docs is in the index
    known = sizes.join(index.rows().select("digest", "keep_id"), "digest")
    new = functools.reduce(DataFrame.unionByName, fresh).select("digest", F.lit(True).alias("fresh"))
    known = known.join(new, "digest", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return join_unique(members, known, "digest", "group_size", total)


def dedup_report(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. batch: the name under which docs are added
    to the index; give the same one when a run is repeated."""
    found = add_table(docs, index or index_for(docs.sparkSession), batch or uuid.uuid4().hex)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = add_table(docs, index or index_for(docs.sparkSession), batch or uuid.uuid4().hex)
    stay = found.where(F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest", "copies")
    return select_rows(docs, stay, digest("text"))
