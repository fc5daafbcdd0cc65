"""Helpers that the corpus operators share: tables, the shared scratch folder, words, and joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot if it holds at least 1/HOT_SHARE of all rows; there can be no more than HOT_SHARE such keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a temporary one will do on one
    machine; on a cluster it is an error, since executors elsewhere couldn't read what one of them writes."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this program has written beside its results, and tables of the catalog that name some of them.
_scratch: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_table(name: str) -> str:
    """A new name for a table of the catalog."""
    _tables.append(f"{name}_{uuid.uuid4().hex}")
    return _tables[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete all that operators of this program have stored on the way; the number of folders. Call it when no result is
    needed any more that hasn't been stored elsewhere: results are lazy and read those folders."""
    for name in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _tables.clear()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _scratch):
        path.getFileSystem(conf).delete(path, True)
    n = len(_scratch)
    _scratch.clear()
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, groups: int = 0, amount: str | None = None) -> DataFrame:
    """df, stored, with nth: each row's place (from 0) in the order of the columns `order`, nulls first, among the rows
    that agree in the first `groups` of them; total: how many those are. With amount (a column of whole numbers), also
    before: its sum over the rows ahead, and amount: its sum over all of them, with the column itself kept.

    No task sees all rows: they are dealt into ranges of the whole order, and only the ranges' sums, a row for each range
    and group, are added up. Rows that agree in the whole order are dealt out by where they were stored.
    """
    tie, seq, part = new_names(df, "tie", "seq", "part")
    keys = [*order, tie]
    rows = materialize(df.withColumn(tie, F.monotonically_increasing_id()), name)
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn(seq, F.monotonically_increasing_id())
    dealt = materialize(dealt.drop(tie).withColumn(part, F.shiftright(seq, 33)).withColumn(seq, F.col(seq).bitwiseAND(F.lit((1 << 33) - 1))), name)
    group = order[:groups]
    first, n, sums, ahead, total, before, whole = new_names(dealt, "first", "n", "sums", "ahead", "total", "before", "whole")
    own = F.sum(amount).alias(sums) if amount else F.lit(0).alias(sums)
    runs = dealt.groupBy(*group, part).agg(F.min(seq).alias(first), F.count("*").alias(n), own)
    up, everything = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    runs = runs.withColumns({
        ahead: F.coalesce(F.sum(n).over(up), F.lit(0)), total: F.sum(n).over(everything),
        before: F.coalesce(F.sum(sums).over(up), F.lit(0)), whole: F.sum(sums).over(everything),
    })
    renamed = [f"{part}g{i}" for i in range(groups)]
    runs = materialize(runs.select(*[F.col(g).alias(r) for g, r in zip(group, renamed, strict=True)], F.col(part).alias(part + "r"), first, ahead, total, before, whole), name)
    same = F.col(part) == F.col(part + "r")
    for g, r in zip(group, renamed, strict=True):
        same &= F.col(g).eqNullSafe(F.col(r))
    out = dealt.join(runs, same)
    added = [(F.col(ahead) + F.col(seq) - F.col(first)).alias("nth"), F.col(total).alias("total")]
    if amount:
        inner = F.sum(amount).over(W.partitionBy(*group, part).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn(sums, inner)
        added += [(F.col(before) + F.coalesce(F.col(sums), F.lit(0))).alias("before"), F.col(whole).alias("amount")]
    return out.select(*df.columns, *added)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for temporary use that clash with none of df's (Spark ignores case)."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "x"
    return [f"{prefix}_{name}" for name in names]


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def join_unique(rows: DataFrame, unique: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once and the key's number of rows in column `count`.

    Keys with at least total / HOT_SHARE rows are joined by broadcast (there are at most HOT_SHARE of them, so the
    broadcast is bounded); the rest, none of them hot, by an ordinary shuffle join.
    """
    hot = F.broadcast(unique.where((F.col(count) > 1) & (F.col(count) * HOT_SHARE >= F.lit(total))))
    rest = unique.where((F.col(count) <= 1) | (F.col(count) * HOT_SHARE < F.lit(total)))
    hot_keys = hot.select(key)
    return rows.join(hot, key).unionByName(rows.join(hot_keys, key, "left_anti").join(rest, key))


def select_rows(docs: DataFrame, picks: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs whose doc_id and digest are among picks (doc_id, digest, copies), with all columns; of rows that
    repeat both, one stays where copies is above 1, and all where it is 1. Id and digest are the key, so no key is hot."""
    ident, dig, copies, own = new_names(docs, "id", "digest", "copies", "own")
    wanted = picks.select(F.col("doc_id").alias(ident), F.col("digest").alias(dig), F.col("copies").alias(copies))
    rows = docs.withColumn(own, digest)
    joined = rows.join(wanted, (F.col(own) == F.col(dig)) & rows["doc_id"].cast("long").eqNullSafe(F.col(ident)))
    once = joined.where(F.col(copies) == 1).select(*docs.columns)
    again = joined.where(F.col(copies) > 1).dropDuplicates([dig, ident]).select(*docs.columns)
    return once.unionByName(again)
