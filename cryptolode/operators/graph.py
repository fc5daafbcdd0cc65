"""File graphs: imports, who depends on a file, and the reach of a change."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import blast_radius, directory, impact_band, normal_path, strip
from ..sources.files import lines

# fixed values: folders that are no part of a graph, at any depth
EXCLUDED_FOLDERS = "node_modules vendor .venv .git __pycache__ target dist build .idea .vscode".split()
JS_ENDINGS = ["", ".js", "/index.js", ".jsx", "/index.jsx", ".mjs", "/index.mjs", ".cjs", "/index.cjs", ".ts", "/index.ts", ".tsx", "/index.tsx", ".d.ts", "/index.d.ts"]
AFFECTED_LISTED = 20


def graph_files(files: DataFrame) -> DataFrame:
    """files (path, text) that belong to the graph, with their folded path as `node`."""
    folder = "(?i)(^|/)(" + "|".join(x.replace(".", r"\.") for x in EXCLUDED_FOLDERS) + ")/"
    return files.where(~F.col("path").rlike(folder)).withColumn("node", normal_path(F.col("path")))


def imported_names(rest: Column) -> Column:
    """The names of a `from m import ...`: without aliases, comments, brackets and line continuations."""
    bare = F.regexp_replace(strip(rest), r"^[()]+|[()]+$", "")
    clean = F.transform(F.split(bare, ","), lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), " as .*$", ""), "#.*$", ""), r"\\+$", "")))
    return F.filter(clean, lambda x: (x != "") & (x != "*"))


def imports(files: DataFrame) -> DataFrame:
    """What files (node, text) import: node, kind (go, py, pyrel, js), spec, and up (folders above) of relative ones."""
    each = lines(files.select("node", "text")).select("node", "line_number", "line")
    ext = F.regexp_extract("node", r"\.([a-z]+)$", 1)
    # fixed values: what imports look like in each language
    # Go: single lines, and lines of a block; a block runs from `import (` to `)`
    trimmed = strip(F.col("line"))
    mark = F.when(F.startswith(trimmed, F.lit("import (")), F.lit("open")).when(trimmed == ")", F.lit("close"))
    so_far = W.partitionBy("node").orderBy("line_number").rowsBetween(W.unboundedPreceding, -1)
    go = each.where(ext == "go").withColumn("mark", mark).withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(so_far) == "open", F.lit(False)))
    name = r'(?:[a-zA-Z_][0-9A-Za-z_]*\s+|\.\s+|_\s+)?"([^"]+)"'
    spec = F.when(F.col("inside"), F.regexp_extract("line", r"^\s*" + name, 1)).otherwise(F.regexp_extract("line", r"^\s*import\s+" + name, 1))
    go = go.where("mark is null or mark <> 'open'").select("node", F.lit("go").alias("kind"), spec.alias("spec"), F.lit(0).alias("up"))
    # Python: modules, and names that may be modules; relative ones by the number of dots
    py = each.where(ext == "py")
    relative = r"^\s*from\s+(\.+)([0-9A-Za-z_.]*)\s+import\s+(.+)$"
    absolute, plain = r"^\s*from\s+([0-9A-Za-z_.]+)\s+import\s+(.+)$", r"^\s*import\s+([0-9A-Za-z_.]+)"
    base = F.regexp_extract("line", relative, 2)
    named = imported_names(F.regexp_extract("line", relative, 3))
    own = F.when(base == "", named).otherwise(F.concat(F.array(base), F.transform(named, lambda x: F.concat(base, F.lit("."), x))))
    rel = py.where(F.col("line").rlike(relative)).select("node", F.lit("pyrel").alias("kind"), F.explode(own).alias("spec"), (F.length(F.regexp_extract("line", relative, 1)) - 1).alias("up"))
    module = F.regexp_extract("line", absolute, 1)
    both = F.concat(F.array(module), F.transform(imported_names(F.regexp_extract("line", absolute, 2)), lambda x: F.concat(module, F.lit("."), x)))
    wanted = F.when(F.col("line").rlike(absolute), both).otherwise(F.array(F.regexp_extract("line", plain, 1)))
    py = py.where(~F.col("line").rlike(relative)).select("node", F.lit("py").alias("kind"), F.explode(wanted).alias("spec"), F.lit(0).alias("up"))
    # JavaScript and TypeScript: relative ones only
    quoted = r"""['"]([^'"]+)['"]"""
    found = F.concat(F.regexp_extract_all("line", F.lit(r"""(?:^|\s)import\s+(?:[^'"]*\sfrom\s+)?""" + quoted), F.lit(1)), F.regexp_extract_all("line", F.lit(r"require\s*\(\s*" + quoted + r"\s*\)"), F.lit(1)))
    js = each.where(ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx")).select("node", F.explode(found).alias("s")).where(F.startswith(F.col("s"), F.lit(".")))
    ups = F.regexp_extract("s", r"^((?:\.\./)*)", 1)
    js = js.select("node", F.lit("js").alias("kind"), F.regexp_replace(F.regexp_replace("s", r"^(?:\.\./)+", ""), r"^\./", "").alias("spec"), F.floor(F.length(ups) / 3).cast("int").alias("up"))
    return go.unionByName(rel).unionByName(py).unionByName(js).where("spec <> ''").distinct()


def climb(folder: Column, up: Column) -> Column:
    """The folder so many levels above; `.` at the top."""
    kept = F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - up, F.lit(0)))
    return F.when(F.size(kept) > 0, F.array_join(kept, "/")).otherwise(F.lit("."))


def resolve(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (importer, importee) of imports among nodes (node): every import becomes keys, and keys are joined."""
    # Go: the last segment is a folder of the importee, at any depth
    go = found.where((F.col("kind") == "go") & F.col("spec").rlike("[./]")).select(F.col("node").alias("importer"), F.lower(F.element_at(F.split("spec", "/"), -1)).alias("key"))
    folders = nodes.where("node like '%.go'").select(F.col("node").alias("importee"), F.explode(F.array_distinct(F.slice(F.split("node", "/"), F.lit(1), F.size(F.split("node", "/")) - 1))).alias("key"))
    edges = go.join(folders, "key").select("importer", "importee")
    # Python: any node that ends with the module's path, wherever the ending begins. Both sides meet by the file's name (and
    # its folder's, for a package), and the ending is compared there; a module's name without a folder may end a longer name
    path = F.lower(F.replace(F.col("spec"), F.lit("."), F.lit("/")))
    py = found.where("kind = 'py'").select(F.col("node").alias("importer"), F.explode(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))).alias("ending")).distinct()
    last = lambda c: F.regexp_extract(c, r"([^/]+(?:/__init__\.py)?)$", 1)
    modules = nodes.where("node like '%.py'").select(F.col("node").alias("importee"), F.explode(F.array(last(F.col("node")), F.regexp_extract("node", "[^/]*$", 0))).alias("key")).distinct()
    deep = py.where(F.contains("ending", F.lit("/"))).withColumn("key", last(F.col("ending")))
    near_ends = deep.join(modules, "key").where(F.endswith("importee", F.col("ending"))).select("importer", "importee")
    # an ending of one name: all endings of each file's name are keys, as many as the name has letters
    letters = F.sequence(F.lit(1), F.length("key"))
    tails = modules.where(~F.contains("key", F.lit("/"))).select("importee", F.explode(F.transform(letters, lambda i: F.substring(F.col("key"), i, F.length("key")))).alias("ending"))
    short = py.where(~F.contains("ending", F.lit("/"))).join(tails, "ending").select("importer", "importee")
    edges = edges.unionByName(near_ends).unionByName(short)
    # relative ones: exact paths
    folder = climb(directory(F.col("node")), F.col("up"))
    joined = F.regexp_replace(F.concat(folder, F.lit("/"), F.when(F.col("kind") == "js", F.lower("spec")).otherwise(path)), r"^\./", "")
    near = found.where("kind in ('pyrel', 'js')").select(F.col("node").alias("importer"), "kind", "spec", "up", joined.alias("base"))
    endings = F.when(F.col("kind") == "js", F.array(*map(F.lit, JS_ENDINGS))).otherwise(F.array(F.lit(".py"), F.lit("/__init__.py")))
    tried = near.select("*", F.posexplode(endings).alias("nth", "ending")).withColumn("importee", F.concat("base", "ending"))
    hits = tried.join(nodes.select(F.col("node").alias("importee")).distinct(), "importee")
    js = hits.where("kind = 'js'").groupBy("importer", "spec", "up").agg(F.min_by("importee", "nth").alias("importee")).select("importer", "importee")
    return clean(edges.unionByName(js).unionByName(hits.where("kind = 'pyrel'").select("importer", "importee")))


def clean(edges: DataFrame) -> DataFrame:
    """Edges once each, none from a file to itself."""
    return edges.where("importer <> importee").distinct()


def direct_importers(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("importee").alias("node")).agg(F.count("*").alias("direct"))


#: Folders that this program has written beside its results.
_stored: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir, of the session or its context). On one
    machine a temporary folder will do; on a cluster without a shared folder this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    _stored.append(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _stored[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_for_now(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df written to a scratch folder and read back; the folder, and shuffles that nothing needs any more, go at the end. What
    comes of it must have been stored by then."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    drop_shuffles(spark)
    yield spark.read.schema(df.schema).parquet(path)
    delete(spark, path)
    _stored.remove(path)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: files of a shuffle go with the last object that knows it, and else stay until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(spark: SparkSession) -> int:
    """Delete what operators have stored on the way; the number of folders. Call it when no result is needed any more that
    hasn't been stored elsewhere: results are lazy and read those folders."""
    for folder in _stored:
        delete(spark, folder)
    n = len(_stored)
    _stored.clear()
    return n


def transitive_importers(edges: DataFrame, seeds: DataFrame | None = None, hops: int | None = None) -> DataFrame:
    """(node, importer, hop): all that depend on a node, through at least one import, and by how many at least; up to `hops`
    imports, if given.

    Of all nodes: by doubling. Once all pairs up to n imports apart are known, a pair up to 2n apart has a node on its way
    that is exactly n from its end, so pairs of exactly n are extended by all pairs; a path of 60 files takes 6 rounds. Of the
    nodes of seeds (node): by following their own importers one import a round, since doubling would make the pairs of all
    nodes that are passed, which may be far more than the result. Rounds are stored, so lineage stays short and lost
    executors cost one round.
    """
    edges = stored(clean(edges), "edges")
    pairs = edges.select(F.col("importee").alias("node"), "importer")
    return _doubled(pairs, hops) if seeds is None else _followed(pairs, seeds.select("node").distinct(), hops)


def _grown(found: DataFrame, reached: DataFrame, hop: int) -> tuple[DataFrame, int, int]:
    """The pairs of found (node, importer, hop) that reached doesn't have, each by its least hop, stored; how many there are,
    and how many of them at exactly this hop."""
    least = found.where("node <> importer").groupBy("node", "importer").agg(F.min("hop").alias("hop"))
    seen = Observation()
    fresh = least.join(reached, ["node", "importer"], "left_anti").observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("hop") == hop).alias("far"))
    fresh = stored(fresh, "reached")
    return fresh, seen.get["n"], seen.get["far"]


def _doubled(pairs: DataFrame, hops: int | None) -> DataFrame:
    reached = far = pairs.withColumn("hop", F.lit(1))
    length = n_far = 1
    while n_far and (hops is None or length < hops):
        ways = far.select("node", F.col("importer").alias("through")).join(reached.select(F.col("node").alias("through"), "importer", "hop"), "through")
        fresh, n, n_far = _grown(ways.select("node", "importer", (F.col("hop") + length).alias("hop")), reached, 2 * length)
        length *= 2
        reached, far = reached.unionByName(fresh) if n else reached, fresh.where(F.col("hop") == length)
    return reached if hops is None else reached.where(F.col("hop") <= hops)


def _followed(pairs: DataFrame, seeds: DataFrame, hops: int | None) -> DataFrame:
    reached = frontier = stored(pairs.join(seeds, "node", "left_semi").withColumn("hop", F.lit(1)), "reached")
    hop = n = 1
    while n and (hops is None or hop < hops):
        hop += 1
        step = pairs.select(F.col("node").alias("importer"), F.col("importer").alias("next"))
        ways = frontier.select("node", "importer").join(step, "importer").select("node", F.col("next").alias("importer"), F.lit(hop).alias("hop"))
        frontier, n, _ = _grown(ways, reached, hop)
        reached = reached.unionByName(frontier) if n else reached
    return reached


def same_directory(nodes: DataFrame) -> DataFrame:
    """node and siblings: the other files of its folder, counted once a folder."""
    own = nodes.select("node").distinct().withColumn("folder", directory(F.col("node")))
    sizes = own.groupBy("folder").agg((F.count("*") - 1).alias("siblings"))
    return own.join(sizes, "folder").select("node", "siblings")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """node, direct, transitive (all that are reached, the direct ones too), siblings, blast_radius, band and the first
    affected files, of the seeds or all nodes."""
    wanted = (seeds if seeds is not None else nodes).select("node").distinct()
    reached = transitive_importers(edges, None if seeds is None else wanted)
    counts = reached.groupBy("node").agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count("*").alias("transitive"))
    # a node's importers are distinct; all but the first are cut before they meet, by a window that keeps a few of each task
    nth = F.row_number().over(W.partitionBy("node").orderBy("importer"))
    first = reached.select("node", "importer").withColumn("nth", nth).where(F.col("nth") <= AFFECTED_LISTED)
    listed = first.groupBy("node").agg(F.array_sort(F.collect_list("importer")).alias("affected_files"))
    out = wanted.join(counts, "node", "left").join(listed, "node", "left").join(same_directory(nodes), "node", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("direct", "transitive", "siblings")}
    out = out.withColumns(zero).withColumn("affected_files", F.coalesce("affected_files", F.array().cast("array<string>")))
    radius = blast_radius(F.col("transitive"), F.col("direct"), F.col("siblings"))
    return out.withColumn("blast_radius", radius).withColumn("band", impact_band(F.col("blast_radius")))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files (path, text)."""
    own = graph_files(files)
    nodes = own.select("node").distinct()
    return nodes, resolve(nodes, imports(own))


def ranked(reach: DataFrame, first: int | None = None) -> DataFrame:
    """Rows of `impact` by falling blast radius, then node; the first so many, if given."""
    out = reach.orderBy(F.col("blast_radius").desc(), "node")
    return out if first is None else out.limit(first)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n_nodes")), clean(edges).agg(F.count("*").alias("n_edges"))
    return n.crossJoin(e)  # one row each
