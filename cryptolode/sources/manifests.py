"""Dependency manifests, as rows of (ecosystem, package, version, manifest, line).

Line formats are parsed with column expressions; what section or block a line is in comes from a window over its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.scalars import strip
from .files import lines

DEPENDENCY_COLUMNS = ["ecosystem", "package", "version", "manifest", "line"]


def so_far() -> WindowSpec:
    """A line and those above it in its file."""
    return W.partitionBy("path").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)


def is_manifest(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    return name.isin("requirements.txt", "pipfile", "pyproject.toml", "package.json", "go.mod") | name.rlike(r"^requirements-.*\.txt$")


def requirement(spec: Column) -> tuple[Column, Column]:
    """Name and version (with its operator) of a requirement, without markers, addresses and extras."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(spec, r";.*$", ""), r" @ .*$", ""), r"\[[^\]]*\]", ""))
    return strip(F.regexp_extract(bare, r"^([^=<>!~ ]*)", 1)), strip(F.regexp_extract(bare, r"^[^=<>!~ ]*(.*)$", 1))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"""^(?:"(.*)"|'(.*)')$""", "$1$2")


def rows(found: DataFrame, ecosystem: str, package: Column, version: Column, line: Column | None = None) -> DataFrame:
    own = found.select(F.lit(ecosystem).alias("ecosystem"), package.alias("package"), version.alias("version"), F.col("path").alias("manifest"), (line if line is not None else F.col("line_number")).cast("int").alias("line"))
    return own.where("package <> ''")


def requirements(files: DataFrame) -> DataFrame:
    own = lines(files).withColumn("t", strip(F.col("line"))).where(~F.col("t").rlike("^(#|-|$)")).withColumn("t", F.regexp_replace("t", r"(?<=.) #.*$", ""))
    return rows(own, "python", *requirement(F.col("t")))


def toml_section(files: DataFrame, headers: list[str]) -> DataFrame:
    """`name = version` lines of the sections with these headers."""
    own = lines(files).withColumn("t", strip(F.col("line"))).where(~F.col("t").rlike("^(#|$)"))
    own = own.withColumn("section", F.last(F.when(F.startswith(F.col("t"), F.lit("[")), F.col("t")), ignorenulls=True).over(so_far()))
    own = own.where(F.col("section").isin(*headers) & ~F.startswith(F.col("t"), F.lit("[")) & F.contains(F.col("t"), F.lit("=")))
    name = F.regexp_replace(strip(F.regexp_extract("t", r"^([^=]*)=", 1)), r"""^["']+|["']+$""", "")
    return rows(own.withColumn("name", name).where("name <> 'python'"), "python", F.col("name"), unquoted(F.regexp_extract("t", r"^[^=]*=(.*)$", 1)))


def pipfile(files: DataFrame) -> DataFrame:
    return toml_section(files, ["[packages]", "[dev-packages]"])


def project_array(files: DataFrame) -> DataFrame:
    """Requirements of `dependencies = [...]` in `[project]`, on one line or many."""
    own = lines(files).withColumn("t", strip(F.col("line"))).where(~F.col("t").rlike("^(#|$)"))
    header = F.startswith(F.col("t"), F.lit("["))
    own = own.withColumn("section", F.last(F.when(header, F.col("t")), ignorenulls=True).over(so_far())).where((F.col("section") == "[project]") & ~header)
    begins = F.col("t").rlike("^dependencies.*=")
    closed = begins & F.col("t").rlike(r"\[.*\]")
    state = F.when(closed, F.lit("out")).when(begins, F.lit("in")).when(F.startswith(F.col("t"), F.lit("]")), F.lit("out"))
    own = own.withColumn("begins", begins).withColumn("state", F.last(state, ignorenulls=True).over(so_far()))
    inline = F.regexp_replace(F.regexp_extract("t", r"\[(.*)$", 1), r"\][^\]]*$", "")
    first = own.where("begins").withColumn("item", F.explode(F.split(inline, ",")))
    more = own.where("not begins and state = 'in'").withColumn("item", F.regexp_replace("t", ",$", ""))
    items = first.unionByName(more).withColumn("item", unquoted(strip(F.col("item")))).where("item <> ''")
    return rows(items, "python", *requirement(F.col("item")))


def pyproject(files: DataFrame) -> DataFrame:
    return project_array(files).unionByName(toml_section(files, ["[tool.poetry.dependencies]", "[tool.poetry.dev-dependencies]"]))


def package_json(files: DataFrame) -> DataFrame:
    """The four maps of a package file; a package's line is the first that has its quoted name, 0 if none has."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = F.from_json("text", ", ".join(f"{k} map<string,string>" for k in kinds))
    pairs = F.flatten(F.array(*[F.coalesce(F.map_entries(F.col(f"j.{k}")), F.array().cast("array<struct<key:string,value:string>>")) for k in kinds]))
    own = files.withColumn("j", parsed).where("j is not null").withColumn("lines", F.split("text", "\n")).select("path", "lines", F.explode(pairs).alias("e"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.concat(F.lit('"'), F.col("e.key"), F.lit('"')))), True)
    return rows(own, "javascript", F.col("e.key"), F.col("e.value"), at)


def go_mod(files: DataFrame) -> DataFrame:
    own = lines(files).withColumn("t", strip(F.col("line"))).where(~F.col("t").rlike("^(//|$)"))
    opens = F.startswith(F.col("t"), F.lit("require ("))
    own = own.withColumn("state", F.last(F.when(opens, F.lit("in")).when(F.col("t") == ")", F.lit("out")), ignorenulls=True).over(so_far())).where(~opens & (F.col("t") != ")"))
    own = own.withColumn("body", F.when(F.col("state") == "in", F.col("t")).when(F.startswith(F.col("t"), F.lit("require ")), F.regexp_replace("t", "^require ", "")))
    parts = F.split(strip(F.regexp_replace("body", "//.*$", "")), r"\s+")
    own = own.where("body is not null").withColumn("parts", parts).where(F.size("parts") >= 2)
    return rows(own, "go", F.element_at("parts", 1), F.element_at("parts", 2))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of the manifests among files (path, text); those in vendored folders belong to others."""
    own = files.where(is_manifest(F.col("path")) & ~F.col("path").rlike(r"(?i)(^|/)(node_modules|vendor|\.venv|__pycache__)/")).withColumn("name", F.lower(F.regexp_extract("path", "[^/]*$", 0)))
    kinds = [("requirements.*", requirements), ("pipfile", pipfile), (r"pyproject\.toml", pyproject), (r"package\.json", package_json), (r"go\.mod", go_mod)]
    out = None
    for pattern, parse in kinds:
        part = parse(own.where(F.col("name").rlike(f"^{pattern}$")).select("path", "text"))
        out = part if out is None else out.unionByName(part)
    return out
