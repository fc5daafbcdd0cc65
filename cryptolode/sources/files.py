"""Source trees as DataFrames: files, their languages, and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mapped

#: Larger files are passed over.
MOST_BYTES = 5 * 1024 * 1024
SNIFFED_BYTES = 8192

# fixed values: extensions of each language
EXTENSIONS = {
    "csharp": "cs",
    "python": "py",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts tsx",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "swift": "swift",
    "ruby": "rb",
    "cpp": "cpp cc cxx hpp hxx cu cuh",
    "c": "c h",
    "rust": "rs",
    "php": "php phtml",
    "scala": "scala sc",
    "julia": "jl",
    "qsharp": "qs",
    "solidity": "sol",
    "jupyter": "ipynb",
    "ada": "adb ads ada",
    "objc": "m mm",
    "shell": "sh bash zsh ksh",
    "elixir": "ex exs",
    "erlang": "erl hrl",
    "dart": "dart",
    "fsharp": "fs fsi fsx",
    "clojure": "clj cljs cljc edn",
    "perl": "pl pm t",
    "verilog": "v vh sv svh",
    "vhdl": "vhd vhdl",
    "move": "move",
    "vyper": "vy",
    "iec61131": "st iecst",
    "x509": "pem crt cer der key",
    "bicep": "bicep bicepparam",
    "yaml": "tpl yaml yml",
    "json": "json",
    "xml": "xml",
    "ini": "ini cfg conf",
    "toml": "toml",
    "env": "env",
    "terraform": "tf tfvars",
}
# fixed values: whole names, and endings, that decide before the extension does
NAMES = {
    "dockerfile": "dockerfile",
    "containerfile": "dockerfile",
    ".env": "env",
    ".env.local": "env",
    ".env.production": "env",
    "nginx.conf": "nginx",
    "httpd.conf": "apache",
    "apache2.conf": "apache",
    ".htaccess": "apache",
    "openssl.cnf": "openssl-cnf",
    "openssl-fips.cnf": "openssl-cnf",
    "sshd_config": "ssh-config",
    "ssh_config": "ssh-config",
}
ENDINGS = [(r"^dockerfile\.|\.dockerfile$", "dockerfile"), (r"\.nginx(\.conf)?$", "nginx"), (r"\.apache\.conf$|\.htaccess$", "apache"), (r"\.openssl\.cnf$", "openssl-cnf")]
CONFIG_LANGUAGES = "jupyter yaml json xml ini toml env dockerfile terraform bicep nginx apache openssl-cnf ssh-config x509 any".split()


def language(path: Column) -> Column:
    """A file's language by name, then ending, then extension; empty if unknown."""
    name = F.lower(F.regexp_extract(path, r"[^/]*$", 0))
    out = F.when(name.isin(*NAMES), mapped(name, NAMES))
    for pattern, lang in ENDINGS:
        out = out.when(name.rlike(pattern), F.lit(lang))
    by_extension = {x: lang for lang, xs in EXTENSIONS.items() for x in xs.split()}
    return out.otherwise(F.coalesce(mapped(F.regexp_extract(name, r"\.([^.]*)$", 1), by_extension), F.lit("")))


def is_source(lang: Column) -> Column:
    return (lang != "") & ~lang.isin(*CONFIG_LANGUAGES)


def read_tree(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """path (below root), size, content of regular files up to MOST_BYTES. With `only`, those paths alone are opened.
    The reader passes over empty files, in which nothing can be found."""
    reader = spark.read.format("binaryFile")
    found = reader.load([f"{root}/{p}" for p in only]) if only is not None else reader.option("recursiveFileLookup", "true").load(root)
    base = F.regexp_extract(F.lit(root), r"^(?:[a-z]+:/*)?(.*?)/*$", 1)
    at = F.instr(F.col("path"), base)
    path = F.regexp_replace(F.substring(F.col("path"), at + F.length(base), F.length("path")), "^/+", "")
    return found.where(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("size"), "content")


def text_files(files: DataFrame) -> DataFrame:
    """path, size, language and text of files of known languages. Text is empty where the first bytes hold a NUL."""
    binary = F.instr(F.substring("content", 1, SNIFFED_BYTES).cast("string"), "\0") > 0
    text = F.when(binary, F.lit("")).otherwise(F.decode("content", "UTF-8"))
    return files.select("path", "size", language(F.col("path")).alias("language"), text.alias("text")).where("language <> ''")


def line_array(text: Column) -> Column:
    """Lines without their ends; an end of line at the end begins no line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def lines(files: DataFrame) -> DataFrame:
    """files' columns but text, with line_number (from 1), line and the file's `lines`, for context."""
    rest = [c for c in files.columns if c != "text"]
    split = files.select(*rest, line_array(F.col("text")).alias("lines"))
    return split.select(*rest, "lines", F.posexplode("lines").alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def context(lines: Column, line_number: Column, around: int = 3) -> Column:
    """The lines from `around` before to `around` after."""
    first = F.greatest(line_number - around, F.lit(1))
    return F.slice(lines, first, line_number + around - first + 1)


def dealt(files: DataFrame) -> DataFrame:
    """Files per language, and in all."""
    return files.groupBy("language").agg(F.count("*").alias("files"))
