"""Detection: lines against rules, in a batch of whole files or inside the JVM, and what becomes of the matches."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import Pack, least_width, required
from ..functions.regex_dialect import glob_to_regex, required_literal, to_java, to_python
from ..sources.files import context, lines

MATCH_SCHEMA = "path string, language string, rule_ordinal int, rule_id string, line_number int, column int, match_ordinal int, snippet string, snippet_context array<string>"
PLACE_SCHEMA = MATCH_SCHEMA[: MATCH_SCHEMA.index(", snippet ")]
#: Matches leave `detect_pack` in portions of so many characters or rows.
PORTION_CHARACTERS, PORTION_ROWS = 4_000_000, 20_000


def only_where(line: Column, pattern: str, value: Column, otherwise: Column) -> Column:
    """value where the line may match: where it holds the text that all matches hold, which is looked for first."""
    literal = required_literal(pattern)
    return F.when(F.contains(line, F.lit(literal)), value).otherwise(otherwise) if literal else value


def matches_line(line: Column, pattern: str) -> Column:
    return only_where(line, pattern, line.rlike(to_java(pattern)), F.lit(False))


def match_count(line: Column, pattern: str) -> Column:
    return only_where(line, pattern, F.regexp_count(line, F.lit(to_java(pattern))), F.lit(0))


def match_columns(line: Column, pattern: str) -> Column:
    """The byte columns (from 1) of all non-overlapping matches of a literal RE2 pattern, none of which may be empty
    (`detect_pack` takes those patterns too, and counts empty matches)."""
    if least_width(pattern) == 0:
        raise ValueError(f"can match an empty text: {pattern}")
    java = to_java(pattern)
    # the line is what lies between the matches and the matches in turn, so no character is set apart as a mark
    hits, between = F.regexp_extract_all(line, F.lit(java), F.lit(0)), F.split(line, java)

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.octet_length(piece["between"])
        return F.struct((at + F.octet_length(piece["hit"])).alias("at"), F.array_append(state["starts"], at).alias("starts"))

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(1).alias("at"), none.alias("starts"))

    def count(x: Column) -> Column:
        pieces = F.zip_with(x["between"], x["hits"], lambda a, h: F.struct(a.alias("between"), h.alias("hit")))
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(x["hits"])), start, step, lambda s: s["starts"])

    # bound to a variable, so that the pieces are made once a line
    starts = F.transform(F.array(F.struct(between.alias("between"), hits.alias("hits"))), count)
    return F.when(matches_line(line, pattern), F.element_at(starts, 1)).otherwise(none)


def detect_literal(files: DataFrame, rules: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """files (path, language, text) against a few rules (id, pattern), all in one pass without a shuffle.

    Lines without any match are dropped before positions are counted. Columns of files named in keep are carried along.
    """
    by_line = lines(files.select("path", "language", "text", *keep))
    hits = by_line.where(functools.reduce(Column.__or__, [matches_line(F.col("line"), pattern) for _, pattern in rules]))

    def rows(n: int, name: str, pattern: str) -> Column:
        def row(column: Column, nth: Column) -> Column:
            return F.struct(F.lit(n).alias("rule_ordinal"), F.lit(name).alias("rule_id"), column.alias("column"), nth.alias("match_ordinal"))

        return F.transform(match_columns(F.col("line"), pattern), row)

    found = F.flatten(F.array(*[rows(n, name, pattern) for n, (name, pattern) in enumerate(rules)]))
    each = hits.select(*keep, "path", "language", "line_number", "line", "lines", F.explode(found).alias("m"))
    return each.select(*keep, "path", "language", "m.rule_ordinal", "m.rule_id", "line_number", "m.column", "m.match_ordinal", F.col("line").alias("snippet"), context(F.col("lines"), F.col("line_number")).alias("snippet_context"))


def count_literal(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """As `detect_literal`, but only how many matches a line has: path, language, rule_ordinal, rule_id, line_number,
    snippet, before (the line before it, if any) and n_matches. Each rule looks at each line once."""
    by_line = lines(files.select("path", "language", "text"))
    counts = F.array(*[match_count(F.col("line"), pattern) for _, pattern in rules])
    before = F.when(F.col("line_number") > 1, F.element_at("lines", F.greatest(F.col("line_number") - 1, F.lit(1)))).alias("before")
    each = by_line.select("path", "language", "line_number", F.col("line").alias("snippet"), before, F.posexplode(counts).alias("rule_ordinal", "n_matches")).where("n_matches > 0")
    return each.withColumn("rule_id", F.element_at(F.array(*[F.lit(name) for name, _ in rules]), F.col("rule_ordinal") + 1))


def portions(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of MATCH_SCHEMA or PLACE_SCHEMA as batches of some PORTION_CHARACTERS or PORTION_ROWS at most."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*[(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")], strict=True)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    held, characters = [], 0
    for row in rows:
        held.append(row)
        characters += len(row[7]) + sum(map(len, row[8])) if len(row) > 7 else 0
        if characters >= PORTION_CHARACTERS or len(held) >= PORTION_ROWS:
            yield batch(held)
            held, characters = [], 0
    if held:
        yield batch(held)


def detect_pack(files: DataFrame, rules: DataFrame, snippets: bool = True) -> DataFrame:
    """files (path, language, text) against a rule pack: each file once, against the regex rules of its language and of
    `any` whose globs accept it. The pack, a program's configuration, travels with the function; its patterns are compiled
    and its automaton is built once a worker and language. One pass of a file finds the rules worth trying and their lines.

    Files are taken one by one and matches leave in portions, so no more than one of each is held at a time. Without snippets,
    matches are places only (PLACE_SCHEMA): a long line isn't repeated for each of its matches."""
    pack = [(r.rule_ordinal, r.rule_id, r.language, r.pattern, r.flags, list(r.file_globs or [])) for r in rules.where("detector_type = 'regex'").orderBy("rule_ordinal").collect()]
    schema = MATCH_SCHEMA if snippets else PLACE_SCHEMA
    ready: dict[str, tuple[list, Pack]] = {}

    def found(path: str, language: str, text: str) -> Iterator[tuple]:
        if language not in ready:
            own = [r for r in pack if r[2] in (language, "any")]
            ready[language] = own, Pack([(p, f) for _, _, _, p, f, _ in own])
        text_lines = [x.removesuffix("\r") for x in text.split("\n")]
        if text_lines[-1] == "":
            text_lines.pop()
        own, packed = ready[language]
        for which, numbers in sorted(packed.worth_trying(text, text_lines).items()):
            ordinal, rule, _, _, _, globs = own[which]
            if globs and not any(accepts(g, path) for g in globs):
                continue
            pattern = packed.compiled[which]
            for n in numbers:
                line = text_lines[n] if n < len(text_lines) else ""
                at, column = 0, 1  # bytes are counted on from the match before
                for k, m in enumerate(pattern.finditer(line)):
                    column += m.start() - at if line.isascii() else len(line[at : m.start()].encode())
                    at = m.start()
                    place = (path, language, ordinal, rule, n + 1, column, k)
                    yield (*place, line, text_lines[max(0, n - 3) : n + 4]) if snippets else place

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ([x.as_py() for x in file] for batch in batches for file in zip(*batch.columns, strict=True))
        yield from portions((row for path, language, text in files for row in found(path, language, text or "")), schema)

    return files.select("path", "language", "text").mapInArrow(matches, schema)


def accepts(glob: str, path: str) -> bool:
    """Whether a glob accepts a file's name or its whole path; stars don't cross slashes."""
    return any(re.match(glob_to_regex(glob), x) for x in (path.rsplit("/", 1)[-1], path))


def glob_accepts(path: Column, globs: list[str]) -> Column:
    """As `accepts`, in the JVM, for literal globs; no globs accept everything."""
    name, out = F.regexp_extract(path, "[^/]*$", 0), None
    for g in globs:
        hit = name.rlike(glob_to_regex(g)) | path.rlike(glob_to_regex(g))
        out = hit if out is None else out | hit
    return F.lit(True) if out is None else out


def to_findings(matches: DataFrame, rules: DataFrame, scan_job_id: str = "") -> DataFrame:
    """Matches with the attributes of their rules."""
    kept = rules.select(
        "rule_ordinal", "category", "severity", "algorithm", "usage_type", "quantum_safety", "key_size", "message", "recommendation", "references", "cwe", "confidence"
    )
    return matches.join(kept, "rule_ordinal").withColumnRenamed("path", "file_path").withColumn("scan_job_id", F.lit(scan_job_id))


def supersede(pattern_findings: DataFrame, structural_findings: DataFrame) -> DataFrame:
    """Both, without the pattern findings of a file, rule and line that a structural finding has; structural ones first."""
    keys = ["file_path", "rule_id", "line_number"]
    rest = pattern_findings.join(structural_findings.select(*keys).distinct(), keys, "left_anti")
    return structural_findings.withColumn("layer_ordinal", F.lit(0)).unionByName(rest.withColumn("layer_ordinal", F.lit(1)), allowMissingColumns=True)


# fixed value: lines that mention a post-quantum library are never a gap
PQC_MENTION = r"(?i)\b(?:lib)?oqs\b|\bcircl\b|kyber|dilithium|pqcrypto|ml[_-]?kem|ml[_-]?dsa|sphincs"
# fixed values: how sources import well-known classical libraries, by language; the first group is the library's name
IMPORTS = [
    ("python", "python-crypto", r"^\s*(?:from|import)\s+(cryptography|Cryptodome|Crypto|M2Crypto|OpenSSL|nacl|paramiko|pycryptodome|rsa|ecdsa|jwt|jose)\b"),
    ("javascript", "crypto", r"require\(\s*['\"](?:node:)?(crypto)['\"]\s*\)|from\s+['\"](?:node:)?(crypto)['\"]"),
    ("javascript", "js-crypto-package", r"require\(\s*['\"](jsonwebtoken|node-forge|elliptic|jsrsasign|crypto-js|node-rsa)['\"]\s*\)|from\s+['\"](jsonwebtoken|node-forge|elliptic|jsrsasign|crypto-js|node-rsa)['\"]"),
    ("typescript", "crypto", r"require\(\s*['\"](?:node:)?(crypto)['\"]\s*\)|from\s+['\"](?:node:)?(crypto)['\"]"),
    ("typescript", "js-crypto-package", r"require\(\s*['\"](jsonwebtoken|node-forge|elliptic|jsrsasign|crypto-js|node-rsa)['\"]\s*\)|from\s+['\"](jsonwebtoken|node-forge|elliptic|jsrsasign|crypto-js|node-rsa)['\"]"),
    ("java", "java-crypto", r"^\s*import\s+(?:static\s+)?(java\.security|javax\.crypto|org\.bouncycastle)\b"),
    ("go", "crypto", r"\"((?:golang\.org/x/)?crypto)/"),
    ("csharp", "System.Security.Cryptography", r"^\s*using\s+(System\.Security\.Cryptography)\b"),
    ("csharp", "Org.BouncyCastle", r"\b(Org\.BouncyCastle)\b"),
    ("ruby", "openssl", r"require\s+['\"](openssl)['\"]"),
    ("php", "openssl", r"\b(openssl)_[a-z0-9_]+"),
    ("php", "phpseclib", r"\b(phpseclib)\b"),
    ("rust", "rust-crypto-crate", r"\buse\s+(ring|openssl|rsa|aes|sha2)::"),
]


def sentinel(files: DataFrame, findings: DataFrame, table: list[tuple[str, str, str]] | None = None, excluded: str = PQC_MENTION) -> DataFrame:
    """For files (path, language, text) without findings (file_path): the first line, then the first entry of the table
    (language, library, pattern), that imports a library. One row a file: path, line_number, column, library, snippet.

    A file is opened if it holds a text that some pattern of its language needs, and a line is looked at entry by entry if
    one joined pattern of its language matches it."""
    table = IMPORTS if table is None else table
    quiet = files.join(findings.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    language, text = F.col("language"), F.lower("text")
    opened, tried = F.lit(False), F.lit(False)
    for lang in dict.fromkeys(lang for lang, _, _ in table):
        own = [p for name, _, p in table if name == lang]
        needs = [required(p) for p in own]
        # a text that lower() keeps whole; others are left to the patterns
        texts = sorted(set().union(*needs)) if all(needs) and all(t.isascii() for n in needs for t in n) else None
        held = functools.reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in texts]) if texts else F.lit(True)
        opened |= (language == lang) & held
        tried |= (language == lang) & F.col("line").rlike("|".join(f"(?:{to_java(p)})" for p in own))
    by_line = lines(quiet.where(opened).select("path", "language", "text")).where(tried).where(~F.col("line").rlike(to_java(excluded)))
    entries = []
    for lang, library, pattern in table:
        java = to_java(pattern)
        groups = [F.regexp_extract("line", java, g) for g in range(1, re.compile(to_python(pattern).pattern).groups + 1)]
        name = F.coalesce(*[F.when(g != "", g) for g in groups], F.lit(library))
        at = F.octet_length(F.element_at(F.split("line", java, 2), 1)) + 1
        entries.append(F.when((language == lang) & F.col("line").rlike(java), F.struct(name.alias("library"), at.alias("column"))))
    hit = by_line.withColumn("hit", F.coalesce(*entries)).where("hit is not null")
    first = hit.groupBy("path", "language").agg(F.min_by(F.struct("line_number", "hit.column", "hit.library", F.col("line").alias("snippet")), "line_number").alias("h"))
    return first.select("path", "language", "h.*")
