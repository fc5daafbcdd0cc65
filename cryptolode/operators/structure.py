"""Structural detection: queries such as `call:hashlib.md5` against a file's tokens.

Tokens are a relation (`tokens`). Those that mean something are numbered in their file and get their neighbours by windows
that run over each file's rows where they are; brackets of type arguments are matched by running depths. A query is met at
the last part of its name: queries join tokens on language and that part, and the rest of the name and what stands around it
are looked at in the neighbours. Only files that hold the last part of some query's name are cut into tokens at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.files import context, line_array
from .tokens import LEXERS, blank, tokens

STRUCTURAL = "path string, language string, rule_ordinal int, rule_id string, line_number int, column int, match_ordinal int, snippet string, snippet_context array<string>"
LANGUAGES = tuple(LEXERS)
#: Kinds of queries whose value may stand in a string literal.
IN_STRINGS = ("import", "require", "include")
#: What joins the parts of a name.
JOINTS = (".", "::", "->", "\\", "?.")
#: Languages whose calls may have type arguments, and the brackets around those.
ANGLES = ("typescript", "java", "kotlin", "swift", "cpp", "rust", "csharp")
SQUARES = ("go", "scala")
#: Words that stand before a name without being a part of it.
WORDS = "new return throw case else in instanceof typeof await yield import from use using require def fn func function fun as of not and or if while static include".split()
DEFINES = ("def", "fn", "func", "function", "fun")
QUERIES = "language string, key string, kind string, rule_ordinal int, rule_id string, parts array<string>, open boolean, literal boolean"


def queries_of(rules: DataFrame) -> list[tuple]:
    """The pack's structural queries, each by the last part of its name; one that may be a string literal also by its whole
    value. open: anything may follow the name (`.*`)."""
    out = []
    for r in rules.where("detector_type = 'ast'").orderBy("rule_ordinal").collect():
        kind, value = r.query.split(":", 1)
        parts = [p for p in re.split(r"\.|::|->|\\", value.removesuffix(".*")) if p]
        if kind not in ("require", "include") and parts:
            out.append((r.language, parts[-1], kind, r.rule_ordinal, r.rule_id, parts, value.endswith(".*"), False))
        if kind in IN_STRINGS:
            out.append((r.language, value, kind, r.rule_ordinal, r.rule_id, [value], False, True))
    return out


def neighbours(found: DataFrame, longest: int) -> DataFrame:
    """found: tokens that mean something. Adds idx (in their file), before (the tokens before, nearest first, with their
    places), after (the two after), first (of the line), chain (what stands before the dotted name that a token is in, and
    where that begins) and closed (for an opening bracket: what follows its closing one)."""
    order = W.partitionBy("path").orderBy("nth")
    up = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.struct("token", "line", "column")
    near = found.withColumns({
        "idx": F.row_number().over(order),
        "before": F.array(*[F.lag(place, k).over(order) for k in range(1, 2 * longest + 2)]),
        "after": F.array(*[F.lead("token", k).over(order) for k in (1, 2)]),
        "first": F.first(place).over(W.partitionBy("path", "line").orderBy("nth")),
    })
    one, two = (F.col("before")[k]["token"] for k in (0, 1))
    named = lambda c: c.rlike(r"^[\p{L}_$]") & ~c.isin(*WORDS)
    joined = (F.col("token").isin(*JOINTS) & named(one)) | (named(F.col("token")) & one.isin(*JOINTS) & (named(two) | (one == "\\")))
    previous = F.col("before")[0]
    begins = F.when(~F.coalesce(joined, F.lit(False)), F.struct(one.alias("before"), "line", "column", previous["line"].alias("new_line"), previous["column"].alias("new_column")))
    near = near.withColumn("chain", F.last(begins, ignorenulls=True).over(up))
    # depth of type brackets before an opening and after a closing one, by running sums; statements end all hope of a match
    angle, square = F.col("language").isin(*ANGLES), F.col("language").isin(*SQUARES)
    opens = (angle & (F.col("token") == "<")) | (square & (F.col("token") == "["))
    shuts = (angle & (F.col("token") == ">")) | (square & (F.col("token") == "]"))
    step = F.when(opens, 1).when(shuts, -1).otherwise(0)
    ends = F.col("token").isin(";", "{", "}", "&&", "||").cast("int")
    near = near.withColumn("level", F.sum(step).over(up) - F.when(opens, 1).otherwise(0)).withColumn("ends", F.sum(ends).over(up))
    down = W.partitionBy("path", "level").orderBy("nth").rowsBetween(1, W.unboundedFollowing)
    shut = F.first(F.when(shuts, F.struct(F.col("after")[0].alias("next"), "ends")), ignorenulls=True).over(down)
    near = near.withColumn("closed", F.when(opens, F.when(shut["ends"] == F.col("ends"), shut["next"])))
    return near.withColumn("closed", F.lead("closed").over(order)).withColumn("closed_later", F.lead("closed").over(order))


def met(own: DataFrame) -> tuple[Column, Column]:
    """Whether a query (kind, parts, open, literal) is met at a token with its neighbours, and the place that it is found at."""
    n = F.size("parts")
    back = lambda k: F.element_at("before", k)  # noqa: E731  k from 1, the nearest
    # the parts before the last, each behind a joint
    named = F.forall(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda j: (n == 1) | (F.element_at("before", 2 * j - 1)["token"].isin(*JOINTS) & (F.element_at("before", 2 * j)["token"] == F.element_at("parts", n - j))),
    )
    ahead = F.element_at("before", 2 * n - 1)["token"]  # of the whole name
    head = F.when(n == 1, F.struct("line", "column")).otherwise(F.struct(back(F.greatest(2 * n - 2, F.lit(1)))["line"].alias("line"), back(F.greatest(2 * n - 2, F.lit(1)))["column"].alias("column")))
    text = lambda k: F.coalesce(F.col("before")[k]["token"], F.lit(""))
    after, later = (F.coalesce(F.col("after")[k], F.lit("")) for k in (0, 1))
    ahead = F.coalesce(ahead, F.lit(""))
    loose = ~ahead.isin(".", "::", "->", "?.")
    called = (after == "(") | (after == "!") & (later == "(") | (F.col("closed") == "(") | (after == "::") & (F.col("closed_later") == "(")
    called = F.coalesce(called, F.lit(False))
    first, chain = F.col("first"), F.col("chain")
    python, go, script = F.col("language") == "python", F.col("language") == "go", F.col("language").isin("javascript", "typescript")
    whole = F.when(F.col("open"), F.lit(True)).otherwise(~after.isin(*JOINTS))
    as_call = loose & called & ~ahead.isin(*DEFINES)
    kind = F.col("kind")
    line_place = F.struct(first["line"].alias("line"), first["column"].alias("column"))
    own_place = F.struct("line", "column")
    at = lambda k: F.struct(F.col("before")[k]["line"].alias("line"), F.col("before")[k]["column"].alias("column"))
    required = lambda k: text(k).isin("require", "require_relative")
    alone = (F.col("idx") == F.col("line_last")) & ((F.col("idx") == F.col("line_first")) | (F.col("idx") == F.col("line_first") + 1) & first["token"].rlike(r"^[\p{L}_.]"))
    in_python = F.when(chain["before"] == "from", first["token"] == "from").otherwise((first["token"] == "import") & chain["before"].isin("import", ","))
    names = (
        F.when(kind.isin("call", "apply", "init", "method"), as_call)
        .when(kind == "methodcall", text(0).isin(".", "->", "::", "?.") & (after == "("))
        .when(kind == "new", F.when((after == ".") & (later == "new"), ahead != ".").otherwise((chain["before"] == "new") & (after.isin("(", ";", "{", "[") | (F.col("closed") == "("))))
        .when((kind == "import") & python, in_python & (F.coalesce(chain["line"], F.lit(0)) == head["line"]) & (chain["column"] == head["column"]))
        .when(kind == "import", ahead.isin("import", "static") & (first["token"].isin("import", "@")) & whole)
        .when(kind == "using", first["token"] == "using")
        .when(kind == "use", (first["token"] == "use") & (chain["before"] == "use") & F.when(F.col("open"), F.lit(True)).otherwise(after != "."))
        .when(kind == "ident", F.lit(True))
        .when(kind == "const", after != "(")
        .otherwise(loose & ~ahead.isin(":", ">") & (after != "("))
    )
    literals = (
        F.when(kind == "require", required(0) | (text(0) == "(") & required(1))
        .when(kind == "include", (text(0) == "include") & (text(1) == "#"))
        .otherwise((first["token"] == "import") | (text(0) == "(") & (text(1) == "require") | script & (text(0) == "from") | go & alone)
    )
    hit = F.when(F.col("literal"), literals).otherwise((kind == "methodcall") | named) & F.when(F.col("literal"), F.lit(True)).otherwise(names)
    behind = (text(0) == "(") & (text(1) == "require") | (kind == "require") & (text(0) == "(")
    place = (
        F.when(F.col("literal") & (kind == "include"), at(1)).when(F.col("literal") & behind, at(1)).when(F.col("literal") & (kind == "require"), at(0)).when(F.col("literal"), line_place)
        .when(kind == "methodcall", at(0)).when(kind.isin("import", "using", "use"), line_place)
        .when((kind == "new") & ~((after == ".") & (later == "new")), F.struct(chain["new_line"].alias("line"), chain["new_column"].alias("column")))
        .otherwise(head)
    )
    return hit, F.coalesce(place, own_place)


def detect_structure(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path, language, text; a path is one file) against a pack's structural rules; matches as the pattern detector
    gives them."""
    spark, asked = files.sparkSession, [q for q in queries_of(rules) if q[0] in LEXERS]
    wanted = F.lit(False)
    for lang in sorted({q[0] for q in asked}):
        keys = sorted({q[1] for q in asked if q[0] == lang})
        wanted |= (F.col("language") == lang) & F.col("text").rlike("|".join(re.sub(r"([^\w])", r"\\\1", k) for k in keys))
    own = files.select("path", "language", "text").where(wanted)
    found = tokens(own, {q[0] for q in asked}).where(~blank(F.col("language")) & (F.col("token") != ""))
    # PHP's dot puts strings together, and no names
    found = found.withColumn("token", F.when((F.col("language") == "php") & (F.col("token") == "."), F.lit(" . ")).otherwise(F.col("token")))
    near = neighbours(found, max((len(q[5]) for q in asked), default=1))
    by_line = W.partitionBy("path", "line")
    near = near.withColumns({"line_first": F.min("idx").over(by_line), "line_last": F.max("idx").over(by_line)})
    string = F.col("token").rlike(r"^(?:[\"'`]|<[^>]+>$)") & ~F.col("quoted")
    key = F.when(string, F.substring("token", F.lit(2), F.length("token") - 2)).otherwise(F.col("token"))
    table = F.broadcast(spark.createDataFrame(asked, QUERIES))  # a pack is a program's configuration
    pairs = near.where(~F.col("quoted")).withColumns({"key": key, "literal": string}).join(table, ["language", "key", "literal"])
    hit, place = met(pairs)
    hits = pairs.where(hit).select("path", "language", "rule_ordinal", "rule_id", place.alias("place"), "idx")
    once = hits.groupBy("path", "language", "rule_ordinal", "rule_id", F.col("place.line").alias("line_number"), F.col("place.column").alias("column")).agg(F.min("idx").alias("idx"))
    nth = F.row_number().over(W.partitionBy("path", "rule_ordinal", "line_number").orderBy("column")) - 1
    placed = once.withColumn("match_ordinal", nth.cast("int")).drop("idx")
    texts = own.select("path", line_array(F.col("text")).alias("lines"))
    out = placed.join(texts, "path").select("path", "language", "rule_ordinal", "rule_id", "line_number", "column", "match_ordinal", F.get("lines", F.col("line_number") - 1).alias("snippet"), context(F.col("lines"), F.col("line_number")).alias("snippet_context"))
    return out
