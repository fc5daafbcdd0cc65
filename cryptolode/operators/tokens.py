"""Source text as a relation of tokens.

A language's lexer is one pattern of alternatives, applied by `regexp_extract_all`: comments, string literals, numbers,
names, operators, and any other character, so the tokens of a file put together are its text and a token's place is the sum of what
stands before it. Strings with interpolation are taken whole first, then cut into pieces, and the code inside is lexed in
turn, twice over, so that strings inside such code are strings again. Here-documents give back the rest of their first line.

Java's matcher recurses over groups that repeat, so those are bounded; a string with more parts than that is closed by a
simpler alternative.

Not told apart: block comments within block comments, `<` as an operator and as a bracket (by what follows), preprocessor branches.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
NUMBER = r"\d\w*+(?:\.\d\w*+)?"
OPERATORS = r"->|=>|::|\?\.|<<|<=|>=|==|&&|\|\||!="
SLASH, BLOCK, HASH = r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)", r"#[^\n]*+"
#: How many parts a string with interpolation may have for its nesting to be followed.
PARTS = 400


def plain(quote: str, line: bool = True) -> str:
    """From a quote to the next that no odd number of backslashes stands before."""
    return rf"{quote}{r'[^\n]' if line else r'[\s\S]'}*?(?<!\\)(?:\\\\){{0,32}}{quote}"


def triple(quote: str) -> str:
    return rf"{quote * 3}[\s\S]*?(?<!\\)(?:\\\\){{0,32}}{quote * 3}"


def braces(opener: str, quote: str) -> str:
    """Code in braces after an opener that ends with one: with braces and strings inside, two deep."""
    inner = rf"(?>[^{{}}{quote}]++|{quote}[^{quote}\n]*+{quote}|\{{[^{{}}]*+\}})"
    return rf"{opener}(?>{inner}{{0,{PARTS}}})\}}"


def parens(opener: str) -> str:
    """Code in parentheses after an opener that ends with one."""
    inner = r'(?>[^()"]++|"[^"\n]*+"|\((?>(?>[^()]++|\([^()]*+\)){0,50})\))'
    return rf"{opener}(?>{inner}{{0,{PARTS}}})\)"


def mixed(quote: str, first: str, code: str, line: bool, prefix: str = "") -> str:
    """A string that holds code: what the code begins with is `first`, a character (none: a backslash)."""
    other = f"|{first}" if first else ""
    return rf"{prefix}{quote}(?>(?>[^{quote}\\{first}{r'\n' if line else ''}]++|{code}|\\[\s\S]{other}){{0,{PARTS}}}){quote}"


@dataclasses.dataclass(frozen=True)
class Lexer:
    """comments and literals, in the order in which they are tried. code: what code in strings looks like, as a whole; open:
    how many characters open it; held: which tokens hold such code."""

    comments: tuple[str, ...]
    literals: tuple[str, ...]
    code: str = ""
    open: int = 2
    held: str = r"^[\s\S]*"
    number: str = NUMBER

    def pattern(self) -> str:
        return "|".join([*self.literals, *self.comments, self.number, NAME, r"\s++", OPERATORS, r"[\s\S]"])


CHARACTER = r"'(?:\\[^\n']{1,10}|\\'|[^\\'\n]{1,4})'"
#: A slash begins a regular expression where a value can't end.
REGEX = r"(?<=[(,=:\[!&|?{};+*%~^<>]\s{0,16}|\breturn\s{1,8}|\btypeof\s{1,8}|\A)/(?![/*])(?>(?>[^/\\\[\n]++|\\.|\[(?>(?>[^\]\\\n]++|\\.){0,200})\]){1,200})/[a-z]*+"
_BRACES, _SWIFT, _JULIA = braces(r"\$\{", '"'), parens(r"\\\("), parens(r"\$\(")
_RUBY, _PHP, _SHARP, _PYTHON = braces(r"#\{", '"'), braces(r"\{(?=\$)", '"'), braces(r"(?<!\{)\{(?!\{)", '"'), braces(r"(?<!\{)\{(?!\{)", "'")
_TICKS = braces(r"\$\{", "`")
_SCRIPT = Lexer((SLASH, BLOCK), (mixed("`", r"\$", _TICKS, False), plain("`", False), plain('"'), plain("'"), REGEX), _TICKS, held="^`")
_NATIVE = Lexer((SLASH, BLOCK), (r'R"(?<d>[^()\\\s]{0,16})\([\s\S]*?\)\k<d>"', plain('"'), CHARACTER, r"(?<=\binclude[ \t]{0,8})<[^>\n]++>"), number=r"\d(?>(?>[\w.]++|'(?=\w)){0,200})")
LEXERS = {
    "python": Lexer(
        (HASH,), (rf"(?i:fr|rf|f)(?:{triple('"')}|{triple("'")}|{mixed('"', r"\{", _PYTHON, True)}|{mixed("'", r"\{", _SHARP, True)})", rf"(?i:rb|br|[rbuf])?(?:{triple('"')}|{triple("'")}|{plain('"')}|{plain("'")})"),
        rf"{_PYTHON}|{_SHARP}", 1, r"^(?i:fr|rf|f)['\"]"),
    "go": Lexer((SLASH, BLOCK), ("`[^`]*+`", plain('"'), CHARACTER)),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": Lexer((SLASH, BLOCK), (triple('"'), plain('"'), CHARACTER)),
    "kotlin": Lexer((SLASH, BLOCK), (triple('"'), mixed('"', r"\$", _BRACES, True), plain('"'), CHARACTER), _BRACES, held='^"'),
    "swift": Lexer((SLASH, BLOCK), (triple('"'), mixed('"', "", _SWIFT, True), plain('"')), _SWIFT, held='^"'),
    "c": _NATIVE,
    "cpp": _NATIVE,
    "rust": Lexer((SLASH, BLOCK), (r'\bb?r(?<h>#{0,8})"[\s\S]*?"\k<h>', plain('"', False), r"\bb?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[^\n])|[^\\'\n])'", r"'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[^\n])|[^\\'\n])'", r"'[A-Za-z_]\w*+")),
    "scala": Lexer((SLASH, BLOCK), (triple('"'), mixed('"', r"\$", _BRACES, True), plain('"'), r"'(?:\\[^\n']{1,10}|[^\\'\n])'"), _BRACES, held='^"'),
    "csharp": Lexer((SLASH, BLOCK), (triple('"'), mixed('"', r"\{", _SHARP, True, r"\$"), r'\$?@\$?"(?>(?>[^"]++|""){0,2000})"', plain('"'), CHARACTER), _SHARP, 1, r'^\$'),
    "ruby": Lexer(
        (r"(?m:^)=begin\b[\s\S]*?(?:\n=end[^\n]*+|\z)", HASH),
        (r"<<(?:[~-]|(?=[\"'`]?[A-Z]))(?<q>[\"'`]?)(?<i>[A-Za-z_]\w*+)\k<q>[^\n]*+\n[\s\S]*?(?m:^)[ \t]*+\k<i>\b", mixed('"', "#", _RUBY, False), mixed("`", "#", _RUBY, False), plain('"', False), plain("'", False), r"%[qwi][(\[{<][^)\]}>]*+[)\]}>]", REGEX),
        _RUBY, held=r'^["`<]'),
    "php": Lexer((SLASH, r"#(?!\[)[^\n]*+", BLOCK, r"\?>[\s\S]*?(?:<\?(?:php\b|=)?|\z)"),
                 (r"<<<[ \t]*+(?<q>[\"']?)(?<i>\w++)\k<q>[ \t]*+\n[\s\S]*?(?:\n[ \t]*+\k<i>\b|\z)", mixed('"', r"\{", _PHP, False), plain('"', False), plain("'", False)), _PHP, 1, r'^["<]'),
    "julia": Lexer((r"#=[\s\S]*?(?:=#|\z)", HASH), (triple('"'), mixed('"', r"\$", _JULIA, False), plain('"', False), r"(?<![\w)\]}'.\p{L}])'(?:\\[^\n']{1,10}|[^\\'\n])'"), _JULIA, held='^"'),
}
#: What here-documents begin with.
_HERE = r"^<<[<~-]?[ \t]*[\"'`]?\w+[\"'`]?"


def token(text: Column, quoted: bool) -> Column:
    return F.struct(text.alias("token"), F.lit(quoted).alias("quoted"))


def lexer(language: Column, languages: list[str]) -> Column:
    """A language's patterns as a struct: pattern (its tokens), code, whole and cut (code in strings, as all of a text, and as
    one piece of it), held (which tokens hold code), open (characters that open code), here (whether it has here-documents)."""
    out = F.when(F.lit(False), F.lit(None))
    for name in languages:
        own = LEXERS[name]
        code = own.code or None
        fields = {"pattern": own.pattern(), "code": code, "whole": code and f"^(?:{code})$", "cut": code and f"{code}|[\\s\\S]+?(?={code}|\\z)", "held": own.held, "open": own.open, "here": name in ("ruby", "php")}
        out = out.when(language == name, F.struct(*[F.lit(v).cast({"open": "int", "here": "boolean"}.get(k, "string")).alias(k) for k, v in fields.items()]))
    return out


def lex(text: Column, own: Column, depth: int = 2) -> Column:
    """array<struct<token, quoted>> by a language's lexer: quoted are the pieces of strings around code, and the marks between."""
    found = F.regexp_extract_all(text, own["pattern"], F.lit(0))
    if not depth:
        return F.transform(found, lambda t: token(t, False))

    def part(text: Column, kind: str) -> Column:
        return F.struct(text.alias("text"), F.lit(kind).alias("kind"))

    def pieces(t: Column) -> Column:
        """A string as what stands around its code, and its code."""

        def cut(p: Column) -> Column:
            inside = F.substring(p, own["open"] + 1, F.length(p) - own["open"] - 1)
            ends = [part(x, "string") for x in (F.substring(p, F.lit(1), own["open"]), F.substring(p, -1, 1))]
            return F.when(F.rlike(p, own["whole"]), F.array(ends[0], part(inside, "code"), ends[1])).otherwise(F.array(part(p, "string")))

        return F.flatten(F.transform(F.regexp_extract_all(t, own["cut"], F.lit(0)), cut))

    def parts(t: Column) -> Column:
        """A token in parts; of a here-document its mark, the rest of that line, which is code, and its lines."""
        begun = own["here"] & t.rlike(_HERE + r"[^\n]*\n")
        head = F.when(begun, F.regexp_extract(t, _HERE, 0)).otherwise("")
        rest = F.when(begun, F.regexp_extract(t, _HERE + r"([^\n]*)", 1)).otherwise("")
        body = F.substring(t, F.length(head) + F.length(rest) + 1, F.length(t))
        holds = (begun & ~F.contains(head, F.lit("'"))) | (~begun & F.rlike(t, own["held"]) & F.rlike(t, own["code"]))
        lines = F.when(holds, pieces(body)).when(begun, F.array(part(body, "string"))).otherwise(F.array(part(t, "token")))
        return F.when(begun, F.concat(F.array(part(head, "string"), part(rest, "code")), lines)).otherwise(lines)

    def lexed(p: Column) -> Column:
        return F.when(p["kind"] == "code", lex(p["text"], own, depth - 1)).otherwise(F.array(token(p["text"], False).withField("quoted", p["kind"] == "string")))

    return F.flatten(F.transform(F.flatten(F.transform(found, parts)), lexed))


#: Tokens that nothing is made of: white space and comments.
def blank(language: Column) -> Column:
    hashes = language.isin("python", "ruby", "php", "julia")
    text = F.col("token")
    comment = text.rlike(r"^(?://|/\*)") & ~language.isin("python", "ruby", "julia") | hashes & text.rlike(r"^(?:#|=begin\b)") | (language == "php") & F.startswith(text, F.lit("?>"))
    return ~F.col("quoted") & (text.rlike(r"^\s") | comment)


#: Bytes of files, about, that a task cuts up; a longer file has a task of its own.
PORTION = 250_000


def tokens(files: DataFrame, languages: Iterable[str] = tuple(LEXERS)) -> DataFrame:
    """files (path, language, text; a path is one file) of these languages as path, language, nth, token, quoted, line (from 1) and column (in
    bytes, from 1).

    Files are dealt by path before they are cut up, so that no token is shuffled: the running sums take each file's tokens
    where they are. Tokens with what stands around them are a few hundred times as large as the text, so files are dealt by
    their bytes: about PORTION to a task, whose sorts then stay in memory, however many files there are.
    """
    languages = [x for x in LEXERS if x in set(languages)]
    own = files.where(F.col("language").isin(*languages)).select("path", "language", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.repartition(size // PORTION + 1, "path")
    lexed = own.withColumn("lexer", lexer(F.col("language"), languages))
    each = lexed.select("path", "language", F.posexplode(lex(F.col("text"), F.col("lexer"))).alias("nth", "t")).select("path", "language", "nth", "t.token", "t.quoted")
    before = W.partitionBy("path").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    size = F.octet_length("token")
    placed = each.withColumns({
        "at": F.coalesce(F.sum(size).over(before), F.lit(0)),
        "line": (F.coalesce(F.sum(F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))).over(before), F.lit(0)) + 1).cast("int"),
    })
    # the first byte of the line that a token with a line end begins
    begun = F.when(F.contains("token", F.lit("\n")), F.col("at") + size - F.octet_length(F.substring_index("token", "\n", -1)))
    line_start = F.coalesce(F.max(begun).over(before), F.lit(0))
    return placed.withColumn("column", (F.col("at") - line_start + 1).cast("int")).drop("at")
