"""Patterns written for RE2 in the dialects of Java and Python, and globs as patterns.

RE2's word boundaries, white space, dots and line ends are ASCII, and its classes may hold POSIX names. A pattern is cut
into atoms, and what the other engine reads differently is spelled out; what it can't express is refused.
"""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_SPACE = r"\t\n\f\r "
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")
_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9QEGZC]|[*+?}]\+")
_GROUP = re.compile(r"\((?:\?(?:P?<(\w+)>|([imsU-]*):))?")
_FLAGS = re.compile(r"\(\?([imsU-]+)\)")
# fixed values: the POSIX classes of RE2
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


def class_end(pattern: str, i: int) -> int:
    """Where the class that begins at i ends."""
    j = i + 1 + (pattern[i + 1 : i + 2] == "^")
    j += pattern[j : j + 1] == "]"
    while pattern[j] != "]":
        j = pattern.index(":]", j) + 2 if pattern.startswith("[:", j) else j + 1 + (pattern[j] == "\\")
    return j + 1


def atom_end(pattern: str, i: int) -> int:
    """Where the atom (character, escape, class or group) that begins at i ends."""
    if pattern[i] == "\\":
        return pattern.index("}", i) + 1 if pattern[i + 1 : i + 2] in "pPx" and pattern[i + 2 : i + 3] == "{" else i + 2 + (pattern[i + 1 : i + 2] in "pP") + 2 * (pattern[i + 1 : i + 2] == "x")
    if pattern[i] == "[":
        return class_end(pattern, i)
    if pattern[i] != "(":
        return i + 1
    j = i + 1
    while pattern[j] != ")":
        j = atom_end(pattern, j)
    return j + 1


def atoms(pattern: str) -> list[tuple[str, str]]:
    """(atom, quantifier) in order."""
    out, i = [], 0
    while i < len(pattern):
        j = atom_end(pattern, i)
        quantifier = _QUANTIFIER.match(pattern, j)
        out.append((pattern[i:j], quantifier[0] if quantifier else ""))
        i = j + len(out[-1][1])
    return out


def wordy(part: tuple[str, str] | None, last: bool) -> bool:
    """Whether the part's match certainly begins (or, if last, ends) with a word character."""
    if part is None or part[1][:1] in ("*", "?") or part[1].startswith("{0"):
        return False
    atom = part[0]
    if atom[0] == "[":
        return re.fullmatch(r"\[(?:\w-\w|\w|\\[dw])+\]", atom, re.ASCII) is not None
    if atom[0] != "(":
        return re.fullmatch(r"\w|\\[dw]", atom, re.ASCII) is not None
    head = _GROUP.match(atom)
    if _FLAGS.fullmatch(atom) or head is None:
        return False
    branches: list[list[tuple[str, str]]] = [[]]
    for part in atoms(atom[head.end() : -1]):
        branches.append([]) if part[0] == "|" else branches[-1].append(part)
    return all(b and wordy(b[-1 if last else 0], last) for b in branches)


def translate(pattern: str, java: bool) -> str:
    parts, out = atoms(pattern), []
    for i, (atom, quantifier) in enumerate(parts):
        if atom in (r"\b", r"\B") and java:
            before, after = wordy(parts[i - 1] if i else None, True), wordy(parts[i + 1] if i + 1 < len(parts) else None, False)
            # next to a word character, a boundary is that no word character is on the other side
            near = f"(?<!{_WORD})" if after and not before else f"(?!{_WORD})" if before and not after else _BOUNDARY
            atom = near if atom == r"\b" else _NO_BOUNDARY
        elif atom in (r"\s", r"\S"):
            atom = f"[{'^' if atom == r'\S' else ''}{_SPACE}]"
        elif atom == r"\z" and not java:
            atom = r"\Z"
        elif atom[0] == "[":
            atom = class_of(atom, java)
        elif atom[0] == "(" and not _FLAGS.fullmatch(atom):
            head = _GROUP.match(atom)
            name = head[1] and f"(?<{head[1]}>" if java else head[1] and f"(?P<{head[1]}>"
            atom = (name or head[0]) + translate(atom[head.end() : -1], java) + ")"
        out.append(atom + quantifier)
    return "".join(out)


def class_of(atom: str, java: bool) -> str:
    negated = atom[1] == "^"
    body = atom[1 + negated : -1]
    if body.startswith("]"):
        body = r"\]" + body[1:]
    out, i = [], 0
    while i < len(body):
        named = re.compile(r"\[:(\^?)(\w+):\]").match(body, i)
        if named and (named[2] not in POSIX or named[1]):
            raise ValueError(f"no such class, or a negated one inside another: {atom}")
        if named:
            out.append(POSIX[named[2]])
            i = named.end()
        elif body[i] == "\\":
            out.append({r"\s": _SPACE}.get(body[i : i + 2], body[i : i + 2]))
            i += 2
        else:
            # an opening bracket in a class is a union in Java, a doubled ampersand an intersection
            out.append("\\" + body[i] if body[i] in "[&" else body[i])
            i += 1
    return "[" + "^" * negated + "".join(out) + "]"


def refuse(pattern: str) -> None:
    # classes and backslashes become a letter, since what stands around them isn't adjacent
    bare = re.sub(r"\\\\|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    flags = [f for f in re.findall(r"\(\?([a-zA-Z-]+)[:)]", bare) if "U" in f]
    if _REFUSED.search(bare) or flags:
        raise ValueError(f"not in the common subset of RE2, Java and Python: {pattern}")


def to_java(pattern: str) -> str:
    """The pattern for Spark's regular expressions, with the meaning that it has in RE2."""
    refuse(pattern)
    return "(?d)" + translate(pattern, True)


def to_python(pattern: str, flags: str = "") -> re.Pattern:
    """The pattern compiled for Python, with the meaning that it has in RE2; classes by Unicode property need the `regex`
    package."""
    refuse(pattern)
    text, options = translate(pattern, False), re.ASCII | (re.I if "i" in flags else 0)
    if re.search(r"(?<!\\)(?:\\\\)*\\[pP]", text):
        import regex

        return regex.compile(text, (regex.I if "i" in flags else 0) | regex.V0)
    return re.compile(text, options)


def required_literal(pattern: str) -> str:
    """A text that every match of the pattern contains; empty if none is certain."""
    runs, run = [], ""
    if "|" in [a for a, _ in atoms(pattern)] or re.search(r"\(\?[a-zA-Z]*i", pattern):
        return ""
    for atom, quantifier in atoms(pattern):
        plain = atom if len(atom) == 1 and atom not in ".^$" else atom[1] if re.fullmatch(r"\\[^0-9A-Za-z]", atom) else ""
        once = plain and quantifier in ("", "+", "+?")
        runs.append(run + (plain if once else ""))
        run = runs[-1] if once and not quantifier else plain if once else run if atom in (r"\b", r"\B") else ""
    return max(runs, key=len, default="")


def glob_to_regex(glob: str) -> str:
    """A shell glob over one path segment: `*` and `?` don't cross a slash, classes stay."""
    out = re.sub(r"\\?[.+(){}|^$]", lambda m: "\\" + m[0][-1], glob)
    return "^" + out.replace("*", "[^/]*").replace("?", "[^/]") + "$"


def ignore_to_regex(glob: str, rooted: bool) -> str:
    """A line of an ignore file: `**` crosses slashes; anchored at the root, or at any path component; all other
    characters, brackets too, are literal."""
    out, i = ["^" if rooted else "(^|/)"], 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out.append(".*")
            i += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or (re.escape(glob[i]) if glob[i] in ".+()|^${}[]\\" else glob[i]))
        i += 1
    return "".join(out) + "(/|$)"
