"""Pattern dialects: regular expressions and globs for the JVM, the version order, and small text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = {"m": "(?m)", "i": "(?i)", "s": "(?s)"}


def java_regex(pattern: str) -> str:
    """A Python pattern for java.util.regex: braces that aren't quantifiers are escaped."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "{" and not inside:
            m = re.match(r"\{\d*,?\d*\}", pattern[i:])
            if m and m.group(0) not in ("{}", "{,}") and out:
                out.append(m.group(0))
                i += len(m.group(0))
                continue
            c = "\\{"
        elif c == "}" and not inside:
            c = "\\}"
        out.append(c)
        i += 1
    return "".join(out)


def valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def required_literals(pattern: str) -> list[str]:
    """Texts of which every match holds one at least, up to the case of ASCII letters; empty if the pattern requires none.

    Of what a pattern requires (runs of plain characters, repeated parts that occur once at least, one branch of each option), the set whose shortest text is longest."""

    def best(items) -> list[str]:  # noqa: ANN001
        found, run = [], ""

        def close() -> None:
            nonlocal run
            if run:
                found.append([run])
            run = ""

        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            if name == "AT":  # has no width
                continue
            close()
            if name == "SUBPATTERN":
                found.append(best(arg[-1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                found.append(best(arg[2]))
            elif name == "ATOMIC_GROUP":
                found.append(best(arg))
            elif name == "BRANCH":
                parts = [best(x) for x in arg[1]]
                found.append(list(dict.fromkeys(x for part in parts for x in part)) if all(parts) else [])
        close()
        return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=[])

    return best(re._parser.parse(pattern)) if valid(pattern) else []


def glob_regex(glob: str) -> str:
    """fnmatch semantics as a regex that Java and RE2 know: * and ? match any character, slashes included; the whole text must match."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[":
            j = i + 1
            if j < len(glob) and glob[j] == "!":
                j += 1
            if j < len(glob) and glob[j] == "]":
                j += 1
            while j < len(glob) and glob[j] != "]":
                j += 1
            if j >= len(glob):
                out.append("\\[")
            else:
                body = glob[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out.append("[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]")
                i = j
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) if ord(c) < 128 else c)
        i += 1
    return "^(?:" + "".join(out) + ")$"


def file_glob_regex(glob: str) -> str:
    """The file patterns of rules: ** matches all; a leading **/ before a name without * means the whole path or its end; else the glob."""
    if glob in ("**", "*"):
        return "^"
    if glob.startswith("**/") and "*" not in glob[3:]:
        rest = re.sub(r"([^A-Za-z0-9_])", r"\\\1", glob[3:])
        return f"(?:^|/){rest}$"
    return glob_regex(glob)


def version_segments(v: Column) -> Column:
    """A version as an array of integers: - counts as ., other characters than digits go, empty segments are 0."""
    return F.transform(F.split(F.regexp_replace(v, "-", "."), "\\."), lambda s: F.coalesce(F.nullif(F.regexp_replace(s, "[^0-9]", ""), F.lit("")).cast("int"), F.lit(0)))


def version_key(v: Column) -> Column:
    """A text that sorts as the version does: each segment's digits behind their number, so numbers of any length are in order and a shorter version comes first."""
    digits = F.transform(F.split(F.regexp_replace(v, "-", "."), "\\."), lambda s: F.regexp_replace(F.regexp_replace(s, "[^0-9]", ""), "^0+", ""))
    return F.array_join(F.transform(digits, lambda s: F.concat(F.lpad(F.length(s).cast("string"), 4, "0"), s)), "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(c, F.lit("-"), F.lit("_"))), "[^a-z0-9_]", "_")


SEVERITIES = ["critical", "high", "medium", "low"]


def severity_score(c: Column) -> Column:
    """critical 3 .. low 0; others null."""
    return F.when(c == "critical", 3).when(c == "high", 2).when(c == "medium", 1).when(c == "low", 0)
