"""Relative paths with '/': checks, ancestors, folding and exclusion."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the library's own that a path must not have as a component (in any case).
RESERVED = (".arbora", ".arboraignore")


def violations(path: Column) -> Column:
    parts = F.split(path, "/")
    checks = {
        "empty": path == "",
        "too long": F.octet_length(path) > 4096,
        "NUL": F.contains(path, F.lit("\x00")),
        "backslash": F.contains(path, F.lit("\\")),
        "component": F.exists(parts, lambda p: p.isin("", ".", "..")) & (path != ""),
        "reserved": F.exists(parts, lambda p: F.lower(p).isin(*RESERVED)),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def ancestors(path: Column) -> Column:
    """All proper prefixes, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def prefixes(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(path))


@F.pandas_udf(T.StringType())
def _folded(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else "".join(c.lower() for c in unicodedata.normalize("NFC", p)))


def path_key(path: Column | str) -> Column:
    """The spelling under which paths collide: NFC, each character in lower case.

    Spark has no Unicode normalisation, so paths that aren't ASCII are folded in Python; Python gets nulls for all others."""
    path = F.col(path) if isinstance(path, str) else path
    plain = path.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(path)).otherwise(_folded(F.when(~plain, path)))


def ignore_patterns(text: Column) -> Column:
    """parse_ignore() for texts in rows."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def parse_ignore(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    lines = (line.strip() for line in text.splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths; '*' and '?' match '/' too."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            star = pattern[i : i + 3]
            if star == "**/" and (i == 0 or pattern[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
                continue
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out += "(?:" + "|".join(glob_regex(p)[4:-2] for p in pattern[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return "(?s:" + out + ")$"


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Reserved anywhere, or a prefix that a pattern matches; a pattern without '/' matches at any depth."""
    reserved = F.exists(F.split(path, "/"), lambda p: F.lower(p).isin(*RESERVED))
    every = [q for p in patterns for q in ((p,) if "/" in p else (p, "**/" + p))]
    if not every:
        return reserved
    regex = "^(?:" + "|".join(glob_regex(p) for p in every) + ")"
    return reserved | F.exists(prefixes(path), lambda p: p.rlike(regex))
