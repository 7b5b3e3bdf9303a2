"""Glob lists: normalisation on the driver, matching as one anchored regular expression a pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_patterns(values: list[str]) -> list[str]:
    """Patterns as lower-case POSIX paths, each once and sorted. Empty ones, absolute ones and ones that climb are errors."""
    out = set()
    for value in values:
        text = value.replace("\\", "/")
        parts = [p for p in text.split("/") if p not in ("", ".")]
        if not parts or text.startswith("/") or re.match(r"[A-Za-z]:", text) or ".." in parts:
            raise ValueError(f"not a relative pattern: {value!r}")
        out.add("/".join(parts).casefold())
    return sorted(out)


def glob_regex(pattern: str) -> str:
    """Java regex that finds a match only if the whole string matches the glob; * and ? match any sign, also a slash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))) > 0:
            body = pattern[i:end]
            negated, i = body.startswith("!"), end + 1
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", c) if c.isascii() else c)
    return f"(?s)^{''.join(out)}\\z"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether the lower-cased path matches one of the patterns; no patterns match nothing."""
    return F.lit(False) if not patterns else F.lower(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def profile(path: Column, preserve: list[str], lists: dict[str, list[str]], preset: str, strict: bool = True) -> Column:
    """The profile whose list matches: preserve before all others, none gives preset; several are an error, or 'conflict' if not strict."""
    hits = F.array_compact(F.array(*(F.when(matches_any(path, globs), name) for name, globs in lists.items())))
    several = F.raise_error(F.concat(F.lit("several profiles match "), path, F.lit(": "), F.array_join(hits, ", "))).cast("string") if strict else F.lit("conflict")
    return F.when(matches_any(path, preserve), "preserve").when(F.size(hits) > 1, several).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(preset)))
