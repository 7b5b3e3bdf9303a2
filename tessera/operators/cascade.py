"""First-match rule lists: one ordered list of (predicate, code) folded into a single conditional."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose predicate is true; unknown counts as false."""
    out = None
    for predicate, value in rules:
        out = (F if out is None else out).when(predicate, value)
    return out.otherwise(otherwise)


def first_number(rules: Sequence[Column]) -> Column:
    """1-based number of the first true rule, null if none is."""
    return first_match([(p, F.lit(i)) for i, p in enumerate(rules, 1)])


def violations(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules that are broken: those whose condition isn't true."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules)))
