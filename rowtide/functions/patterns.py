"""Table patterns as column predicates. `q.n`, `n`, `q.*`, `prefix%`, `prefix*` and `*.n`; only a trailing `%` or `*` is a wildcard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(pattern: str, value: Column) -> Column:
    if pattern in ("*", "%"):
        return F.lit(True)
    return value.startswith(pattern[:-1]) if pattern[-1:] in ("*", "%") else value == pattern


def matches(pattern: str, qualifier: Column, name: Column) -> Column:
    """Never null: a missing name matches nothing but a wildcard."""
    left, dot, right = pattern.partition(".")
    test = _part(left, qualifier) & _part(right, name) if dot else _part(left, name)
    return F.coalesce(test, F.lit(False))


def allowed(include: Sequence[str], exclude: Sequence[str], qualifier: Column, name: Column) -> Column:
    """Excluded tables go first; an empty include list lets all in."""
    some = lambda ps: reduce(lambda a, b: a | b, (matches(p, qualifier, name) for p in ps), F.lit(False))
    return ~some(exclude) & (some(include) if include else F.lit(True))
