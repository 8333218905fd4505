"""Event filter: operation gate, table gate, then field predicates, as one Catalyst filter.

Predicates are two-valued. Each states what a missing field gives, so no SQL null can leak into `not` or `any`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, patterns

KINDS = ("eq", "ne", "exists", "not_exists", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "regex", "changed")


@dataclass(frozen=True)
class Predicate:
    path: str
    kind: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown predicate {self.kind!r}")
        if self.kind == "regex":
            re.compile(self.value)  # a bad pattern fails here, not in a task

    def column(self, before: str = "before", after: str = "after") -> Column:
        return predicate(self, paths.image(before), paths.image(after))


def _ordered(found: Column, kind: str, value: Any) -> Column:
    compare = {"gt": lambda c: c > value, "gte": lambda c: c >= value, "lt": lambda c: c < value, "lte": lambda c: c <= value}[kind]
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return F.lit(False)
    want, cast = ("string", "string") if isinstance(value, str) else ("number", "double")
    return (paths.kind_of(found) == want) & compare(found.try_cast(cast))


def predicate(p: Predicate, before: Column, after: Column) -> Column:
    found, there = paths.get(after, p.path), paths.exists(after, p.path)
    if p.kind == "exists":
        test = there
    elif p.kind == "not_exists":
        test = ~there
    elif p.kind == "eq":
        test = there & paths.equals(found, p.value)
    elif p.kind == "ne":
        test = there & ~paths.equals(found, p.value)
    elif p.kind in ("gt", "gte", "lt", "lte"):
        test = there & _ordered(found, p.kind, p.value)
    elif p.kind in ("in", "not_in"):
        if not isinstance(p.value, (list, tuple)):
            return F.lit(False)
        inside = reduce(lambda a, b: a | b, (paths.equals(found, v) for v in p.value), F.lit(False))
        test = there & inside if p.kind == "in" else ~there | ~inside
    elif p.kind == "contains":
        items = found.try_cast("array<variant>")
        within = F.coalesce(F.exists(items, lambda x: paths.equals(x, p.value)), F.lit(False))
        test = there & within
        if isinstance(p.value, str):
            test = there & F.when(paths.kind_of(found) == "string", F.contains(found.try_cast("string"), F.lit(p.value))).otherwise(within)
    elif p.kind == "regex":
        test = there & (paths.kind_of(found) == "string") & found.try_cast("string").rlike(p.value)
    else:  # changed
        was = paths.get(before, p.path)
        test = before.isNull() | after.isNull() | ~paths.same(found, was)
    return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class EventFilter:
    ops: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    predicates: Sequence[Predicate] = field(default_factory=tuple)
    mode: str = "all"

    def gate(self) -> Column:
        """Operation and table, which are columns of their own: this part reaches the scan."""
        ops = F.col("op").isin(*self.ops) if self.ops else F.lit(True)
        return ops & patterns.allowed(self.include, self.exclude, F.col("source.db"), F.col("source.table"))

    def __call__(self, events: DataFrame) -> DataFrame:
        if self.mode not in ("all", "any"):
            raise ValueError(f"unknown mode {self.mode!r}")
        gated = events.where(self.gate())
        if not self.predicates:
            return gated
        images = {"_after": paths.image("after")} | ({"_before": paths.image("before")} if any(p.kind == "changed" for p in self.predicates) else {})
        tests = [predicate(p, F.col("_before") if "_before" in images else F.lit(None), F.col("_after")) for p in self.predicates]
        return paths.computed(gated, **images).where(reduce((lambda a, b: a & b) if self.mode == "all" else (lambda a, b: a | b), tests)).drop(*images)


@dataclass(frozen=True)
class SinkFilter:
    """What a sink takes: all its conditions must hold."""

    exclude_synthetic: bool = False
    synthetic_only: bool = False
    producers: Sequence[str] = ()

    def __call__(self, events: DataFrame) -> DataFrame:
        made = F.col("synthetic").isNotNull()
        test = F.lit(True)
        if self.exclude_synthetic:
            test = test & ~made
        if self.synthetic_only:
            test = test & made
        if self.producers:
            test = test & F.coalesce(F.col("synthetic").isin(*self.producers), F.lit(False))
        return events.where(test)
