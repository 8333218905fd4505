"""Pipeline specifications: dictionaries (from YAML or JSON) to operator chains."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..operators.filter import EventFilter, Predicate, SinkFilter
from ..operators.flatten import FlattenOptions, flatten
from ..operators.outbox import OutboxOptions, outbox
from ..operators.udf import process_batch


def merge(base: Any, patch: Any) -> Any:
    """Deep merge: objects by key, lists by index, else the patch."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return base | {k: merge(base[k], v) if k in base else v for k, v in patch.items()}
    if isinstance(base, list) and isinstance(patch, list):
        return [merge(base[k], patch[k]) if k < len(base) and k < len(patch) else (patch[k] if k < len(patch) else base[k]) for k in range(max(len(base), len(patch)))]
    return patch


def expand(text: str, env: Mapping[str, str]) -> str:
    """`${NAME}` from the environment; other references stay, as they may be templates."""
    return re.sub(r"\$\{([A-Za-z_]\w*)\}", lambda m: env.get(m[1], m[0]), text)


def processor(spec: Mapping[str, Any], functions: Mapping[str, Callable] | None = None) -> Callable[[DataFrame], DataFrame]:
    """One processor from its specification: type filter, flatten, outbox or function."""
    options = {k: v for k, v in spec.items() if k not in ("type", "id")}
    kind = spec["type"]
    if kind == "filter":
        tests = tuple(Predicate(p["path"], p["kind"], p.get("value")) for p in options.pop("predicates", ()))
        return EventFilter(predicates=tests, **options)
    if kind == "flatten":
        return lambda e: flatten(e, FlattenOptions(**options))
    if kind == "outbox":
        return lambda e: outbox(e, OutboxOptions(**options))
    if kind == "function":
        return lambda e: process_batch(e, (functions or {})[options["name"]], options.get("batch_size", 2_000))
    raise ValueError(f"unknown processor {kind!r}")


def chain(specs: list[Mapping[str, Any]], functions: Mapping[str, Callable] | None = None) -> list[Callable[[DataFrame], DataFrame]]:
    return [processor(s, functions) for s in specs]


def sink_filter(spec: Mapping[str, Any]) -> SinkFilter:
    return SinkFilter(**spec)
