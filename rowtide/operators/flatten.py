"""Flattens nested row images into one level of `a__b__c` keys.

Images whose columns aren't known are JSON, so the generic form is a vectorised pass over Arrow batches (`flatten`). Where
the schema is known, `flatten_struct` is a plain projection that Catalyst can prune.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CollisionError(ValueError):
    pass


@dataclass(frozen=True)
class FlattenOptions:
    separator: str = "__"
    max_depth: int | None = None  #: objects at this depth stay as they are; top-level values are at 0
    empty_object: str = "preserve"  #: preserve, drop, null
    lists: str = "preserve"  #: preserve, index
    empty_list: str = "preserve"  #: preserve, drop, null
    collision: str = "last"  #: last, first, error

    def __post_init__(self) -> None:
        for name, known in (("empty_object", ("preserve", "drop", "null")), ("lists", ("preserve", "index")), ("empty_list", ("preserve", "drop", "null")), ("collision", ("last", "first", "error"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {known}")


def flatten_value(value: Any, options: FlattenOptions) -> Any:
    """One image; anything but an object is returned as it is. Keys are taken in sorted order."""
    if not isinstance(value, dict):
        return value
    out: dict[str, Any] = {}

    def put(key: str, leaf: Any) -> None:
        if key in out:
            if options.collision == "error":
                raise CollisionError(f"two values for {key!r}")
            if options.collision == "first":
                return
        out[key] = leaf

    def empty(key: str, leaf: Any, policy: str) -> None:
        if policy != "drop":
            put(key, leaf if policy == "preserve" else None)

    def walk(key: str, leaf: Any, depth: int) -> None:
        if isinstance(leaf, dict):
            if not leaf:
                empty(key, leaf, options.empty_object)
            elif options.max_depth is not None and depth >= options.max_depth:
                put(key, leaf)
            else:
                for name in sorted(leaf):
                    walk(f"{key}{options.separator}{name}", leaf[name], depth + 1)
        elif isinstance(leaf, list):
            if not leaf:
                empty(key, leaf, options.empty_list)
            elif options.lists == "index":
                for k, item in enumerate(leaf):
                    walk(f"{key}{options.separator}{k}", item, depth + 1)
            else:
                put(key, leaf)
        else:
            put(key, leaf)

    for name in sorted(value):
        walk(name, value[name], 0)
    return out


def _plain(value: Any, separator: str) -> Any:
    """flatten_value under the default options, which keep lists, empty objects and the last of two values."""
    if not isinstance(value, dict):
        return value
    out: dict[str, Any] = {}

    def walk(head: str, inner: dict[str, Any]) -> None:
        for name in sorted(inner):
            leaf = inner[name]
            if type(leaf) is dict and leaf:
                walk(f"{head}{name}{separator}", leaf)
            else:
                out[head + name] = leaf

    walk("", value)
    return out


def _flattener(options: FlattenOptions):
    plain = options == FlattenOptions(separator=options.separator)
    write = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode

    def one(text: str | None) -> str | None:
        if text is None or "{" not in text[1:] and "[" not in text:  # a flat object already
            return text
        value = json.loads(text)
        return write(_plain(value, options.separator) if plain else flatten_value(value, options))

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run


def flatten(events: DataFrame, options: FlattenOptions = FlattenOptions(), columns: tuple[str, ...] = ("before", "after")) -> DataFrame:
    """Both images flattened; only these columns travel to Python. A collision under `error` fails the job, as it would a batch."""
    run = _flattener(options)
    return events.withColumns({c: run(c) for c in columns})


def flatten_struct(value: Column, kind: T.StructType, separator: str = "__", max_depth: int | None = None) -> list[Column]:
    """Leaf columns of a struct of known schema, named by their path."""
    out: list[Column] = []

    def walk(column: Column, field: T.DataType, key: str, depth: int) -> None:
        if isinstance(field, T.StructType) and field.fields and not (max_depth is not None and depth >= max_depth):
            for f in field.fields:
                walk(column[f.name], f.dataType, f"{key}{separator}{f.name}", depth + 1)
        else:
            out.append(column.alias(key))

    for f in kind.fields:
        walk(value[f.name], f.dataType, f.name, 0)
    return out
