"""Typed access to JSON row images, with two-valued comparison rules.

A path that is missing, leads through something that isn't an object, or holds JSON null, has no value. Numbers compare as
doubles, strings by bytes, everything else by structure.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image(json_text: Column | str) -> Column:
    """The image as VARIANT; null if the text is null or isn't JSON."""
    return F.try_parse_json(F.col(json_text) if isinstance(json_text, str) else json_text)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are evaluated once a row. The one-row generator keeps the optimizer from copying their
    expressions into each filter and branch above, where each copy would parse the image anew."""
    held = df.withColumn("_computed", F.struct(*(c.alias(n) for n, c in columns.items())))
    return held.select(*(F.col(f"`{c}`") for c in df.columns), F.inline(F.array("_computed")))


def path_of(dotted: str) -> str:
    """Variant path of a dotted path; objects only, so no index syntax reaches it."""
    return "$" + "".join("[" + json.dumps(p).replace('"', "'") + "]" if "'" not in p else f'["{p}"]' for p in dotted.split("."))


def get(v: Column, dotted: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path_of(dotted), kind)


#: First letters of a variant's type name, and its kind.
_KINDS = {
    "STR": "string", "BOO": "boolean", "ARR": "array", "OBJ": "object", "BIG": "number", "DOU": "number", "DEC": "number", "FLO": "number", "INT": "number", "SMA": "number", "TIN": "number",
}


def kind_of(v: Column) -> Column:
    """number, string, boolean, array, object, other; null for null."""
    known = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.coalesce(F.try_element_at(known, F.substring(F.schema_of_variant(v), 1, 3)), F.lit("other")))


def exists(v: Column, dotted: str) -> Column:
    found = get(v, dotted)
    return F.coalesce(found.isNotNull() & ~F.is_variant_null(found), F.lit(False))


def text(v: Column, dotted: str) -> Column:
    """Strings as they are, other values as JSON text, null if there is no value."""
    return text_of(get(v, dotted))


def text_of(found: Column) -> Column:
    kind = kind_of(found)
    return F.when(kind == "string", found.try_cast("string")).when(kind.isNotNull(), F.to_json(found))


def scalar_text(v: Column, dotted: str) -> Column:
    """As text, but null for arrays and objects."""
    return scalar_of(get(v, dotted))


def scalar_of(found: Column) -> Column:
    kind = kind_of(found)
    return F.when(kind == "string", found.try_cast("string")).when(kind.isin("number", "boolean"), F.to_json(found))


def equals(found: Column, value: Any) -> Column:
    """JSON equality with a Python value; never null."""
    if value is None:
        return F.coalesce(found.isNull() | F.is_variant_null(found), F.lit(True))
    if isinstance(value, bool):
        test = (kind_of(found) == "boolean") & (found.try_cast("boolean") == value)
    elif isinstance(value, (int, float)):
        test = (kind_of(found) == "number") & (found.try_cast("double") == float(value))
    elif isinstance(value, str):
        test = (kind_of(found) == "string") & (found.try_cast("string") == value)
    else:
        test = canonical(found) == canonical(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(test, F.lit(False))


def canonical(v: Column) -> Column:
    """Text that is equal for equal values: keys sorted, and a number like another of equal value at the top."""
    return F.when(kind_of(v) == "number", v.try_cast("double").cast("string")).otherwise(F.to_json(v))


def same(a: Column, b: Column) -> Column:
    """JSON equality of two variants; missing equals missing only."""
    return canonical(a).eqNullSafe(canonical(b))
