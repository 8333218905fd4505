"""Typed values from JSON fields, each with a validity flag, so that bad rows can be split off before a write.

A coercion takes a value and, if it is at hand, its kind, and gives (value, valid). Null and missing are valid nulls. Nothing here can fail a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

Coerced = tuple[Column, Column]


def _absent(v: Column) -> Column:
    return F.coalesce(v.isNull() | F.is_variant_null(v), F.lit(True))


def _of(v: Column, value: Column) -> Coerced:
    return value, _absent(v) | value.isNotNull()


def _kind(v: Column, k: Column | None) -> Column:
    return paths.kind_of(v) if k is None else k


def _whole(v: Column, k: Column | None = None) -> Column:
    """Numbers without a fraction that a long holds."""
    number = F.when(_kind(v, k) == "number", v)
    n = number.try_cast("bigint")
    return F.when(n.cast("double") == number.try_cast("double"), n)


def int32(v: Column, k: Column | None = None) -> Coerced:
    return _of(v, _whole(v, k).try_cast("int"))


def int64(v: Column, k: Column | None = None) -> Coerced:
    text = F.when((_kind(v, k) == "string") & v.try_cast("string").rlike(r"^[+-]?\d+$"), v.try_cast("string")).try_cast("bigint")
    return _of(v, F.coalesce(_whole(v, k), text))


def float64(v: Column, k: Column | None = None) -> Coerced:
    return _of(v, F.when(_kind(v, k) == "number", v.try_cast("double")))


def float32(v: Column, k: Column | None = None) -> Coerced:
    return _of(v, F.when(_kind(v, k) == "number", v.try_cast("float")))


def boolean(v: Column, k: Column | None = None) -> Coerced:
    n = _whole(v, k)
    return _of(v, F.when(_kind(v, k) == "boolean", v.try_cast("boolean")).when(n == 0, False).when(n == 1, True))


def utf8(v: Column, k: Column | None = None) -> Coerced:
    return _of(v, F.when(~_absent(v), F.when(_kind(v, k) == "string", v.try_cast("string")).otherwise(F.to_json(v))))


def binary(v: Column, k: Column | None = None) -> Coerced:
    wrapped = F.try_to_binary(paths.get(v, "_base64", "string"), F.lit("base64"))
    return _of(v, F.when(_kind(v, k) == "string", F.encode(v.try_cast("string"), "UTF-8")).otherwise(wrapped))


def date(v: Column, k: Column | None = None) -> Coerced:
    text = v.try_cast("string")
    return _of(v, F.when((_kind(v, k) == "string") & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")))


def timestamp(v: Column, k: Column | None = None) -> Coerced:
    """RFC 3339, or without a zone as UTC; numbers are milliseconds."""
    text = v.try_cast("string")
    zone = F.when(text.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")
    return _of(v, F.when((_kind(v, k) == "string") & shaped, F.try_to_timestamp(zone)).otherwise(F.timestamp_millis(_whole(v, k))))


def truncated(text: Column, precision: int, scale: int) -> Column:
    """Decimal text with surplus digits cut off, not rounded."""
    cut = F.regexp_extract(text, rf"^\s*([+-]?\d*(?:\.\d{{0,{scale}}})?)\d*\s*$", 1)
    return F.nullif(F.regexp_replace(cut, r"\.$", ""), F.lit("")).try_cast(f"decimal({precision},{scale})")


def decimal(precision: int, scale: int) -> Callable[[Column], Coerced]:
    """Strings are truncated, JSON numbers rounded."""

    def of(v: Column, k: Column | None = None) -> Coerced:
        rounded = F.when(_kind(v, k) == "number", v.try_cast("decimal(38,18)")).try_cast(f"decimal({precision},{scale})")
        return _of(v, F.when(_kind(v, k) == "string", truncated(v.try_cast("string"), precision, scale)).otherwise(rounded))

    return of


def array(item: Callable[[Column], Coerced]) -> Callable[[Column], Coerced]:
    """A bad item makes the list invalid."""

    def of(v: Column, k: Column | None = None) -> Coerced:
        items = v.try_cast("array<variant>")
        good = F.coalesce(F.forall(items, lambda x: item(x)[1]), F.lit(False))
        return F.when(good, F.transform(items, lambda x: item(x)[0])), _absent(v) | good

    return of


def string_map(v: Column, k: Column | None = None) -> Coerced:
    entries = v.try_cast("map<string,variant>")
    return _of(v, F.transform_values(entries, lambda _, x: utf8(x)[0]))


# -- scalar helpers of the wire formats ---------------------------------------------------------------------------------


def lsn_number(lsn: Column) -> Column:
    """`hi/lo` hexadecimal position as a number; null if it isn't one. Decimal, as it may exceed a signed long."""
    hi, lo = (F.conv(F.split_part(lsn, F.lit("/"), F.lit(k)), 16, 10).try_cast("decimal(20,0)") for k in (1, 2))
    return F.when(lsn.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), (hi * F.lit(2**32).cast("decimal(20,0)") + lo).cast("decimal(20,0)"))


#: Seconds from the Unix epoch to 2000-01-01, where PostgreSQL's clock begins.
PG_EPOCH_S = 946_684_800


def pg_micros_to_millis(us: Column) -> Column:
    return F.floor(us / 1000).cast("bigint") + F.lit(PG_EPOCH_S * 1000)


def millis_to_pg_micros(ms: Column) -> Column:
    return (ms - F.lit(PG_EPOCH_S * 1000)) * 1000


def seconds_to_millis(s: Column) -> Column:
    return s * 1000


def position_text(source: Column) -> Column:
    """`lsn:...`, `binlog:file=...,pos=...` or `seq:...`, the first that is there."""
    return F.coalesce(
        F.concat(F.lit("lsn:"), source["lsn"]),
        F.when(source["file"].isNotNull() & source["pos"].isNotNull(), F.concat(F.lit("binlog:file="), source["file"], F.lit(",pos="), source["pos"].cast("string"))),
        F.concat(F.lit("seq:"), source["sequence"]),
    )


def snapshot_flag(source: Column) -> Column:
    return F.when(source["snapshot"].isNotNull(), ~source["snapshot"].isin("false", ""))
