"""Routing templates: `${a.b.c}` of up to three segments over an event, compiled to one concat expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

SEGMENTS = 3
#: Envelope fields that a template can name; any other path is looked up in the row image.
FIELDS = {
    "op": "op", "ts_ms": "ts_ms", "event_id": "event_id", "tenant_id": "tenant_id", "source.db": "source.db", "source.table": "source.table", "source.schema": "source.schema",
    "source.name": "source.name", "source.connector": "source.connector", "transaction.id": "transaction.id",
}


class TemplateError(ValueError):
    pass


def parse(template: str) -> list[tuple[bool, str]]:
    """(is a reference, text) parts."""
    parts: list[tuple[bool, str]] = []
    rest = template
    while rest:
        before, found, rest = rest.partition("${")
        if before:
            parts.append((False, before))
        if found:
            name, closed, rest = rest.partition("}")
            if not closed:
                raise TemplateError(f"unclosed reference in {template!r}")
            if not name or any(not s for s in name.split(".")):
                raise TemplateError(f"empty reference in {template!r}")
            if name.count(".") >= SEGMENTS:
                raise TemplateError(f"reference of more than {SEGMENTS} segments in {template!r}")
            parts.append((True, name))
    return parts


def is_static(template: str) -> bool:
    return not any(ref for ref, _ in parse(template))


def _value(name: str, payload: Column) -> Column:
    for prefix, where in (("after.", "after"), ("before.", "before")):
        if name.startswith(prefix):
            return paths.text(paths.image(where), name.removeprefix(prefix))
    return F.col(FIELDS[name]).cast("string") if name in FIELDS else paths.text(payload, name)


def compile(template: str, payload: Column, strict: bool = True) -> Column:
    """Strict: null if a reference has no value. Lenient: such a reference is an empty string."""
    values = [_value(t, payload) if ref else F.lit(t) for ref, t in parse(template)]
    if not strict:
        values = [F.coalesce(v, F.lit("")) for v in values]
    return F.concat(*values) if values else F.lit("")
