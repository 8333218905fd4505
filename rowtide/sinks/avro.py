"""Avro in the registry's wire format: a zero byte, the schema's id, the datum. Schemas come from declared columns or from JSON."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ColumnInfo, TypeOptions, avro_type, spark_type


def from_json_value(name: str, value: Any) -> Any:
    """Avro schema of a JSON value: all fields nullable, the first item decides a list's items, an empty list holds strings."""
    if isinstance(value, dict):
        return {"type": "record", "name": name, "fields": [{"name": k, "type": ["null", from_json_value(f"{name}_{k}", value[k])], "default": None} for k in sorted(value)]}
    if isinstance(value, list):
        return {"type": "array", "items": ["null", from_json_value(f"{name}_item", value[0]) if value else "string"]}
    return "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def from_columns(name: str, columns: list[ColumnInfo], options: TypeOptions = TypeOptions()) -> dict[str, Any]:
    return {"type": "record", "name": name, "fields": [{"name": c.name, "type": ["null", avro_type(spark_type(c, options))], "default": None} for c in columns]}


#: Position fields by connector.
_POSITION = {
    "mysql": [("server_id", "long"), ("gtid", "string"), ("file", "string"), ("pos", "long"), ("row", "int")],
    "postgresql": [("lsn", "string"), ("txId", "long"), ("xmin", "long")],
}


def envelope_schema(name: str, columns: list[ColumnInfo], connector: str = "mysql", options: TypeOptions = TypeOptions()) -> dict[str, Any]:
    optional = lambda n, t: {"name": n, "type": ["null", t], "default": None}
    source = {"type": "record", "name": "Source", "fields": [optional(n, t) for n, t in (("version", "string"), ("connector", "string"), ("name", "string"), ("ts_ms", "long"), ("db", "string"), ("schema", "string"), ("table", "string"), ("snapshot", "string"), *_POSITION.get(connector, []))]}
    tx = {"type": "record", "name": "Transaction", "fields": [optional("id", "string"), optional("total_order", "long"), optional("data_collection_order", "long")]}
    return {"type": "record", "name": name, "fields": [optional("before", from_columns("Value", columns, options)), optional("after", "Value"), optional("source", source), {"name": "op", "type": "string"}, {"name": "ts_ms", "type": "long"}, optional("event_id", "string"), optional("transaction", tx)]}


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _lenient(kind: str, value: Any) -> Any:
    """The value as this type; what doesn't fit becomes the type's zero."""
    try:
        if kind in ("int", "long"):
            return int(value)
        if kind in ("float", "double"):
            return float(value)
    except (TypeError, ValueError):
        return 0
    if kind == "boolean":
        return value is True or value == 1
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def records(schema: Any) -> dict[str, Any]:
    """All records of a schema by name, as a field may refer to one that stands in a branch that isn't taken."""
    if isinstance(schema, list):
        return {k: v for part in schema for k, v in records(part).items()}
    if not isinstance(schema, dict):
        return {}
    own = {schema["name"]: schema} if schema["type"] == "record" else {}
    parts = [f["type"] for f in schema.get("fields", ())] + [schema[k] for k in ("items", "values") if k in schema]
    return own | records(parts)


def encode(schema: Any, value: Any, named: dict[str, Any] | None = None) -> bytes:
    """One datum. Missing fields are null."""
    named = records(schema) if named is None else named
    if isinstance(schema, str) and schema in named:
        schema = named[schema]
    if isinstance(schema, list):  # nullable
        return _long(0) if value is None else _long(1) + encode(schema[1], value, named)
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "record":
        fields = value if isinstance(value, dict) else {}
        return b"".join(encode(f["type"], fields.get(f["name"]), named) for f in schema["fields"])
    if kind == "array":
        items = value if isinstance(value, list) else []
        return (_long(len(items)) + b"".join(encode(schema["items"], v, named) for v in items) if items else b"") + _long(0)
    if kind == "map":
        entries = value if isinstance(value, dict) else {}
        return (_long(len(entries)) + b"".join(encode("string", k, named) + encode(schema["values"], v, named) for k, v in entries.items()) if entries else b"") + _long(0)
    value = _lenient(kind, value)
    if kind in ("int", "long"):
        return _long(value)
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "boolean":
        return bytes([value])
    data = value.encode()
    return _long(len(data)) + data


def _read_long(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def decode(schema: Any, data: memoryview, at: int = 0, named: dict[str, Any] | None = None) -> tuple[Any, int]:
    """One datum and where it ends."""
    named = records(schema) if named is None else named
    if isinstance(schema, str) and schema in named:
        schema = named[schema]
    if isinstance(schema, list):
        branch, at = _read_long(data, at)
        return decode(schema[branch], data, at, named)
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "null":
        return None, at
    if kind == "record":
        out = {}
        for f in schema["fields"]:
            out[f["name"]], at = decode(f["type"], data, at, named)
        return out, at
    if kind in ("array", "map"):
        items: list[Any] = []
        while True:
            n, at = _read_long(data, at)
            if not n:
                return (dict(items) if kind == "map" else items), at
            for _ in range(n):
                key = None
                if kind == "map":
                    key, at = decode("string", data, at, named)
                item, at = decode(schema["values" if kind == "map" else "items"], data, at, named)
                items.append((key, item) if kind == "map" else item)
    if kind in ("int", "long"):
        return _read_long(data, at)
    if kind == "float":
        return struct.unpack_from("<f", data, at)[0], at + 4
    if kind == "double":
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == "boolean":
        return data[at] == 1, at + 1
    n, at = _read_long(data, at)
    return bytes(data[at : at + n]).decode(errors="replace"), at + n


def subject(strategy: str, topic: str, record: str) -> str:
    return {"topic": f"{topic}-value", "record": record, "topic_record": f"{topic}-{record}"}[strategy]


def subject_column(strategy: str, topic: Column, record: Column) -> Column:
    return {"topic": F.concat(topic, F.lit("-value")), "record": record, "topic_record": F.concat(topic, F.lit("-"), record)}[strategy]


class Registry:
    """Schema ids by subject and schema text; the interface of a schema service, kept in memory."""

    def __init__(self) -> None:
        self.ids: dict[tuple[str, str], int] = {}

    def register(self, subject: str, schema: Any) -> int:
        return self.ids.setdefault((subject, json.dumps(schema, sort_keys=True)), len(self.ids) + 1)


def encode_rows(df: DataFrame, column: str, schema: Any, schema_id: int, out: str = "avro") -> DataFrame:
    """Adds the wire form of a JSON text column; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, named = b"\x00" + struct.pack(">I", schema_id), records(schema)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield batch.append_column(out, pa.array([None if t is None else head + encode(schema, json.loads(t), named) for t in texts], pa.binary()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*(F.col(f"`{c}`") for c in df.columns)).mapInArrow(run, f"{kind}, `{out}` binary")


def decode_rows(df: DataFrame, column: str, schema: Any, out: str = "decoded") -> DataFrame:
    """Adds the JSON text of a column in wire form; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = records(schema)
        for batch in batches:
            frames = batch.column(batch.schema.get_field_index(column)).to_pylist()
            texts = [None if f is None else json.dumps(decode(schema, memoryview(f), 5, named)[0], ensure_ascii=False) for f in frames]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*(F.col(f"`{c}`") for c in df.columns)).mapInArrow(run, f"{kind}, `{out}` string")
