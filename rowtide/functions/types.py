"""Column types of the source databases, and what they become in Spark, Avro and column stores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TypeOptions:
    unsigned_bigint: str = "string"  #: string, long, decimal
    enum: str = "string"
    naive_timestamp: str = "string"  #: string, timestamp


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None
    unsigned: bool = False
    connector: str = "mysql"


#: Long type names and their short forms.
SHORT_NAMES = {
    "smallint": "int2", "integer": "int4", "int": "int4", "bigint": "int8", "real": "float4", "double precision": "float8", "boolean": "bool", "character varying": "varchar", "character": "bpchar",
    "char": "bpchar", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "timetz", "decimal": "numeric",
    "serial": "int4", "bigserial": "int8", "smallserial": "int2", "bit varying": "varbit",
}
_PLAIN = {
    "mysql": {
        "tinyint": T.IntegerType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "year": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(),
        "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(),
        "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
    },
    "postgresql": {
        "int2": T.IntegerType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(), "bool": T.BooleanType(), "bytea": T.BinaryType(), "date": T.DateType(),
        "timestamptz": T.TimestampType(), "hstore": T.MapType(T.StringType(), T.StringType()), "oid": T.LongType(),
    },
}


def base_name(data_type: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", data_type.lower()).replace("unsigned", "").replace("zerofill", "")).strip()


def pg_name(data_type: str) -> str:
    name = base_name(data_type)
    return SHORT_NAMES.get(name, name)


def numbers(data_type: str) -> tuple[int | None, int | None]:
    """Precision and scale from the type's text."""
    m = re.search(r"\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\)", data_type)
    return (int(m[1]), int(m[2]) if m[2] else None) if m else (None, None)


def decimal_type(precision: int | None, scale: int | None) -> T.DataType:
    """(38, 0) by default; what a decimal can't hold is text; the scale is kept within the precision."""
    p = 38 if precision is None else precision
    return T.DecimalType(p, max(0, min(scale or 0, p))) if 1 <= p <= 38 else T.StringType()


def spark_type(column: ColumnInfo, options: TypeOptions = TypeOptions()) -> T.DataType:
    text = column.data_type.lower()
    given = numbers(text)
    precision, scale = column.precision if column.precision is not None else given[0], column.scale if column.scale is not None else given[1]
    if column.connector == "postgresql":
        if text.endswith("[]") or text.startswith("_"):
            return T.ArrayType(spark_type(ColumnInfo(column.name, text.removesuffix("[]").removeprefix("_"), connector="postgresql"), options), True)
        name = pg_name(text)
        if name == "timestamp":
            return T.TimestampNTZType() if options.naive_timestamp == "timestamp" else T.StringType()
    else:
        name = base_name(text)
        unsigned = column.unsigned or "unsigned" in text
        if name in ("int", "integer"):
            return T.LongType() if unsigned else T.IntegerType()
        if name == "bigint":
            return {"string": T.StringType(), "long": T.LongType(), "decimal": T.DecimalType(20, 0)}[options.unsigned_bigint] if unsigned else T.LongType()
        if name == "datetime":
            return T.TimestampNTZType() if options.naive_timestamp == "timestamp" else T.StringType()
    if name in ("decimal", "numeric"):
        return decimal_type(precision, scale)
    if name == "bit":
        return T.BooleanType() if precision in (None, 1) else T.BinaryType()
    return _PLAIN[column.connector if column.connector == "postgresql" else "mysql"].get(name, T.StringType())


def struct_of(columns: list[ColumnInfo], options: TypeOptions = TypeOptions()) -> T.StructType:
    """Nullable fields with the source's type kept as metadata."""
    return T.StructType([T.StructField(c.name, spark_type(c, options), True, {"connector": c.connector, "source_type": c.data_type}) for c in columns])


def avro_type(kind: T.DataType) -> object:
    """Avro type of a Spark type, without the null branch."""
    simple = {
        T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.StringType: "string", T.BinaryType: "bytes",
        T.DateType: {"type": "int", "logicalType": "date"}, T.TimestampType: {"type": "long", "logicalType": "timestamp-micros"}, T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-micros"},
        T.DecimalType: "string",
    }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_type(kind.elementType)]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", avro_type(kind.valueType)]}
    return simple.get(type(kind), "string")


def column_store_type(column: ColumnInfo) -> str:
    """ClickHouse type; nullable ones are wrapped."""
    text = column.data_type.lower()
    name = pg_name(text) if column.connector == "postgresql" else base_name(text)
    unsigned = column.unsigned or "unsigned" in text
    p, s = numbers(text)
    p, s = column.precision if column.precision is not None else p, column.scale if column.scale is not None else s
    kind = {
        "tinyint": "UInt8", "smallint": "Int16", "int2": "Int16", "mediumint": "Int32", "int": "Int32", "integer": "Int32", "int4": "Int32", "int8": "Int64", "float": "Float64", "double": "Float64",
        "real": "Float64", "float4": "Float64", "float8": "Float64", "boolean": "UInt8", "bool": "UInt8", "date": "DateTime64(3)", "datetime": "DateTime64(3)", "timestamp": "DateTime64(3)", "timestamptz": "DateTime64(3)",
    }.get(name, "String")
    if name == "bigint":
        kind = "UInt64" if unsigned else "Int64"
    if name in ("decimal", "numeric"):
        kind = f"Decimal({p or 38}, {s or 0})"
    return f"Nullable({kind})" if column.nullable else kind


def create_table(table: str, columns: list[ColumnInfo], key: list[str], mode: str = "upsert") -> str:
    """DDL of the change-log (`append`) or current-state (`upsert`) table."""
    fields = [f"`{c.name}` {column_store_type(c)}" for c in columns] + ["`_op` String", "`_version` UInt64", "`_deleted` UInt8", "`_source_ts` DateTime64(3)"]
    order = key if mode == "upsert" else [*key, "_version"]
    engine = "ReplacingMergeTree(_version, _deleted)" if mode == "upsert" else "MergeTree"
    by = "(" + ", ".join(f"`{k}`" for k in order) + ")" if key else "tuple()"
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(fields)}) ENGINE = {engine} ORDER BY {by}"
