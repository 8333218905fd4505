"""Flat typed tables of change events in a Hive layout, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, paths
from ..functions.types import ColumnInfo, TypeOptions, spark_type
from .envelopes import native

#: The column store's and the lake's coercion for each Spark type.
COERCIONS = {
    T.IntegerType: coerce.int32, T.LongType: coerce.int64, T.FloatType: coerce.float32, T.DoubleType: coerce.float64, T.BooleanType: coerce.boolean, T.StringType: coerce.utf8,
    T.BinaryType: coerce.binary, T.DateType: coerce.date, T.TimestampType: coerce.timestamp, T.TimestampNTZType: coerce.timestamp,
}


def coercion(kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return coerce.decimal(kind.precision, kind.scale)
    if isinstance(kind, T.ArrayType):
        return coerce.array(coercion(kind.elementType))
    return coerce.string_map if isinstance(kind, T.MapType) else COERCIONS[type(kind)]


def meta_columns() -> list[Column]:
    s = F.col("source")
    return [
        F.col("op"), F.col("ts_ms"), F.col("event_id"), F.col("tenant_id"), s["connector"].alias("source_connector"), F.nullif(s["db"], F.lit("")).alias("source_db"), s["schema"].alias("source_schema"),
        s["table"].alias("source_table"), coerce.snapshot_flag(s).alias("source_snapshot"), coerce.position_text(s).alias("source_position"),
    ]


def typed(events: DataFrame, columns: list[ColumnInfo] | None, options: TypeOptions = TypeOptions()) -> tuple[DataFrame, DataFrame]:
    """(flat rows, bad events with an error column). Ten envelope columns, then before_x and after_x by column; without a declared schema
    the envelope columns alone. A row with one bad value is bad."""
    if columns is None:
        return events.select(*meta_columns()), events.limit(0).withColumns({"error": F.lit(None).cast("string"), "error_kind": F.lit("serialization")})
    out: dict[str, Column] = {}
    checks: list[Column] = []
    fields = {f"_{side}_{i}": paths.get(F.col(f"_{side}"), c.name) for i, c in enumerate(columns) for side in ("before", "after")}
    kinds = {f"{n}_kind": paths.kind_of(F.col(n)) for n in fields}
    for i, c in enumerate(columns):
        of = coercion(spark_type(c, options))
        for side in ("before", "after"):
            value, valid = of(F.col(f"_{side}_{i}"), F.col(f"_{side}_{i}_kind"))
            out[f"{side}_{c.name}"] = value.cast(spark_type(c, options))
            checks.append(F.when(~valid, F.lit(f"{side}.{c.name}: not {spark_type(c, options).simpleString()}")))
    parsed = paths.computed(events, **{f"_{s}": paths.image(s) for s in ("before", "after")})
    flagged = paths.computed(paths.computed(paths.computed(parsed, **fields), **kinds), _values=F.struct(*(v.alias(n) for n, v in out.items())), error=F.coalesce(*checks, F.lit(None).cast("string")))
    good = flagged.where("error is null").select(*meta_columns(), *(F.col(f"_values.`{n}`") for n in out))
    return good, flagged.where("error is not null").drop("_before", "_after", "_values", *fields, *kinds).withColumn("error_kind", F.lit("serialization"))


def partition_columns(df: DataFrame, table: str = "source_table", ts_ms: str = "ts_ms") -> DataFrame:
    """table, year, month, day (UTC, padded) for `table=T/year=Y/month=MM/day=DD`."""
    ts = F.timestamp_millis(F.col(ts_ms))
    return df.withColumns({"table": F.col(table), "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})


def write_parquet(flat: DataFrame, path: str, compression: str = "snappy", max_events: int = 1_000_000, mode: str = "append") -> None:
    """Hive-partitioned Parquet. Rows go to one task per partition value unless it is large, in which case adaptive execution splits it."""
    rows = partition_columns(flat).hint("rebalance", "table", "year", "month", "day")
    rows.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", max_events).partitionBy("table", "year", "month", "day").parquet(path)


def write_jsonl(events: DataFrame, path: str, compression: str = "gzip", mode: str = "append") -> None:
    """One native event a line. Snappy isn't a line format that readers share, so it becomes gzip."""
    codec = {"snappy": "gzip", "zstd": "zstd", "none": "none"}.get(compression, "gzip")
    rows = partition_columns(events.withColumn("value", native()).withColumn("source_table", F.col("source.table")))
    rows.select("value", "table", "year", "month", "day").write.mode(mode).option("compression", codec).partitionBy("table", "year", "month", "day").text(path)
