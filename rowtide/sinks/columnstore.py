"""Change-log and current-state tables of a column store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import coerce, paths
from ..functions.types import ColumnInfo, TypeOptions, spark_type
from .lake import coercion


def version() -> Column:
    """The log position where there is one, else the time; not negative."""
    return F.coalesce(coerce.lsn_number(F.col("source.lsn")), F.greatest(F.col("ts_ms"), F.lit(0)).cast("decimal(20,0)"))


def project(events: DataFrame, columns: list[ColumnInfo], options: TypeOptions = TypeOptions()) -> tuple[DataFrame, DataFrame]:
    """(rows with _op, _version, _deleted, _source_ts; bad events). Deletes give their old image. A null in a NOT NULL column is an error, and so
    is a value outside its type; nothing wraps around."""
    row = paths.image(F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")))
    out: dict[str, Column] = {}
    checks: list[Column] = []
    fields = {f"_field_{i}": paths.get(F.col("_row"), c.name) for i, c in enumerate(columns)}
    kinds = {f"{n}_kind": paths.kind_of(F.col(n)) for n in fields}
    for i, c in enumerate(columns):
        value, valid = coercion(spark_type(c, options))(F.col(f"_field_{i}"), F.col(f"_field_{i}_kind"))
        out[c.name] = value.cast(spark_type(c, options))
        checks.append(F.when(~valid, F.lit(f"{c.name}: wrong type")))
        if not c.nullable:
            checks.append(F.when(value.isNull(), F.lit(f"{c.name}: null")))
    flagged = paths.computed(paths.computed(paths.computed(paths.computed(events, _row=row), **fields), **kinds), _values=F.struct(*(v.alias(n) for n, v in out.items())), error=F.coalesce(*checks, F.lit(None).cast("string")))
    extra = [F.col("op").alias("_op"), version().alias("_version"), (F.col("op") == "d").cast("int").alias("_deleted"), F.timestamp_millis("ts_ms").alias("_source_ts")]
    return flagged.where("error is null").select(*(F.col(f"_values.`{n}`") for n in out), *extra), flagged.where("error is not null").drop("_row", "_values", *fields, *kinds).withColumn("error_kind", F.lit("serialization"))


def current_state(log: DataFrame, key: list[str], order: tuple[str, ...] = ("_version",)) -> DataFrame:
    """The latest row of each key, without deleted ones. max_by aggregates before the shuffle, so a hot key's history isn't moved; for
    equal versions the later in `order`'s further columns wins, then the deleted one."""
    others = [c for c in log.columns if c not in key]
    latest = log.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order, "_deleted")).alias("row"))
    return latest.where("row._deleted = 0").select(*(F.col(c) if c in key else F.col(f"row.{c}") for c in log.columns))


def changes_in_order(log: DataFrame, key: list[str]) -> DataFrame:
    """The log with each row's number within its key."""
    return log.withColumn("change_no", F.row_number().over(W.partitionBy(*key).orderBy("_version", "_deleted")))


def dedup_token(pipeline: str, sink: str, batch: DataFrame) -> str:
    """The same for a retried batch: first version and number of rows."""
    first, n = batch.agg(F.min("_version"), F.count(F.lit(1))).first()
    return f"{pipeline}:{sink}:{first}:{n}"
