"""The change-event envelope and helpers to build rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """Nullable fields from `name kind` pairs."""
    return T.StructType([T.StructField(name, nested.get(kind) or _KINDS[kind]) for name, kind in (pair.split() for pair in text.split(","))])


SOURCE = _struct(
    "version string, connector string, name string, ts_ms long, db string, schema string, table string, snapshot string, "
    "server_id long, gtid string, file string, pos long, row int, lsn string, txId long, xmin long, sequence string"
)
TRANSACTION = _struct("id string, total_order long, data_collection_order long")
ROUTING = _struct("topic string, key string, headers map, raw_payload boolean")

#: Row images are JSON text: a table's columns change over time, the envelope doesn't. `routing` and the columns after it never leave the engine.
EVENT_SCHEMA = _struct(
    "before string, after string, source source, op string, ts_ms long, transaction transaction, event_id string, tenant_id string, schema_version string, schema_sequence long, "
    "ddl string, trace_id string, tags strings, synthetic string, tx_end boolean, routing routing, size_bytes long, received_at_ms long",
    source=SOURCE, transaction=TRANSACTION, routing=ROUTING,
)
INTERNAL = ("routing", "size_bytes", "received_at_ms")

#: Operation codes: create, update, delete, snapshot read, truncate.
OPS = ("c", "u", "d", "r", "t")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir), set as Spark's checkpoint folder, too; None if there is none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def is_valid_op(op: Column) -> Column:
    return F.coalesce(op.isin(*OPS), F.lit(False))


def full_table(source: Column) -> Column:
    """`schema.table` if there is a schema, else `db.table`."""
    return F.concat_ws(".", F.coalesce(source["schema"], source["db"]), source["table"])


def source_struct(**fields: Column) -> Column:
    """A source struct with the given fields; the others are null."""
    return F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE))


def events(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the envelope from expressions over df; columns that aren't given are null (tx_end: true, ids: derived)."""
    if "event_id" not in columns:
        columns["event_id"] = event_id(columns)
    columns.setdefault("tx_end", F.lit(True))
    out = df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA))
    if "size_bytes" in columns:
        return out
    return out.withColumn("size_bytes", (F.coalesce(F.octet_length("before"), F.lit(0)) + F.coalesce(F.octet_length("after"), F.lit(0))).cast("bigint"))


def event_id(columns: dict[str, Column]) -> Column:
    """An id that a retry gives again: 48 bits of the time, then a hash of position and images."""
    ts = F.coalesce(columns.get("ts_ms", F.lit(0)).cast("bigint"), F.lit(0))
    parts = [F.to_json(columns["source"])] if "source" in columns else []
    parts += [columns[c] for c in ("op", "before", "after") if c in columns]
    return F.concat(F.lpad(F.lower(F.hex(ts)), 12, "0"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)), 256), 1, 20))


def idempotency_key() -> Column:
    """`{tenant or _}|{db}.{table}|{tx id or empty}|{event id or _}`"""
    return F.concat(
        F.coalesce("tenant_id", F.lit("_")), F.lit("|"), F.coalesce("source.db", F.lit("")), F.lit("."), F.coalesce("source.table", F.lit("")),
        F.lit("|"), F.coalesce("transaction.id", F.lit("")), F.lit("|"), F.coalesce("event_id", F.lit("_")),
    )


def dedup(df: DataFrame, watermark: str | None = None) -> DataFrame:
    """One event per idempotency key. Streaming input needs a watermark on a timestamp column, which bounds the state."""
    keyed = df.withColumn("_key", idempotency_key())
    out = keyed.dropDuplicatesWithinWatermark(["_key"]) if watermark else keyed.dropDuplicates(["_key"])
    return out.drop("_key")
