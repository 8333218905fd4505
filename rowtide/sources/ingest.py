"""Change events from tables, logs and logical messages.

No reader of a database's log comes with Spark, so logs arrive as files of decoded rows (JSON or Parquet), in batch or as a stream; what a
log's reader has to do with them is here as projections.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..schema import EVENT_SCHEMA, events, source_struct

DDL_TABLE = "_ddl"


# -- snapshots ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SnapshotOptions:
    mode: str | None = None  #: initial, always, never; without a snapshot block nothing is read
    chunk_size: int = 10_000
    parallel: int = 8

    def wanted(self, finished: bool) -> bool:
        return {"initial": not finished, "always": True, "never": False, None: False}[self.mode]


def snapshot(rows: DataFrame, db: str, table: str, connector: str = "mysql", ts_ms: Column | int = 0, schema: str | None = None, position: dict[str, Column] | None = None) -> DataFrame:
    """Every row as a snapshot read (op r)."""
    source = source_struct(connector=F.lit(connector), name=F.lit(connector), db=F.lit(db), table=F.lit(table), schema=F.lit(schema), snapshot=F.lit("true"), **(position or {}))
    image = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return events(rows, after=image, op=F.lit("r"), ts_ms=F.lit(ts_ms) if isinstance(ts_ms, int) else ts_ms, source=source)


def chunk_id(key: str, low: int, size: int = 10_000) -> Column:
    return F.floor((F.col(key) - low) / size)


def chunk_ranges(rows: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """Chunks of an integer key: chunk, first and last key, rows."""
    low = rows.agg(F.min(key)).first()[0] or 0
    return rows.groupBy(chunk_id(key, low, size).alias("chunk")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_rows"))


def jdbc_chunks(spark: SparkSession, url: str, table: str, key: str | None, low: int | None, high: int | None, size: int = 10_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC: by ranges of an integer key, or as one scan where there is none."""
    if key is None or low is None or high is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    parts = max(1, -(-(high - low + 1) // size))
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=properties or {})


def page_predicates(pages: int, chunk_rows: int = 10_000) -> list[str]:
    """Predicates by physical page ranges, for tables without a usable key."""
    step = max(chunk_rows // 100, 1)
    return [f"ctid >= '({a},0)'::tid AND ctid < '({a + step},0)'::tid" for a in range(0, max(pages, 1), step)]


#: Schemas of the server itself, which a pattern for any schema leaves out.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")


def _like(pattern: str, value: Column, any_value: Column) -> Column:
    if pattern in ("*", "%"):
        return any_value
    return value.like(pattern) if "%" in pattern or "_" in pattern else value == pattern


def catalog_tables(catalog: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The base tables of a server's catalog (table_schema, table_name, table_type) that a pattern names, once each.

    `schema.table` or `table`; `%` and `_` anywhere are wildcards as in LIKE, and `*` alone is any. Unlike filters' patterns, as the server evaluates these.
    """
    wanted = F.lit(False)
    for p in patterns:
        left, dot, right = p.partition(".")
        schema, name = (left, right) if dot else ("%", left)
        wanted = wanted | (_like(schema, F.col("table_schema"), ~F.col("table_schema").isin(*SYSTEM_SCHEMAS)) & _like(name, F.col("table_name"), F.lit(True)))
    return catalog.where((F.col("table_type") == "BASE TABLE") & wanted).select("table_schema", "table_name").distinct()


# -- logs ---------------------------------------------------------------------------------------------------------------


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).format(fmt).load(path)


def read_event_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def row_changes(log: DataFrame, connector: str) -> DataFrame:
    """Decoded log rows (kind: insert, update, delete; db, table, schema, before, after, ts_ms, position columns, tx_id) as events."""
    fields = [f for f in ("schema", "server_id", "gtid", "file", "pos", "row", "lsn", "txId", "xmin", "sequence") if f in log.columns]
    source = source_struct(connector=F.lit(connector), name=F.lit(connector), db=F.col("db"), table=F.col("table"), ts_ms=F.col("ts_ms"), **{f: F.col(f"`{f}`") for f in fields})
    op = F.when(F.col("kind") == "insert", "c").when(F.col("kind") == "update", "u").when(F.col("kind") == "delete", "d")
    tx = F.when(F.col("tx_id").isNotNull(), F.struct(F.col("tx_id").alias("id"), F.lit(None).cast("long").alias("total_order"), F.lit(None).cast("long").alias("data_collection_order"))) if "tx_id" in log.columns else F.lit(None)
    known = log.where(op.isNotNull())
    return events(known, before=F.when(op != "c", F.col("before")), after=F.when(op != "d", F.col("after")), op=op, ts_ms=F.col("ts_ms"), source=source, transaction=tx)


_DDL = r"(?i)^\s*(ALTER|CREATE|DROP|TRUNCATE|RENAME)\b"
_TABLE = r"(?i)^\s*(?:ALTER|CREATE|DROP|TRUNCATE|RENAME)\s+(?:TEMPORARY\s+)?(?:TABLE\s+)?(?:IF\s+(?:NOT\s+)?EXISTS\s+)?((?:`[^`]+`|[\w$]+)(?:\s*\.\s*(?:`[^`]+`|[\w$]+))?)"


def is_ddl(sql: Column) -> Column:
    return F.coalesce(sql.rlike(_DDL), F.lit(False))


def ddl_table(sql: Column) -> Column:
    """Table name of a schema change, without quotes and database; null if there is none."""
    name = F.regexp_replace(F.regexp_extract(sql, _TABLE, 1), "`", "")
    return F.nullif(F.trim(F.element_at(F.split(name, r"\."), -1)), F.lit(""))


def ddl_events(queries: DataFrame, connector: str = "mysql") -> DataFrame:
    """Schema changes among logged queries (sql, db, ts_ms) as events of the table `_ddl`."""
    source = source_struct(connector=F.lit(connector), name=F.lit(connector), db=F.col("db"), table=F.lit(DDL_TABLE))
    body = F.to_json(F.struct("sql", F.col("db").alias("database")))
    return events(queries.where(is_ddl(F.col("sql"))), after=body, op=F.lit("r"), ts_ms=F.col("ts_ms"), source=source, ddl=F.col("sql"))


def truncate_events(log: DataFrame) -> DataFrame:
    """One event per relation of a TRUNCATE (relations: array of struct(schema, table); cascade, restart_identity, db, ts_ms)."""
    each = log.select("*", F.explode("relations").alias("_rel"))
    source = source_struct(connector=F.lit("postgresql"), name=F.lit("postgresql"), db=F.col("db"), schema=F.col("_rel.schema"), table=F.col("_rel.table"))
    body = F.to_json(F.struct(F.lit("TRUNCATE").alias("sql"), "cascade", "restart_identity"))
    return events(each, after=body, op=F.lit("r"), ts_ms=F.col("ts_ms"), source=source, ddl=F.lit("TRUNCATE"))


def message_events(log: DataFrame, outbox_prefixes: Sequence[str] = ()) -> DataFrame:
    """Logical messages (prefix, content, db, lsn, ts_ms); content that isn't JSON is dropped."""
    schema = F.when(F.col("prefix").isin(*outbox_prefixes) if outbox_prefixes else F.lit(False), "__outbox").otherwise("__wal_message")
    source = source_struct(connector=F.lit("postgresql"), name=F.lit("postgresql"), db=F.col("db"), schema=schema, table=F.col("prefix"), lsn=F.col("lsn"))
    good = log.where(paths.image("content").isNotNull())
    return events(good, after=F.col("content"), op=F.lit("c"), ts_ms=F.col("ts_ms"), source=source)


# -- values -------------------------------------------------------------------------------------------------------------

#: Type ids of PostgreSQL.
BOOL, BYTEA, JSON_OIDS, INT_OIDS, FLOAT_OIDS, NUMERIC = 16, 17, (114, 3802), (20, 21, 23, 26), (700, 701), 1700
#: Words for truth values, in any case.
TRUE_WORDS, FALSE_WORDS = ("t", "true", "1", "yes", "on"), ("f", "false", "0", "no", "off")
_JSON_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def pg_json(oid: Column, text: Column) -> Column:
    """JSON text of a value's text form by its type; an unchanged large value is `{"_unchanged": true}`.

    What isn't a value of its type stays text. Floats that JSON has no number for are null.
    """
    quoted = F.to_json(F.struct(text.alias("v")))
    as_string = F.substring(quoted, 6, F.length(quoted) - 6)
    hexed = F.unhex(F.substring(text, 3, 1 << 30))
    number = text.try_cast("double")
    return (
        F.when(text.isNull(), "null")
        .when(oid == BOOL, F.when(F.lower(text).isin(*TRUE_WORDS), "true").when(F.lower(text).isin(*FALSE_WORDS), "false").otherwise(as_string))
        .when(oid.isin(*INT_OIDS) & text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(), text.try_cast("bigint").cast("string"))
        .when(oid.isin(*FLOAT_OIDS) & text.rlike(_JSON_NUMBER), text)
        .when(oid.isin(*FLOAT_OIDS) & text.rlike(r"(?i)^[+-]?(nan|inf|infinity)$"), "null")
        .when(oid.isin(*FLOAT_OIDS) & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.cast("string"))
        .when(oid.isin(*JSON_OIDS) & paths.image(text).isNotNull(), text)
        .when((oid == BYTEA) & text.rlike(r"^\\x([0-9a-fA-F]{2})*$"), F.concat(F.lit('{"_base64":"'), F.base64(hexed), F.lit('"}')))
        .otherwise(as_string)
    )


UNCHANGED = '{"_unchanged":true}'


def pg_array(text: str | None) -> list[object] | None:
    """Items of an array literal: quotes and escapes, NULL, t/f, integers, floats, strings. A nested brace is text."""
    if text is None or len(text) < 2 or text[0] != "{" or text[-1] != "}":
        return None
    items: list[object] = []
    word, quoted, inside, k, body = "", False, False, 0, text[1:-1]

    def end() -> None:
        items.append(word if quoted else _item(word.strip()))

    while k < len(body):
        c = body[k]
        if inside:
            if c == "\\" and k + 1 < len(body):
                k += 1
                word += body[k]
            elif c == '"':
                inside = False
            else:
                word += c
        elif c == '"':
            inside = quoted = True
        elif c == ",":
            end()
            word, quoted = "", False
        else:
            word += c
        k += 1
    if body:
        end()
    return items


def _item(word: str) -> object:
    if word.upper() == "NULL":
        return None
    if word in ("t", "f"):
        return word == "t"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


@F.pandas_udf(T.StringType())
def pg_array_json(texts: pd.Series) -> pd.Series:
    """Array literals as JSON arrays; null for what isn't one."""
    parsed = texts.map(pg_array, na_action="ignore")
    return parsed.map(lambda x: json.dumps(x) if isinstance(x, list) else None)


def mysql_json(value: Column, binary: bool = False) -> Column:
    """A binary value as `{"_base64": ...}`; text as it is, if it is text."""
    wrapped = F.concat(F.lit('{"_base64":"'), F.base64(value), F.lit('"}'))
    if binary:
        return F.when(value.isNotNull(), wrapped)
    quoted = F.to_json(F.struct(F.decode(value, "UTF-8").alias("v")))
    return F.when(F.is_valid_utf8(value), F.substring(quoted, 6, F.length(quoted) - 6)).otherwise(wrapped)


# -- servers ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Identity:
    server: str
    timeline: str = ""

    def compare(self, stored: Identity | None) -> str:
        return "first_seen" if stored is None else "same" if stored == self else "changed"


@dataclass
class Reconciliation:
    """What a failover found, once per pair of servers."""

    done: dict[tuple[Identity, Identity], list[dict]] = field(default_factory=dict)

    def run(self, was: Identity, now: Identity, differences: DataFrame) -> list[dict]:
        if (was, now) not in self.done:
            self.done[was, now] = [r.asDict() for r in differences.collect()]
        return self.done[was, now]
