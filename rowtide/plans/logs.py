"""Registered queries over decoded logs, value rules, sinks that write, dead letters and streams, with the SQL that each is checked against."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, paths
from ..functions.types import ColumnInfo
from ..operators import batching, dlq, progress, sensing
from ..operators.filter import EventFilter
from ..operators.flatten import FlattenOptions, flatten
from ..operators.outbox import capture
from ..schema import EVENT_SCHEMA, events, shared_folder, source_struct
from ..sinks import avro, envelopes, lake, network
from ..sources import ingest
from ..streaming.pipeline import Pipeline, SharedProgress, Sink
from ..streaming.sensor import SensorOptions, sense
from .catalog import ORDERS, T0, _user_keys, click_events, order_events, query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def at(column: str, path: str, kind: str) -> Column:
    return paths.get(paths.image(column), path, kind)


# -- logs ---------------------------------------------------------------------------------------------------------------


def _decoded_log(spark: SparkSession, d: str) -> DataFrame:
    """A decoded row log: by customer an insert, an update, a delete, or a heartbeat, which is no change."""
    k = F.col("c_custkey")
    image = lambda bal: F.to_json(F.struct("c_custkey", bal.alias("c_acctbal")))
    kind = F.element_at(F.array(*map(F.lit, ("insert", "update", "delete", "heartbeat"))), (k % 4 + 1).cast("int"))
    tx = F.concat(F.lit("tx-"), k % 10)
    return table(spark, d, "customer").select(k, kind.alias("kind"), F.lit("shop").alias("db"), F.lit("customer").alias("table"), image(F.col("c_acctbal") - 1).alias("before"), image(F.col("c_acctbal")).alias("after"), (F.lit(T0) + k).alias("ts_ms"), tx.alias("tx_id"))


_KIND = "['c', 'u', 'd'][c_custkey % 4 + 1] AS op, c_custkey % 4 <> 0 AS has_before, c_custkey % 4 <> 2 AS has_after, CASE WHEN c_custkey % 4 = 2 THEN c_acctbal - 1 ELSE c_acctbal END AS balance"


def _changed(e: DataFrame, *more: Column) -> DataFrame:
    either = F.coalesce("after", "before")
    value = lambda c, t: paths.get(paths.image(either), c, t)
    return e.select(value("c_custkey", "bigint").alias("c_custkey"), "op", F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"), value("c_acctbal", "double").alias("balance"), *more)


@query(f"SELECT c_custkey, {_KIND}, 'binlog.000007' AS file, c_custkey * 10 AS pos, 'tx-' || (c_custkey % 10) AS tx FROM customer WHERE c_custkey % 4 <> 3")
def mysql_row_events(spark: SparkSession, d: str) -> DataFrame:
    log = _decoded_log(spark, d).withColumns({"file": F.lit("binlog.000007"), "pos": F.col("c_custkey") * 10})
    return _changed(ingest.row_changes(log, "mysql"), F.col("source.file").alias("file"), F.col("source.pos").alias("pos"), F.col("transaction.id").alias("tx"))


@query(f"SELECT c_custkey, {_KIND}, 'public' AS schema, 4294967296 + c_custkey AS position, c_custkey + 500 AS tx_id FROM customer WHERE c_custkey % 4 <> 3")
def pg_row_events(spark: SparkSession, d: str) -> DataFrame:
    log = _decoded_log(spark, d).withColumns({"schema": F.lit("public"), "lsn": F.concat(F.lit("1/"), F.hex("c_custkey")), "txId": F.col("c_custkey") + 500})
    return _changed(ingest.row_changes(log, "postgresql"), F.col("source.schema").alias("schema"), coerce.lsn_number(F.col("source.lsn")).cast("bigint").alias("position"), F.col("source.txId").alias("tx_id"))


@query("SELECT 'ALTER TABLE t' || s_suppkey || ' ADD x INT' AS sql, 'shop' AS database, '_ddl' AS tbl, 'r' AS op, true AS ddl_is_sql FROM supplier WHERE s_suppkey % 3 <> 0")
def ddl_event_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    log = table(spark, d, "supplier").select(F.when(k % 3 == 0, "COMMIT").otherwise(F.concat(F.lit("ALTER TABLE t"), k, F.lit(" ADD x INT"))).alias("sql"), F.lit("shop").alias("db"), (F.lit(T0) + k).alias("ts_ms"))
    e = ingest.ddl_events(log)
    return e.select(at("after", "sql", "string").alias("sql"), at("after", "database", "string").alias("database"), F.col("source.table").alias("tbl"), "op", (F.col("ddl") == at("after", "sql", "string")).alias("ddl_is_sql"))


@query("SELECT 'r' || n_regionkey AS tbl, n_nationkey % 2 = 0 AS cascade, count(*) AS n FROM nation GROUP BY 1, 2 UNION ALL SELECT 'extra', true, count(*) FROM nation WHERE n_nationkey % 2 = 0")
def pg_truncate_events(spark: SparkSession, d: str) -> DataFrame:
    relation = lambda name: F.struct(F.lit("public").alias("schema"), name.alias("table"))
    own, even = relation(F.concat(F.lit("r"), F.col("n_regionkey"))), F.col("n_nationkey") % 2 == 0
    log = table(spark, d, "nation").select(F.when(even, F.array(own, relation(F.lit("extra")))).otherwise(F.array(own)).alias("relations"), even.alias("cascade"), F.lit(False).alias("restart_identity"), F.lit("shop").alias("db"), F.lit(T0).alias("ts_ms"))
    e = ingest.truncate_events(log)
    return e.groupBy(F.col("source.table").alias("tbl"), at("after", "cascade", "boolean").alias("cascade")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 0) THEN '__outbox' WHEN event_id % 3 = 1 THEN '__wal_message' END AS schema FROM events")
def outbox_capture(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    name = F.when(k % 3 == 0, "outbox").when(k % 3 == 1, F.when(k % 2 == 0, "p").otherwise("q")).otherwise("events")
    source = source_struct(connector=F.lit("mysql"), db=F.lit("app"), schema=F.when(k % 3 == 1, "__wal_message"), table=name)
    e = capture(click_events(spark, d, source=source), ("app.outbox",), ("p",))
    return e.select(k.cast("bigint").alias("event_id"), F.col("source.schema").alias("schema"))


@query("SELECT 'ctid >= ''(' || a || ',0)''::tid AND ctid < ''(' || (a + 100) || ',0)''::tid' AS predicate FROM (SELECT unnest(range(0, CAST(greatest(count(*), 1) AS BIGINT), 100)) AS a FROM orders)")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A table with as many pages as there are orders."""
    made = ingest.page_predicates(table(spark, d, "orders").count(), 10_000)
    return spark.createDataFrame([(p,) for p in made], "predicate string")


@query(
    "SELECT 's' || n_regionkey AS table_schema, n_name AS table_name FROM nation WHERE (n_regionkey = 1 AND n_name LIKE 'A%') OR n_name = 'CHINA' OR n_name LIKE 'I%_A' OR (n_regionkey = 3 AND n_name LIKE '_U%')"
)
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """Patterns over a catalog with a view and a system table of each name besides the table."""
    name = F.col("n_name").alias("table_name")
    rows = table(spark, d, "nation")
    base = rows.select(F.concat(F.lit("s"), F.col("n_regionkey")).alias("table_schema"), name, F.lit("BASE TABLE").alias("table_type"))
    other = base.withColumn("table_type", F.lit("VIEW")).union(rows.select(F.lit("sys").alias("table_schema"), name, F.lit("BASE TABLE").alias("table_type")))
    return ingest.catalog_tables(base.union(other), ("s1.A%", "CHINA", "%.I%_A", "s3._U%"))


@query("SELECT s_suppkey, s_nationkey % 5 = 0 OR s_suppkey % 10 < 5 AS reachable FROM supplier")
def retention_guard(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of sources of which some list the newer half of their log files, and some list none."""
    k = F.col("s_suppkey") % 10
    file = lambda n: F.concat(F.lit("binlog.00000"), n)
    points = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source_id"), file(k).alias("file"))
    logs = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("source_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).select("source_id", file(F.col("n")).alias("file"))
    return progress.reachable(points, logs).select("s_suppkey", "reachable")


# -- values -------------------------------------------------------------------------------------------------------------

_WORDS = ("TRUE", "off", "maybe", "T", "No")


@query(
    """SELECT s_suppkey, ['true', 'false', '"maybe"', 'true', 'false'][s_suppkey % 5 + 1] AS as_bool, CAST(s_suppkey AS VARCHAR) AS as_int, CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE s_suppkey || '.5' END AS as_float,
    CASE s_suppkey % 3 WHEN 0 THEN '{"_base64":"aGk="}' WHEN 1 THEN '"hello"' ELSE '"\\\\x6"' END AS as_bytes, CASE WHEN s_suppkey % 2 = 0 THEN '{"a":1}' ELSE '"{a"' END AS as_json FROM supplier"""
)
def pg_values_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    v = lambda oid, text: ingest.pg_json(F.lit(oid), text)
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 5 + 1).cast("int"))
    number = F.when(k % 2 == 0, "NaN").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    raw = F.when(k % 3 == 0, r"\x6869").when(k % 3 == 1, "hello").otherwise(r"\x6")
    text = F.when(k % 2 == 0, '{"a":1}').otherwise("{a")
    return table(spark, d, "supplier").select(k, v(16, word).alias("as_bool"), v(20, F.concat(F.lit("+"), k)).alias("as_int"), v(701, number).alias("as_float"), v(17, raw).alias("as_bytes"), v(3802, text).alias("as_json"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, o_orderkey % 4 <> 3 AS flag_ok, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 5 <> 0 AS day_ok, "
    "epoch_ms(date_trunc('second', o_orderdate)) AS at_ms, CASE WHEN o_orderkey % 3 <> 0 THEN 2 * o_orderkey + 1 END AS items, o_orderkey % 3 <> 0 AS items_ok, CAST(o_orderkey AS VARCHAR) AS in_map, 't' AS in_map_text FROM orders"
)
def value_coercions(spark: SparkSession, d: str) -> DataFrame:
    """Truth values, dates, times, lists and maps from JSON, with what isn't valid."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    flag = F.element_at(F.array(*map(F.lit, ("true", "0", "1", '"yes"'))), (k % 4 + 1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    day = quoted(F.when(k % 5 != 0, F.date_format(t, "yyyy-MM-dd")).otherwise("2024-13-01"))
    when = F.when(k % 2 == 0, quoted(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise((F.unix_seconds(t) * 1000).cast("string"))
    items = F.concat(F.lit("["), k, F.when(k % 3 == 0, ',"x"').otherwise(F.concat(F.lit(",null,"), k + 1)), F.lit("]"))
    body = F.concat(F.lit('{"flag":'), flag, F.lit(',"day":'), day, F.lit(',"at":'), when, F.lit(',"items":'), items, F.lit(',"map":{"a":'), k, F.lit(',"b":"t"}}'))
    rows = table(spark, d, "orders").select(k, paths.image(body).alias("v"))
    v = lambda c: paths.get(F.col("v"), c)
    flag_, day_, at_, items_, map_ = coerce.boolean(v("flag")), coerce.date(v("day")), coerce.timestamp(v("at")), coerce.array(coerce.int64)(v("items")), coerce.string_map(v("map"))
    total = F.aggregate(F.filter(items_[0], lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        k, flag_[0].alias("flag"), flag_[1].alias("flag_ok"), day_[0].cast("string").alias("day"), day_[1].alias("day_ok"), F.unix_millis(at_[0].cast("timestamp")).alias("at_ms"), total.alias("items"), items_[1].alias("items_ok"),
        map_[0]["a"].alias("in_map"), map_[0]["b"].alias("in_map_text"),
    )


@query("SELECT n_nationkey, 4 AS kept, 2 AS last_wins, 2 AS dropped, 1 AS first_wins, 4 AS nulled, true AS is_null FROM nation")
def flatten_policies(spark: SparkSession, d: str) -> DataFrame:
    """Empty objects and lists, and two values for one key, under each policy."""
    body = F.concat(F.lit('{"a":{},"b":[],"c":{"d":1},"c__d":2,"k":'), F.col("n_nationkey"), F.lit("}"))
    e = events(table(spark, d, "nation"), after=body, op=F.lit("c"), ts_ms=F.lit(T0), source=source_struct(db=F.lit("d"), table=F.lit("t")))
    keys, cd = F.size(F.json_object_keys("after")), at("after", "c__d", "int")
    key = at("after", "k", "int").alias("n_nationkey")
    kept = flatten(e).select(key, keys.alias("kept"), cd.alias("last_wins"))
    dropped = flatten(e, FlattenOptions(empty_object="drop", empty_list="drop", collision="first")).select(key, keys.alias("dropped"), cd.alias("first_wins"))
    nulled = flatten(e, FlattenOptions(empty_object="null", empty_list="null")).select(key, keys.alias("nulled"), F.is_variant_null(at("after", "a", "variant")).alias("is_null"))
    return kept.join(dropped, "n_nationkey").join(nulled, "n_nationkey")


# -- envelopes and sinks ------------------------------------------------------------------------------------------------


@query("SELECT event_id, 'c' AS op, 'app' AS db, value, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, false AS leaks FROM events")
def native_envelope(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d).select(envelopes.native().alias("j"))
    value = lambda p, t: at("j", p, t)
    inner = F.arrays_overlap(F.json_object_keys("j"), F.array(*map(F.lit, ("routing", "size_bytes", "received_at_ms"))))
    return e.select(value("event_id", "string").cast("bigint").alias("event_id"), value("op", "string").alias("op"), value("source.db", "string").alias("db"), value("after.value", "double").alias("value"), value("ts_ms", "bigint").alias("ts_ms"), inner.alias("leaks"))


@query("SELECT 'r' AS op, 'mysql' AS source_connector, 'orders' AS source_table, 10 AS n_columns, count(*) AS n FROM orders")
def envelope_only(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = lake.typed(order_events(spark, d), None)
    return rows.groupBy("op", "source_connector", "source_table").agg(F.lit(len(rows.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1, 2")
def lake_files(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows written as Parquet in the Hive layout, and read again."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    e = ingest.snapshot(rows, "shop", "orders", ts_ms=F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    path = folder(spark, "lake")
    lake.write_parquet(lake.typed(e, ORDERS)[0], path)
    parts = spark.read.option("recursiveFileLookup", "true").parquet(path).select("after_o_orderkey", F.input_file_name().alias("f"))
    part = lambda name: F.regexp_extract("f", rf"table=orders/.*{name}=(\d+)", 1)
    return parts.groupBy(part("year").alias("year"), part("month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("after_o_orderkey").alias("least"))


@query("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1")
def json_lines_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "lines")
    lake.write_jsonl(click_events(spark, d), path)
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.groupBy(at("value", "after.event_type", "string").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(at("value", "event_id", "string").cast("bigint")).alias("ids"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def avro_schema_from_json(spark: SparkSession, d: str) -> DataFrame:
    """The schema comes from a value; all rows are written with it and read again."""
    schema = avro.from_json_value("Props", {"event_id": 1, "props": {"k": 1}})
    rows = table(spark, d, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"props":'), "props", F.lit("}")).alias("j"))
    back = avro.decode_rows(avro.encode_rows(rows, "j", schema, 7), "avro", schema)
    return back.select(at("decoded", "event_id", "bigint").alias("event_id"), at("decoded", "props.k", "bigint").alias("k"))


@query("SELECT o_orderkey, o_totalprice, 'shop' AS db, 'r' AS op, true AS no_before FROM orders")
def avro_envelope(spark: SparkSession, d: str) -> DataFrame:
    schema = avro.envelope_schema("Envelope", ORDERS)
    rows = order_events(spark, d).select(envelopes.native().alias("j"))
    back = avro.decode_rows(avro.encode_rows(rows, "j", schema, 9), "avro", schema)
    v = lambda p, t: at("decoded", p, t)
    return back.select(v("after.o_orderkey", "bigint").alias("o_orderkey"), v("after.o_totalprice", "double").alias("o_totalprice"), v("source.db", "string").alias("db"), v("op", "string").alias("op"), F.is_variant_null(v("before", "variant")).alias("no_before"))


@query("SELECT o_orderkey, 0 AS bad_long, 1.5 AS from_text, true AS from_one, '{\"x\":' || o_orderkey || '}' AS from_object FROM orders")
def avro_lenient_values(spark: SparkSession, d: str) -> DataFrame:
    """JSON values of another type than the schema's."""
    schema = avro.from_columns("Row", [ColumnInfo("k", "bigint"), ColumnInfo("l", "bigint"), ColumnInfo("p", "double"), ColumnInfo("b", "boolean"), ColumnInfo("s", "varchar(9)")])
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit('{"k":'), k, F.lit(',"l":"abc","p":"1.5","b":1,"s":{"x":'), k, F.lit("}}")).alias("j"))
    back = avro.decode_rows(avro.encode_rows(rows, "j", schema, 1), "avro", schema)
    v = lambda p, t: at("decoded", p, t)
    return back.select(v("k", "bigint").alias("o_orderkey"), v("l", "int").alias("bad_long"), v("p", "double").alias("from_text"), v("b", "boolean").alias("from_one"), v("s", "string").alias("from_object"))


@query("SELECT n_name, n_name || '-value' AS by_topic, 'R' || n_regionkey AS by_record, n_name || '-R' || n_regionkey AS by_both FROM nation")
def avro_subjects(spark: SparkSession, d: str) -> DataFrame:
    record = F.concat(F.lit("R"), F.col("n_regionkey"))
    made = {n: avro.subject_column(s, F.col("n_name"), record) for n, s in (("by_topic", "topic"), ("by_record", "record"), ("by_both", "topic_record"))}
    return table(spark, d, "nation").select("n_name", *(c.alias(n) for n, c in made.items()))


@query("SELECT n_name, NOT contains(n_name, ' ') AS is_subject FROM nation")
def subject_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", network.subject_column("n_name").alias("is_subject"))


class Refusing:
    """Takes every message but those whose event's number is divisible by 7."""

    def send(self, messages: list[dict]) -> None:
        if any(int(m["event_id"]) % 7 == 0 for m in messages):
            raise network.DeliveryError("permanent", "refused")

    def close(self) -> None:
        pass


@query("SELECT event_id, 'permanent: refused' AS error FROM events WHERE event_id % 7 = 0")
def undelivered_messages(spark: SparkSession, d: str) -> DataFrame:
    good, _ = envelopes.messages(click_events(spark, d), topic="t")
    failed = network.deliver(good, Refusing, batch_size=1)
    return failed.select(F.col("event_id").cast("bigint").alias("event_id"), "error")


# -- batches, dead letters, keys ----------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE o AS (SELECT event_id, event_type, 100 + event_id % 400 AS size, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch_us(ts) / 1000) AS BIGINT), event_id) AS i FROM events), "
    "b AS (SELECT event_id, event_type, i, t, t AS opened, size AS held, 0 AS file_no FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.event_type, o.i, o.t, CASE WHEN c.cut THEN o.t ELSE c.opened END, CASE WHEN c.cut THEN o.size ELSE c.held + o.size END, "
    "CASE WHEN c.cut THEN c.file_no + 1 ELSE c.file_no END FROM (SELECT b.*, n.size AS next_size, n.t AS next_t, b.held + n.size > 20000 OR n.t - b.opened >= 86400000 OR n.t - b.t >= 3600000 AS cut FROM b JOIN o n ON n.event_type = b.event_type AND n.i = b.i + 1) c "
    "JOIN o ON o.event_type = c.event_type AND o.i = c.i + 1) SELECT event_type, CAST(file_no AS BIGINT) AS file_no, count(*) AS n, sum(event_id) AS ids FROM b GROUP BY 1, 2"
)
def rolled_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that roll by bytes, age and idle time."""
    rows = table(spark, d, "events").select("event_id", "event_type", (100 + F.col("event_id") % 400).alias("size_bytes"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    rolled = batching.roll_files(rows, ["event_type"], ["ts_ms", "event_id"], max_bytes=20_000, max_age_ms=86_400_000, idle_ms=3_600_000)
    return rolled.groupBy("event_type", "file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _split_journal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type")
    return rows.where("seq % 3 = 0"), rows.where("seq % 3 <> 0")


_OLD_NEW = "WITH o AS (SELECT event_id AS seq, event_type FROM events WHERE event_id % 3 = 0), w AS (SELECT event_id AS seq, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id % 3 <> 0), c AS (SELECT count(*) AS n FROM o)"


@query(f"{_OLD_NEW} SELECT seq, event_type, true AS kept FROM o UNION ALL SELECT w.seq, w.event_type, w.n <= 100 FROM w, c")
def dlq_reject(spark: SparkSession, d: str) -> DataFrame:
    """A full queue: the first hundred new entries fit, the others are turned away."""
    old, new = _split_journal(spark, d)
    kept, away = dlq.admit(old, new, old.count() + 100, "reject")
    return kept.withColumn("kept", F.lit(True)).unionByName(away.withColumn("kept", F.lit(False)))


@query("SELECT least(50, count(DISTINCT user_id) + 1) AS sampled, true AS all_known FROM events")
def sampled_keys(spark: SparkSession, d: str) -> DataFrame:
    """Fifty distinct keys, or all if there are fewer: one of each user, and one that all objects have."""
    counts = _user_keys(spark, d)
    sample = sensing.sample_keys(counts)
    found = sample.join(counts.select("key", F.col("n").alias("known")), "key", "left")
    return found.agg(F.count_distinct("key").alias("sampled"), F.bool_and(F.col("known").isNotNull()).alias("all_known"))


@query("SELECT true AS is_near, count(DISTINCT user_id) AS keys FROM events")
def approx_distinct_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate lies within five hundredths of the exact number."""
    rows = table(spark, d, "events")
    exact = rows.agg(F.count_distinct("user_id").alias("keys"))
    about = sensing.distinct_keys(rows, F.array(F.concat(F.lit("sess_"), F.col("user_id"))))
    return exact.join(F.broadcast(about), F.lit(True)).select((F.abs(F.col("distinct_keys") - F.col("keys")) <= 0.05 * F.col("keys")).alias("is_near"), "keys")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN '{\"total\":\"1\",\"<dynamic>\":\"2\"}' ELSE '{\"total\":\"1\"}' END AS normalised, count(*) AS n, 1 AS structures FROM events GROUP BY 1")
def dynamic_key_structures(spark: SparkSession, d: str) -> DataFrame:
    """Objects that differ in their dynamic keys only are one structure."""
    k = F.col("event_id")
    body = F.concat(F.lit('{"total":1'), F.when(k % 2 == 0, F.concat(F.lit(',"sess_'), k, F.lit('":2'))).otherwise(""), F.lit("}"))
    rows = table(spark, d, "events").select(body.alias("j"))
    made = rows.select(sensing.normalise_keys(F.col("j"), ["total"]).alias("normalised"), sensing.adaptive_fingerprint(F.col("j"), ["total"]).alias("fp"))
    return made.groupBy("normalised").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fp").alias("structures"))


@query(
    "SELECT '' AS path, 'object' AS type, count(*) AS n FROM events UNION ALL SELECT 'k', 'int', count(*) FROM events UNION ALL SELECT 'items', 'array', count(*) FROM events "
    "UNION ALL SELECT 'items[]', CASE WHEN event_id % 3 = 0 THEN 'string' ELSE 'bool' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'by.<*>', 'float', count(*) FROM events UNION ALL SELECT 'by', 'object', count(*) FROM events"
)
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths and types of nested objects, of which one is a map with a key for each user."""
    first = F.when(F.col("event_id") % 3 == 0, '"x"').otherwise("true")
    body = F.concat(F.lit('{"k":'), F.col("event_id"), F.lit(',"items":['), first, F.lit(',1],"by":{"u'), F.col("user_id"), F.lit('":0.5}}'))
    return sensing.path_types(table(spark, d, "events").select(body.alias("j")), "j", {"by": []})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'mysql://u' || s_suppkey || ':***@host/db' ELSE 'http://host/' || s_suppkey END AS url FROM supplier")
def redacted_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("mysql://u"), k, F.lit(":p:w@"), k, F.lit("@host/db"))).otherwise(F.concat(F.lit("http://host/"), k))
    return table(spark, d, "supplier").select("s_suppkey", network.redact_column(url).alias("url"))


# -- streams ------------------------------------------------------------------------------------------------------------


@query("SELECT 'all' AS sink, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 2 UNION ALL SELECT 'clicks', event_type, count(*) FROM events WHERE event_type = 'click' GROUP BY 2")
def stream_pipeline_sinks(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline over a file stream with two sinks, one of which takes a part; what each has after the commit."""
    base = folder(spark, "pipeline")
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = events(rows, after=F.to_json(F.struct("event_id", "event_type")), op=F.lit("c"), event_id=F.col("event_id").cast("string"), ts_ms=F.unix_millis(F.col("ts").cast("timestamp")), source=source_struct(db=F.lit("app"), table=F.lit("events")))
    kind = F.get_json_object("after", "$.event_type")

    def writer(name: str):
        return lambda df, n: df.select(kind.alias("event_type")).write.mode("overwrite").parquet(posixpath.join(base, name, f"batch={n}"))

    sinks = [Sink("all", writer("all")), Sink("clicks", writer("clicks"), takes=lambda df: df.where(kind == "click"))]
    p = Pipeline(f"p{uuid.uuid4().hex}", [EventFilter(ops=("c",)), lambda df: df.where(kind != "view")], sinks, SharedProgress(spark, posixpath.join(base, "progress.json")))
    p.start(stream.select(*EVENT_SCHEMA.names), posixpath.join(base, "checkpoint")).awaitTermination()
    done = SharedProgress(spark, posixpath.join(base, "progress.json"))
    parts = []
    for s in sinks:
        batches = range(done.last(p.name, s.id) + 1)
        written = spark.read.schema("event_type string").parquet(*(posixpath.join(base, s.id, f"batch={n}") for n in batches))
        parts.append(written.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.id).alias("sink"), "event_type", "n"))
    return parts[0].unionByName(parts[1])


@query(
    "WITH e AS (SELECT event_id, event_id % 30 = 0 AS kind, row_number() OVER w AS i, lag(event_id % 30 = 0) OVER w AS was FROM events WINDOW w AS (ORDER BY CAST(floor(epoch_us(ts) / 1000) AS BIGINT), CAST(event_id AS VARCHAR))), "
    "c AS (SELECT *, i > 1 AND kind <> was AS changed FROM e), o AS (SELECT *, lag(changed) OVER (ORDER BY i) AS changed_before, sum(CAST(changed AS INT)) OVER (ORDER BY i) + 1 AS sequence FROM c) "
    "SELECT event_id, CASE WHEN i = 1 THEN 'NewSchema' WHEN changed THEN 'Evolved' WHEN changed_before THEN 'Unchanged' ELSE 'CacheHit' END AS outcome, CAST(sequence AS BIGINT) AS sequence FROM o"
)
def stream_sensor(spark: SparkSession, d: str) -> DataFrame:
    """The sensor over a file stream of one table, whose events have a key more now and then."""
    base, provider = folder(spark, "sensor"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
        body = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 30 == 0, 1).alias("extra")))
        stream = events(rows, after=body, op=F.lit("c"), event_id=F.col("event_id").cast("string"), ts_ms=F.unix_millis(F.col("ts").cast("timestamp")), source=source_struct(db=F.lit("app"), table=F.lit("events")))
        found = sense(stream, SensorOptions(warm_up=1 << 40, stabilise_at=1 << 40, cache=100)).select(F.col("event_id").cast("bigint").alias("event_id"), "outcome", F.col("schema_sequence").alias("sequence"))
        out = posixpath.join(base, "out")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", posixpath.join(base, "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("event_id long, outcome string, sequence long").parquet(out)
