"""Registered queries over the test tables, and the DuckDB SQL that each is checked against.

A change log isn't among the tables, so changes are derived from keys, the same way in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, paths, patterns, templates
from ..functions.types import ColumnInfo
from ..operators import batching, dlq, drift, progress, registry, sensing
from ..operators.filter import EventFilter, Predicate, SinkFilter
from ..operators.flatten import FlattenOptions, flatten
from ..operators.outbox import OutboxOptions, outbox
from ..operators.udf import mark_synthetic, process_batch, route
from ..schema import dedup, events, full_table, idempotency_key, source_struct
from ..sinks import avro, columnstore, envelopes, lake
from ..sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: 2024-01-01 in milliseconds: the derived changes' clock begins here.
T0 = 1_704_067_200_000
ORDERS = [ColumnInfo("o_orderkey", "bigint", False), ColumnInfo("o_custkey", "bigint"), ColumnInfo("o_orderstatus", "varchar(1)"), ColumnInfo("o_totalprice", "double"), ColumnInfo("o_orderpriority", "varchar(20)")]
CUSTOMER = [ColumnInfo("c_custkey", "bigint", False), ColumnInfo("c_name", "varchar(40)"), ColumnInfo("c_nationkey", "int"), ColumnInfo("c_acctbal", "double")]


def order_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return ingest.snapshot(rows, "shop", "orders", ts_ms=F.lit(T0) + F.col("o_orderkey"))


def customer_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return ingest.snapshot(rows, "shop", "customer", ts_ms=F.lit(T0) + F.col("c_custkey"))


def click_events(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    """The events table as creates of app.events."""
    rows = table(spark, d, "events")
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.from_json("props", "map<string,bigint>").alias("props")))
    given = {"after": body, "op": F.lit("c"), "ts_ms": F.unix_millis(F.col("ts").cast("timestamp")), "event_id": F.col("event_id").cast("string"), "source": source_struct(connector=F.lit("mysql"), name=F.lit("app"), db=F.lit("app"), table=F.lit("events"), pos=F.col("event_id"))}
    return events(rows, **given | more)


def customer_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each customer is created; every second is updated (balance + 1), every fifth deleted after that. Positions are log sequence numbers."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    steps = rows.select("*", F.explode(F.array(F.lit(0), F.when(F.col("c_custkey") % 2 == 0, 1), F.when(F.col("c_custkey") % 5 == 0, 2))).alias("step")).where("step is not null")
    image = lambda bal: F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", bal.alias("c_acctbal")))
    first, later = image(F.col("c_acctbal")), image(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    op = F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("d")), F.col("step") + 1)
    lsn = F.concat(F.hex(F.col("step") + 1), F.lit("/"), F.hex("c_custkey"))
    source = source_struct(connector=F.lit("postgresql"), name=F.lit("pg"), db=F.lit("shop"), schema=F.lit("public"), table=F.lit("customer"), lsn=lsn)
    return events(steps, before=F.when(op == "u", first).when(op == "d", later), after=F.when(op == "c", first).when(op == "u", later), op=op, ts_ms=F.lit(T0) + F.col("step"), source=source)


CHANGES_SQL = f"""changes AS (
  SELECT c_custkey, c_name, c_nationkey, s.step, CASE WHEN s.step = 0 OR c_custkey % 2 <> 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal,
         ['c', 'u', 'd'][s.step + 1] AS _op, CAST(s.step + 1 AS DECIMAL(20, 0)) * 4294967296 + c_custkey AS _version, CAST(s.step = 2 AS INT) AS _deleted, {T0} + s.step AS ts_ms
  FROM customer, (VALUES (0), (1), (2)) s(step) WHERE s.step = 0 OR (s.step = 1 AND c_custkey % 2 = 0) OR (s.step = 2 AND c_custkey % 5 = 0))"""


def long(v: str) -> Column:
    return paths.get(paths.image("after"), v, "bigint")


def double(v: str) -> Column:
    return paths.get(paths.image("after"), v, "double")


def string(v: str) -> Column:
    return paths.get(paths.image("after"), v, "string")


# -- sources ------------------------------------------------------------------------------------------------------------


@query("SELECT 'r' AS op, 'shop.customer' AS full_table, true AS is_snapshot, CAST(NULL AS VARCHAR) AS position, c_custkey, c_name, c_acctbal FROM customer")
def snapshot_read_events(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    return customer_events(spark, d).select("op", full_table(s).alias("full_table"), coerce.snapshot_flag(s).alias("is_snapshot"), coerce.position_text(s).alias("position"), long("c_custkey").alias("c_custkey"), string("c_name").alias("c_name"), double("c_acctbal").alias("c_acctbal"))


@query("WITH m AS (SELECT min(o_orderkey) AS low FROM orders) SELECT CAST(floor((o_orderkey - low) / 1000) AS BIGINT) AS chunk, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n_rows FROM orders, m GROUP BY 1")
def pk_chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_ranges(table(spark, d, "orders"), "o_orderkey", 1_000)


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'a_tab' WHEN 1 THEN 'b_tab' WHEN 2 THEN 'c_tab' END AS tbl, s_suppkey % 4 <> 3 AS is_ddl FROM supplier")
def ddl_table_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    sql = F.when(k == 0, "ALTER TABLE `shop`.`a_tab` ADD x INT").when(k == 1, "drop table if exists b_tab").when(k == 2, "CREATE TABLE IF NOT EXISTS db.c_tab (id INT)").otherwise("INSERT INTO z VALUES (1)")
    return table(spark, d, "supplier").select("s_suppkey", ingest.ddl_table(sql).alias("tbl"), ingest.is_ddl(sql).alias("is_ddl"))


@query("SELECT l_suppkey AS server, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def gtid_set_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("server"), F.col("l_orderkey").alias("first"), F.col("l_orderkey").alias("last"))
    return progress.gtid_merge(rows, "server")


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS from_pg_ms, epoch_us(ts) - 946684800000000 AS pg_us FROM events")
def pg_epoch_convert(spark: SparkSession, d: str) -> DataFrame:
    pg = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(coerce.PG_EPOCH_S * 1_000_000)
    return table(spark, d, "events").select("event_id", coerce.pg_micros_to_millis(pg).alias("from_pg_ms"), pg.alias("pg_us"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS as_bool, s_suppkey AS as_int, CAST(s_acctbal AS VARCHAR) AS as_numeric FROM supplier")
def pg_values_by_oid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    v = lambda oid, text: paths.image(ingest.pg_json(F.lit(oid), text))
    flag = F.when(F.col("s_suppkey") % 2 == 0, "t").otherwise("f")
    return rows.select("s_suppkey", v(16, flag).try_cast("boolean").alias("as_bool"), v(20, F.col("s_suppkey").cast("string")).try_cast("bigint").alias("as_int"), v(1700, F.col("s_acctbal").cast("string")).try_cast("string").alias("as_numeric"))


@query("SELECT s_nationkey AS nation, s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 10)")
def snapshot_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("nation"))
    return progress.unfinished(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"), done, ("nation",))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '__outbox' ELSE '__wal_message' END AS schema, 'p' || (s_suppkey % 2) AS prefix FROM supplier WHERE s_suppkey % 3 <> 0")
def wal_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") % 2).alias("prefix"), F.when(F.col("s_suppkey") % 3 == 0, "not json").otherwise(F.to_json(F.struct("s_suppkey"))).alias("content"), F.lit("shop").alias("db"), F.lit("1/1").alias("lsn"), F.lit(T0).alias("ts_ms"))
    return ingest.message_events(rows, ("p0",)).select(long("s_suppkey").alias("s_suppkey"), F.col("source.schema").alias("schema"), F.col("source.table").alias("prefix"))


# -- filters ------------------------------------------------------------------------------------------------------------


def _orders_where(*tests: Predicate, mode: str = "all") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return EventFilter(predicates=tests, mode=mode)(order_events(spark, d)).select(long("o_orderkey").alias("o_orderkey"), double("o_totalprice").alias("o_totalprice"))

    return run


_O = "SELECT o_orderkey, o_totalprice FROM orders WHERE "
for _name, _tests, _sql in (
    ("filter_eq", [Predicate("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'"),
    ("filter_eq_number", [Predicate("o_custkey", "eq", 42.0)], "o_custkey = 42"),
    ("filter_ne", [Predicate("o_orderstatus", "ne", "F")], "o_orderstatus <> 'F'"),
    ("filter_ne_missing", [Predicate("nothing", "ne", "F")], "false"),
    ("filter_gt", [Predicate("o_totalprice", "gt", 200000)], "o_totalprice > 200000"),
    ("filter_lte", [Predicate("o_orderpriority", "lte", "2-HIGH")], "o_orderpriority <= '2-HIGH'"),
    ("filter_mixed_types", [Predicate("o_orderpriority", "gt", 1)], "false"),
    ("filter_in", [Predicate("o_orderstatus", "in", ["F", "P"])], "o_orderstatus IN ('F', 'P')"),
    ("filter_not_in", [Predicate("o_orderstatus", "not_in", ["F", "P"])], "coalesce(o_orderstatus NOT IN ('F', 'P'), true)"),
    ("filter_not_in_missing", [Predicate("nothing", "not_in", [1])], "true"),
    ("filter_contains", [Predicate("o_orderpriority", "contains", "HIGH")], "contains(o_orderpriority, 'HIGH')"),
    ("filter_regex", [Predicate("o_orderpriority", "regex", "^[12]-")], "regexp_matches(o_orderpriority, '^[12]-')"),
    ("filter_exists", [Predicate("o_custkey", "exists")], "o_custkey IS NOT NULL"),
    ("filter_not_exists", [Predicate("o_custkey", "not_exists")], "o_custkey IS NULL"),
):
    QUERIES[_name], ORACLES[_name] = _orders_where(*_tests), _O + _sql
QUERIES["filter_any"], ORACLES["filter_any"] = _orders_where(Predicate("o_orderstatus", "eq", "P"), Predicate("o_totalprice", "lt", 20000), mode="any"), _O + "o_orderstatus = 'P' OR o_totalprice < 20000"


@query(f"WITH {CHANGES_SQL} SELECT c_custkey, _op AS op FROM changes WHERE _op <> 'u' OR c_custkey % 2 = 0")
def filter_changed(spark: SparkSession, d: str) -> DataFrame:
    e = EventFilter(predicates=[Predicate("c_acctbal", "changed")])(customer_changes(spark, d))
    return e.select(paths.get(paths.image(F.coalesce("after", "before")), "c_custkey", "bigint").alias("c_custkey"), "op")


@query(f"WITH {CHANGES_SQL} SELECT _op AS op, count(*) AS n FROM changes WHERE _op IN ('c', 'd') GROUP BY 1")
def filter_op_gate(spark: SparkSession, d: str) -> DataFrame:
    return EventFilter(ops=("c", "d"))(customer_changes(spark, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'orders' AS tbl, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def filter_table_glob(spark: SparkSession, d: str) -> DataFrame:
    both = order_events(spark, d).unionByName(customer_events(spark, d)).unionByName(click_events(spark, d))
    return EventFilter(include=("shop.%", "*.events"), exclude=("shop.cust*",))(both).groupBy(F.col("source.table").alias("tbl")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, starts_with(n_name, 'U') OR n_name = 'CHINA' AS hit FROM nation")
def pattern_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", patterns.allowed(("q.U*", "CHINA"), (), F.lit("q"), F.col("n_name")).alias("hit"))


# -- projections --------------------------------------------------------------------------------------------------------


def _nested(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    body = F.struct("o_orderkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")).alias("cust"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("tags"))
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return events(joined, after=F.to_json(body), op=F.lit("c"), ts_ms=F.lit(T0), source=source_struct(db=F.lit("shop"), table=F.lit("orders")))


_J = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, 2 AS n_tags, 4 AS n_keys {_J}")
def flatten_nested_default(spark: SparkSession, d: str) -> DataFrame:
    e = flatten(_nested(spark, d))
    return e.select(long("o_orderkey").alias("o_orderkey"), string("cust__name").alias("name"), long("cust__home__nation").alias("nation"), F.size(F.from_json(string("tags"), "array<string>")).alias("n_tags"), F.size(F.json_object_keys("after")).alias("n_keys"))


@query(f"SELECT o_orderkey, CAST(c_nationkey AS BIGINT) AS nation, 4 AS n_keys {_J}")
def flatten_nested_maxdepth(spark: SparkSession, d: str) -> DataFrame:
    e = flatten(_nested(spark, d), FlattenOptions(max_depth=1))
    return e.select(long("o_orderkey").alias("o_orderkey"), long("cust__home.nation").alias("nation"), F.size(F.json_object_keys("after")).alias("n_keys"))


@query(f"SELECT o_orderkey, o_orderstatus AS first, o_orderpriority AS second {_J}")
def flatten_nested_index(spark: SparkSession, d: str) -> DataFrame:
    e = flatten(_nested(spark, d), FlattenOptions(lists="index"))
    return e.select(long("o_orderkey").alias("o_orderkey"), string("tags__0").alias("first"), string("tags__1").alias("second"))


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit("user").alias("aggregate_type"), F.col("user_id").alias("aggregate_id"), "event_type", F.col("event_id").alias("id"), F.struct("value", "event_id").alias("payload"), F.when(F.col("event_id") % 7 == 0, "special").alias("topic")))
    source = source_struct(connector=F.lit("mysql"), name=F.lit("app"), db=F.lit("app"), table=F.lit("outbox"), schema=F.when(F.col("event_id") % 3 != 0, "__outbox"))
    return click_events(spark, d, after=body, source=source, op=F.when(F.col("event_id") % 10 == 1, "u").otherwise("c"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'special' ELSE 'fallback' END AS topic, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events WHERE event_id % 3 = 0 OR event_id % 10 <> 1")
def outbox_route(spark: SparkSession, d: str) -> DataFrame:
    e = outbox(_outbox(spark, d), OutboxOptions(default_topic="fallback"))
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("routing.topic").alias("topic"), F.col("routing.key").alias("key"), double("value").alias("value"))


@query("SELECT event_id, 'user.' || event_type AS topic, 'user' AS kind, event_type AS type, CAST(event_id AS VARCHAR) AS id, 'outbox' AS origin FROM events WHERE event_id % 3 <> 0 AND event_id % 10 <> 1")
def outbox_headers(spark: SparkSession, d: str) -> DataFrame:
    e = outbox(_outbox(spark, d), OutboxOptions(topic="${aggregate_type}.${event_type}", strict=True)).where("routing is not null")
    h = lambda n: F.try_element_at("routing.headers", F.lit(n))
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("routing.topic").alias("topic"), h("df-aggregate-type").alias("kind"), h("df-event-type").alias("type"), h("df-event-id").alias("id"), h("df-source-kind").alias("origin"))


@query("SELECT o_orderkey, 'orders/' || o_orderstatus || '-' || o_custkey AS made, CAST(NULL AS VARCHAR) AS unresolved FROM orders")
def template_strict(spark: SparkSession, d: str) -> DataFrame:
    row = paths.image("after")
    return order_events(spark, d).select(long("o_orderkey").alias("o_orderkey"), templates.compile("${source.table}/${o_orderstatus}-${o_custkey}", row).alias("made"), templates.compile("x-${nothing.at.all}", row).alias("unresolved"))


@query("SELECT o_orderkey, 'r::' || o_orderstatus AS made FROM orders")
def template_lenient(spark: SparkSession, d: str) -> DataFrame:
    return order_events(spark, d).select(long("o_orderkey").alias("o_orderkey"), templates.compile("${op}:${nothing}:${after.o_orderstatus}", paths.image("after"), strict=False).alias("made"))


@query("SELECT event_id, '_|app.events||' || event_id AS key FROM events")
def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    return click_events(spark, d).select(F.col("event_id").cast("bigint").alias("event_id"), idempotency_key().alias("key"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def dedup_idempotent(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d)
    return dedup(e.unionByName(e.where(F.col("event_id") % 2 == 0))).groupBy(string("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'tag' END AS synthetic, false AS is_copy FROM events UNION ALL SELECT event_id + 1000000000, 'maker', true FROM events WHERE event_id % 5 = 0")
def synthetic_marks(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d, synthetic=F.when(F.col("event_id") % 4 == 0, "tag"))
    made = e.where(F.col("event_id") % 5 == 0).withColumns({"event_id": (F.col("event_id").cast("bigint") + 1_000_000_000).cast("string"), "synthetic": F.lit(None).cast("string")})
    out = mark_synthetic(e, e.unionByName(made), "maker")
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "synthetic", (F.col("event_id").cast("bigint") >= 1_000_000_000).alias("is_copy"))


@query("SELECT count(*) FILTER (event_id % 4 <> 0) AS originals, count(*) FILTER (event_id % 4 = 0) AS made FROM events")
def sink_filter_synthetic(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d, synthetic=F.when(F.col("event_id") % 4 == 0, "tag"))
    kept = SinkFilter(exclude_synthetic=True)(e).agg(F.count(F.lit(1)).alias("originals"))
    return kept.crossJoin(SinkFilter(synthetic_only=True, producers=("tag",))(e).agg(F.count(F.lit(1)).alias("made")))


def _double_values(batch: list[dict]) -> list[dict]:
    import json

    out = []
    for e in batch:
        row = json.loads(e["after"])
        if row["event_type"] != "error":
            row["value"] = row["value"] * 2
            out.append(route(e | {"after": json.dumps(row)}, topic=f"t-{row['event_type']}"))
    return out


@query("SELECT event_id, value * 2 AS value, 't-' || event_type AS topic FROM events WHERE event_type <> 'error'")
def udf_process_batch(spark: SparkSession, d: str) -> DataFrame:
    e = process_batch(click_events(spark, d), _double_values, columns=("after", "routing"))
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), double("value").alias("value"), F.col("routing.topic").alias("topic"))


# -- envelopes and sinks ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, '1.0' AS specversion, 'rowtide/mysql/shop.orders' AS source, 'rowtide.change.snapshot' AS type, strftime(make_timestamp((1704067200000 + o_orderkey) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, 'shop.orders' AS subject FROM orders")
def cloudevents_fields(spark: SparkSession, d: str) -> DataFrame:
    e = order_events(spark, d).withColumn("ce", envelopes.cloudevents_struct())
    return e.select(long("o_orderkey").alias("o_orderkey"), *(F.col(f"ce.{c}").alias(c) for c in ("specversion", "source", "type", "time", "subject")))


@query("SELECT o_orderkey, o_totalprice, 'r' AS op, true AS schema_is_null FROM orders")
def debezium_wrap(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json(envelopes.debezium())
    e = order_events(spark, d).select(v.alias("v"))
    at = lambda p, t: F.variant_get("v", f"$.payload.{p}", t)
    return e.select(at("after.o_orderkey", "bigint").alias("o_orderkey"), at("after.o_totalprice", "double").alias("o_totalprice"), at("op", "string").alias("op"), F.is_variant_null(F.variant_get("v", "$.schema", "variant")).alias("schema_is_null"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'app-events' END AS topic, CASE WHEN event_id % 2 = 0 THEN value END AS raw_value FROM events WHERE event_id % 2 = 0 OR event_id % 9 <> 0")
def message_routing(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("raw").alias("topic"), F.lit(None).alias("key"), F.lit(None).alias("headers"), F.lit(True).alias("raw_payload")))
    name = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.lit("app"))
    good, _ = envelopes.messages(click_events(spark, d, routing=raw, tenant_id=name), topic="${tenant_id}-${source.table}")
    return good.select(F.col("event_id").cast("bigint").alias("event_id"), "topic", F.when(F.col("topic") == "raw", F.try_variant_get(F.try_parse_json("value"), "$.value", "double")).alias("raw_value"))


@query("SELECT event_id FROM events WHERE event_id % 9 = 0")
def message_routing_errors(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d, tenant_id=F.when(F.col("event_id") % 9 != 0, "x"))
    _, bad = envelopes.messages(e, topic="${tenant_id}")
    return bad.select(F.col("event_id").cast("bigint").alias("event_id"))


@query("SELECT 'r' AS op, 'mysql' AS source_connector, 'shop' AS source_db, 'orders' AS source_table, true AS source_snapshot, CAST(NULL AS BIGINT) AS before_o_orderkey, o_orderkey AS after_o_orderkey, o_totalprice AS after_o_totalprice, o_orderstatus AS after_o_orderstatus FROM orders")
def lake_flat_envelope(spark: SparkSession, d: str) -> DataFrame:
    good, _ = lake.typed(order_events(spark, d), ORDERS)
    return good.select("op", "source_connector", "source_db", "source_table", "source_snapshot", "before_o_orderkey", "after_o_orderkey", "after_o_totalprice", "after_o_orderstatus")


@query("SELECT 'orders' AS \"table\", strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4")
def hive_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit("orders").alias("source_table"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    return lake.partition_columns(rows).groupBy("table", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS part, CAST(floor((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1) / 5000) AS BIGINT) AS file_no, l_orderkey, l_linenumber FROM lineitem")
def rolling_file_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), "l_orderkey", "l_linenumber")
    return batching.by_count(rows, ["part"], ["l_orderkey", "l_linenumber"], 5_000).select("part", F.col("batch_no").alias("file_no"), "l_orderkey", "l_linenumber")


@query("SELECT lsn_hi * CAST(4294967296 AS DECIMAL(20,0)) + o_orderkey AS version, o_orderkey FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS DECIMAL(20,0)) AS lsn_hi FROM orders)")
def lsn_version(spark: SparkSession, d: str) -> DataFrame:
    lsn = F.concat(F.hex(F.col("o_custkey") % 100), F.lit("/"), F.hex("o_orderkey"))
    return table(spark, d, "orders").select(coerce.lsn_number(lsn).alias("version"), "o_orderkey")


@query(f"WITH {CHANGES_SQL} SELECT c_custkey, c_name, c_nationkey, c_acctbal, _op, _version, _deleted FROM changes")
def columnstore_changelog(spark: SparkSession, d: str) -> DataFrame:
    good, _ = columnstore.project(customer_changes(spark, d), CUSTOMER)
    return good.drop("_source_ts")


@query(f"WITH {CHANGES_SQL} SELECT c_custkey, c_name, c_nationkey, c_acctbal, _version FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY _version DESC) AS n FROM changes) WHERE n = 1 AND _deleted = 0")
def current_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    good, _ = columnstore.project(customer_changes(spark, d), CUSTOMER)
    return columnstore.current_state(good, ["c_custkey"]).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "_version")


# -- coercions ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2)) * 10) / 10 AS DECIMAL(18,1)) AS cut FROM lineitem")
def decimal_truncate(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", coerce.truncated(text, 18, 1).alias("cut"))


def _bad_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which some have a customer that isn't a number, or no key."""
    k = F.col("o_orderkey")
    body = F.struct(F.when(k % 11 != 0, k).alias("o_orderkey"), F.when(k % 7 == 0, F.lit("abc")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    source = source_struct(connector=F.lit("mysql"), name=F.lit("m"), db=F.lit("shop"), table=F.lit("orders"))
    return events(table(spark, d, "orders"), after=F.to_json(body), op=F.lit("c"), ts_ms=F.lit(T0), event_id=F.lpad(k.cast("string"), 12, "0"), source=source)


@query("SELECT CAST(o_orderkey AS BIGINT) AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'o_orderkey: null' ELSE 'o_custkey: wrong type' END AS error, 'serialization' AS kind, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def dlq_split(spark: SparkSession, d: str) -> DataFrame:
    _, bad = columnstore.project(_bad_orders(spark, d), ORDERS)
    return dlq.entries(bad, "p", "s", F.lit(T0)).select(F.col("event_id").cast("bigint").alias("event_id"), "error", F.col("error_kind").alias("kind"), "seq")


def _journal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "event_type")


@query("SELECT seq, event_type FROM (SELECT event_id AS seq, event_type FROM events ORDER BY event_id LIMIT 50) WHERE event_type = 'click'")
def dlq_peek(spark: SparkSession, d: str) -> DataFrame:
    return dlq.peek(_journal(spark, d), 50, F.col("event_type") == "click").select("seq", "event_type")


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def dlq_drop_oldest(spark: SparkSession, d: str) -> DataFrame:
    return dlq.drop_oldest(_journal(spark, d), 500).select("seq", "event_type")


@query("WITH m AS (SELECT epoch_ms(max(ts)) AS now FROM events) SELECT event_id AS seq FROM events, m WHERE epoch_ms(ts) >= now - 604800000 AND event_id > 100")
def dlq_ack_expire(spark: SparkSession, d: str) -> DataFrame:
    j = _journal(spark, d)
    return dlq.acknowledge(dlq.expire(j, j.agg(F.max("timestamp_ms")).first()[0]), 100).select("seq")


@query("SELECT count(*) AS entries, count(*) / 10000.0 AS saturation, CASE WHEN count(*) >= 9500 THEN 'alarm' WHEN count(*) >= 8000 THEN 'warn' ELSE 'ok' END AS state FROM events")
def dlq_saturation(spark: SparkSession, d: str) -> DataFrame:
    return dlq.saturation(_journal(spark, d))


# -- registry, drift, sensing -------------------------------------------------------------------------------------------


def _registry(spark: SparkSession) -> DataFrame:
    rows = [("_", "app", "events", f"h{k}", "{}", s, t) for k, (s, t) in enumerate(((1, 0), (1000, 400), (5000, 2_000), (9000, 8_000)))]
    return spark.createDataFrame(rows, "tenant string, db string, `table` string, hash string, schema_json string, sequence bigint, registered_at bigint")


@query("SELECT event_id, CASE WHEN event_id >= 9000 THEN 'h3' WHEN event_id >= 5000 THEN 'h2' WHEN event_id >= 1000 THEN 'h1' WHEN event_id >= 1 THEN 'h0' END AS hash FROM events")
def schema_asof_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.lit("_").alias("tenant"), F.lit("app").alias("db"), F.lit("events").alias("table"))
    return registry.asof(e, _registry(spark), "event_id", "sequence").select("event_id", "hash")


@query("WITH e AS (SELECT event_id, user_id AS at FROM events), r(hash, registered_at) AS (VALUES ('h0', 0), ('h1', 400), ('h2', 2000), ('h3', 8000)) SELECT event_id, hash FROM e ASOF LEFT JOIN r ON e.at >= r.registered_at")
def schema_asof_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("at"), F.lit("_").alias("tenant"), F.lit("app").alias("db"), F.lit("events").alias("table"))
    return registry.asof(e, _registry(spark), "at", "registered_at").select("event_id", "hash")


@query("SELECT c_nationkey AS tbl, c_mktsegment AS hash, row_number() OVER (PARTITION BY c_nationkey ORDER BY attempt) AS version, row_number() OVER (ORDER BY attempt) AS sequence FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS attempt FROM customer GROUP BY 1, 2)")
def registry_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.lit("_").alias("tenant"), F.lit("db").alias("db"), F.col("c_nationkey").alias("table"), F.col("c_mktsegment").alias("hash"), F.lit("{}").alias("schema_json"), F.lit(0).alias("registered_at"), F.col("c_custkey").alias("attempt"))
    return registry.register(rows).select(F.col("table").alias("tbl"), "hash", "version", "sequence")


def _catalog(rows: DataFrame, db: str, name: str, kind: Column, key: Column) -> DataFrame:
    return rows.select(F.lit(db).alias("db"), F.concat(F.lit("t"), F.col("p_size")).alias("table"), F.col(name).alias("name"), kind.alias("data_type"), key.alias("pk_ordinal"))


@query(
    "WITH s AS (SELECT 't' || p_size AS tbl, p_name || p_partkey AS name, p_partkey AS k FROM part WHERE p_partkey % 5 <> 0), l AS (SELECT 't' || p_size AS tbl, p_name || p_partkey AS name, p_partkey AS k FROM part WHERE p_partkey % 7 <> 0 AND p_size % 10 <> 0), "
    "a AS (SELECT DISTINCT tbl FROM s), b AS (SELECT DISTINCT tbl FROM l), c AS (SELECT coalesce(s.tbl, l.tbl) AS tbl, coalesce(s.name, l.name) AS name, s.k AS sk, l.k AS lk FROM s FULL JOIN l ON s.tbl = l.tbl AND s.name = l.name), "
    "k AS (SELECT * FROM c WHERE tbl IN (SELECT tbl FROM a) AND tbl IN (SELECT tbl FROM b)) "
    "SELECT tbl, name, CASE WHEN sk IS NULL THEN 'added' WHEN lk IS NULL THEN 'dropped' ELSE 'type_changed' END AS kind, false AS is_stop FROM k WHERE sk IS NULL OR lk IS NULL OR sk % 3 = 0 "
    "UNION ALL SELECT tbl, name, 'pk_changed', true FROM k WHERE (sk IS NOT NULL AND sk % 11 = 0) <> (lk IS NOT NULL AND lk % 13 = 0) UNION ALL SELECT tbl, NULL, 'table_dropped', false FROM a WHERE tbl NOT IN (SELECT tbl FROM b)"
)
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two catalogs whose columns are the parts, and whose tables are their sizes: some are dropped, added, of another type or key."""
    parts = table(spark, d, "part").withColumn("named", F.concat("p_name", "p_partkey"))
    k = F.col("p_partkey")
    stored = _catalog(parts.where(k % 5 != 0), "shop", "named", F.lit("int"), F.when(k % 11 == 0, 1))
    live = _catalog(parts.where((k % 7 != 0) & (F.col("p_size") % 10 != 0)), "shop", "named", F.when(k % 3 == 0, "bigint").otherwise("int"), F.when(k % 13 == 0, 1))
    return registry.diff(stored, live).select(F.col("table").alias("tbl"), "name", "kind", "is_stop")


def _declared(spark: SparkSession) -> DataFrame:
    rows = [("app", "events", "event_id", "bigint", False), ("app", "events", "user_id", "int", False), ("app", "events", "event_type", "varchar(20)", True), ("app", "events", "value", "double", False)]
    return spark.createDataFrame(rows, "db string, `table` string, name string, data_type string, nullable boolean")


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """Events of which every 50th has no value, every 20th a user that is a text, every 30th a key too many."""
    k = F.col("event_id")
    user = F.when(k % 20 == 0, F.concat(F.lit('"u'), k, F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    value = F.when(k % 50 == 0, "null").otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    body = F.concat(F.lit('{"event_id":'), k, F.lit(',"user_id":'), user, F.lit(',"event_type":"'), F.col("event_type"), F.lit('","value":'), value, F.when(k % 30 == 0, ',"extra":1').otherwise(""), F.lit("}"))
    return click_events(spark, d, after=body)


_BASE = "SELECT 'event_id' AS name, count(*) AS total, 0 AS nulls, 0 AS mismatches, 'integer' AS dominant_type, false AS is_high_null FROM events"


@query(
    f"{_BASE} UNION ALL SELECT 'user_id', count(*), 0, count(*) FILTER (event_id % 20 = 0), 'integer', false FROM events UNION ALL SELECT 'event_type', count(*), 0, 0, 'string', false FROM events "
    "UNION ALL SELECT 'value', count(*), count(*) FILTER (event_id % 50 = 0), 0, 'number', true FROM events"
)
def drift_column_stats(spark: SparkSession, d: str) -> DataFrame:
    return drift.column_stats(_faulty(spark, d), _declared(spark)).select("name", "total", "nulls", "mismatches", "dominant_type", "is_high_null")


@query("SELECT 'value' AS name, count(*) FILTER (event_id % 50 = 0) / count(*) AS null_rate FROM events")
def drift_high_null(spark: SparkSession, d: str) -> DataFrame:
    return drift.column_stats(_faulty(spark, d), _declared(spark)).where("is_high_null").select("name", "null_rate")


@query("SELECT 'app' AS db, 'events' AS tbl, 4 AS columns, 1 AS drifted_columns, count(*) FILTER (event_id % 20 = 0) AS mismatches, 1 AS high_null_columns FROM events")
def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    return drift.summary(drift.column_stats(_faulty(spark, d), _declared(spark))).withColumnRenamed("table", "tbl")


@query("WITH b AS (SELECT '\"u' || event_id || '\"' AS sample, row_number() OVER (ORDER BY CAST(event_id AS VARCHAR)) AS n FROM events WHERE event_id % 20 = 0) SELECT 'user_id' AS name, 'string' AS seen, count(*) AS n, string_agg(sample, ',' ORDER BY n) FILTER (n <= 5) AS samples FROM b")
def drift_samples(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_events(_faulty(spark, d), _declared(spark)).select("name", "seen", "n", F.array_join("samples", ",").alias("samples"))


@query("SELECT 'extra' AS name, count(*) AS events FROM events WHERE event_id % 30 = 0")
def undeclared_columns(spark: SparkSession, d: str) -> DataFrame:
    return registry.undeclared(_faulty(spark, d), _declared(spark)).select("name", "events")


@query("WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END AS kind FROM events), c AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS changed FROM s WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_id, event_type, sum(changed) OVER (PARTITION BY event_type ORDER BY event_id) AS schema_sequence FROM c")
def schema_evolution_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = _faulty(spark, d).select(F.col("event_id").cast("bigint").alias("event_id"), string("event_type").alias("event_type"), sensing.key_fingerprint(F.col("after")).alias("fp"))
    return sensing.evolution(rows, ["event_type"], ["event_id"], "fp").select("event_id", "event_type", "schema_sequence")


def _user_keys(spark: SparkSession, d: str) -> DataFrame:
    """Objects with one key by user and one that all share."""
    rows = table(spark, d, "events")
    return sensing.key_counts(rows, "sessions", F.array(F.concat(F.lit("sess_"), F.col("user_id")), F.lit("total")))


_KEYS = "k AS (SELECT 'sess_' || user_id AS key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events)"


@query(f"WITH {_KEYS} SELECT key, n FROM k ORDER BY n DESC, key LIMIT 50")
def heavy_hitters_topk(spark: SparkSession, d: str) -> DataFrame:
    return sensing.heavy_hitters(_user_keys(spark, d)).select("key", "n")


@query(f"WITH {_KEYS}, t AS (SELECT count(*) AS events FROM events) SELECT 'sessions' AS path, count(*) AS keys, count(*) FILTER (n >= 0.5 * events) AS n_stable, count(*) FILTER (n < 0.5 * events) AS n_dynamic, 0.75 AS confidence, true AS is_map FROM k, t")
def path_classification(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return sensing.classify_paths(_user_keys(spark, d), n).select("path", "keys", "n_stable", "n_dynamic", "confidence", "is_map")


@query()
def approx_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return sensing.distinct_keys(table(spark, d, "events"), F.array(F.concat(F.lit("sess_"), F.col("user_id"))))


# -- progress -----------------------------------------------------------------------------------------------------------


@query("SELECT s_nationkey AS source_id, min(s_suppkey) AS pos, count(*) AS sinks FROM supplier GROUP BY 1")
def min_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id"), F.concat(F.lit("binlog."), F.lpad((F.col("s_suppkey") / 10).cast("int").cast("string"), 6, "0")).alias("file"), F.col("s_suppkey").alias("pos"))
    return progress.min_checkpoint(rows).select("source_id", "pos", "sinks")


_ACK = "a AS (SELECT l_orderkey AS batch_id, l_linenumber AS sink_id, l_linenumber = 1 AS required, l_quantity < 40 AS acked FROM lineitem)"


@query(f"WITH {_ACK} SELECT batch_id, bool_and(acked) AS all_ok, bool_and(acked OR NOT required) AS required_ok, count(*) FILTER (acked) >= 2 AS quorum_ok FROM a GROUP BY 1")
def commit_policy(spark: SparkSession, d: str) -> DataFrame:
    acks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("sink_id"), (F.col("l_linenumber") == 1).alias("required"), (F.col("l_quantity") < 40).alias("acked"))
    out = progress.committed(acks, "all").select("batch_id", F.col("committed").alias("all_ok"))
    for name, policy, quorum in (("required_ok", "required", None), ("quorum_ok", "quorum", 2)):
        out = out.join(progress.committed(acks, policy, quorum).select("batch_id", F.col("committed").alias(name)), "batch_id")
    return out


@query("WITH m AS (SELECT epoch_ms(max(ts)) + 1000 AS now FROM events) SELECT 'app' AS db, 'events' AS tbl, count(*) AS events, CAST(1000 AS BIGINT) AS lag_ms FROM events, m")
def table_lag(spark: SparkSession, d: str) -> DataFrame:
    e = click_events(spark, d)
    now = F.lit(e.agg(F.max("ts_ms")).first()[0] + 1000)
    return batching.table_lag(e, now).select("db", F.col("table").alias("tbl"), "events", "lag_ms")


@query(
    "WITH RECURSIVE o AS (SELECT event_id, event_type, 100 + event_id % 400 AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), "
    "b AS (SELECT event_id, event_type, i, size AS held, 1 AS n, 0 AS batch_no FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.event_type, o.i, CASE WHEN b.n >= 20 OR b.held + o.size > 3000 THEN o.size ELSE b.held + o.size END, "
    "CASE WHEN b.n >= 20 OR b.held + o.size > 3000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 20 OR b.held + o.size > 3000 THEN b.batch_no + 1 ELSE b.batch_no END FROM b JOIN o ON o.event_type = b.event_type AND o.i = b.i + 1) "
    "SELECT event_id, event_type, CAST(batch_no AS BIGINT) AS batch_no FROM b"
)
def batch_split_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", (100 + F.col("event_id") % 400).alias("size_bytes"))
    return batching.by_bytes(rows, ["event_type"], ["event_id"], max_events=20, max_bytes=3_000).select("event_id", "event_type", "batch_no")


@query("SELECT l_shipmode_hits AS hits, l_misses AS misses, CAST(l_shipmode_hits AS DOUBLE) / (l_shipmode_hits + l_misses) AS hit_rate FROM (SELECT count(*) FILTER (l_returnflag = 'R') AS l_shipmode_hits, count(*) FILTER (l_returnflag <> 'R') AS l_misses FROM lineitem)")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    counters = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count_if(F.col("l_returnflag") != "R").alias("misses"))
    return progress.cache_stats(counters)


# -- more values, and streams -------------------------------------------------------------------------------------------


@query("SELECT 'user_id' AS name, 'string' AS types, count(*) FILTER (event_id % 20 = 0) AS n, 5 AS n_samples FROM events")
def drift_by_column(spark: SparkSession, d: str) -> DataFrame:
    out = drift.by_column(drift.drift_events(_faulty(spark, d), _declared(spark)))
    return out.select("name", F.array_join("types", ",").alias("types"), "n", F.size("samples").alias("n_samples"))


@query("SELECT 'extra' AS name, count(*) FILTER (event_id % 30 <> 0) AS events FROM events UNION ALL SELECT 'note', count(*) FROM events")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = [("app", "events", n) for n in ("event_id", "extra", "note")]
    return registry.missing(_faulty(spark, d), spark.createDataFrame(rows, "db string, `table` string, name string")).select("name", "events")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS truncated FROM orders")
def dlq_truncation(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"k":"'), F.repeat(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, 300).otherwise(10)), F.lit('"}'))
    rows = table(spark, d, "orders").select("o_orderkey", body.alias("after"))
    before, after, large = dlq.truncate_payload(F.lit(None).cast("string"), F.col("after"), 256)
    return rows.select("o_orderkey", (large & before.isNull() & after.contains("_truncated")).alias("truncated"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 OR value IS NULL THEN 'null' ELSE 'number' END AS value_type, CASE WHEN event_id % 20 = 0 THEN 'string' ELSE 'integer' END AS user_type, CASE WHEN event_id % 30 = 0 THEN 'integer' ELSE 'null' END AS extra_type FROM events")
def json_type_names(spark: SparkSession, d: str) -> DataFrame:
    """A whole number that is written with a fraction (3.0) is a number, not an integer."""
    e = _faulty(spark, d)
    kind = lambda c: drift.json_type(paths.get(paths.image("after"), c))
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), kind("value").alias("value_type"), kind("user_id").alias("user_type"), kind("extra").alias("extra_type"))


@query("SELECT s_suppkey, 4 AS n, s_suppkey AS first, 'a,\"' || s_suppkey AS quoted FROM supplier")
def pg_arrays(spark: SparkSession, d: str) -> DataFrame:
    literal = F.concat(F.lit("{"), F.col("s_suppkey"), F.lit(',NULL,t,"a,\\"'), F.col("s_suppkey"), F.lit('"}'))
    rows = table(spark, d, "supplier").select("s_suppkey", F.parse_json(ingest.pg_array_json(literal)).alias("v"))
    at = lambda k, t: F.try_variant_get("v", f"$[{k}]", t)
    return rows.select("s_suppkey", F.size(F.col("v").try_cast("array<variant>")).alias("n"), at(0, "bigint").alias("first"), at(3, "string").alias("quoted"))


@query("SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey <= 2147483647 AS key_as_int, o_orderkey % 7 <> 0 AS cust_as_long, o_totalprice AS price FROM orders")
def coercion_validity(spark: SparkSession, d: str) -> DataFrame:
    row = paths.image("after")
    v = lambda c: paths.get(row, c)
    key, _ = coerce.int32(v("o_orderkey"))
    _, cust_ok = coerce.int64(v("o_custkey"))
    return _bad_orders(spark, d).select(F.col("event_id").cast("bigint").alias("o_orderkey"), key.isNotNull().alias("key_as_int"), cust_ok.alias("cust_as_long"), coerce.float64(v("o_totalprice"))[0].alias("price"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 < 5 THEN -1 WHEN s_suppkey % 10 > 5 THEN 1 ELSE 0 END AS lsn_order, CASE WHEN s_suppkey < 50 THEN -1 WHEN s_suppkey > 50 THEN 1 ELSE 0 END AS binlog_order FROM supplier")
def compare_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lsn = progress.compare(progress.lsn_order(F.concat(F.lit("A/"), F.hex(k % 10))), progress.lsn_order(F.lit("A/5")))
    log = progress.compare(progress.binlog_order(F.concat(F.lit("b."), k.cast("string")), F.lit(4)), progress.binlog_order(F.lit("b.50"), F.lit(4)))
    return table(spark, d, "supplier").select("s_suppkey", lsn.alias("lsn_order"), log.alias("binlog_order"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS is_text, n_name AS name FROM nation")
def mysql_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.encode("n_name", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode("n_name", "UTF-8")))
    v = F.parse_json(ingest.mysql_json(raw))
    rows = table(spark, d, "nation").select("n_nationkey", v.alias("v"))
    return rows.select("n_nationkey", (paths.kind_of(F.col("v")) == "string").alias("is_text"), F.coalesce(F.when(paths.kind_of(F.col("v")) == "string", F.col("v").try_cast("string")), F.decode(F.substring(coerce.binary(F.col("v"))[0], 2, 1000), "UTF-8")).alias("name"))


@query("SELECT count(DISTINCT (event_id % 30 = 0, event_id % 20 = 0, event_id % 50 = 0 OR value IS NULL)) AS structures FROM events")
def structure_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).select(sensing.fingerprint("after").alias("fp")).agg(F.count_distinct("fp").alias("structures"))


@query("SELECT o_orderkey, true AS framed, o_totalprice AS price FROM orders")
def avro_wire_format(spark: SparkSession, d: str) -> DataFrame:
    schema = avro.from_columns("Order", [ColumnInfo("k", "bigint"), ColumnInfo("p", "double")])
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))).alias("j"))
    out = avro.encode_rows(rows, "j", schema, 258)
    back = avro.decode_rows(out, "avro", schema)
    v = lambda p, t: paths.get(paths.image("decoded"), p, t)
    return back.select(v("k", "bigint").alias("o_orderkey"), (F.hex(F.substring("avro", 1, 5)) == "0000000102").alias("framed"), v("p", "double").alias("price"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def stream_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    """A file stream run to its end: filter, deduplicate by key, count by type. The result is as small as there are types."""
    import posixpath
    import uuid

    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    kept = rows.where("event_type <> 'view'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "365 days").dropDuplicatesWithinWatermark(["event_id"])
    name = f"counts_{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    writer = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    if base:
        writer = writer.option("checkpointLocation", posixpath.join(base, name))
    writer.start().awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders as snapshot events, through operation, table and field gates, as a flat typed table."""
    kept = EventFilter(ops=("r",), include=("shop.ord*",), predicates=(Predicate("o_totalprice", "gt", 100_000),))(order_events(spark, d))
    return lake.typed(kept, ORDERS)[0]


QUERIES["flagship_lake"] = lambda spark, d: flagship(spark, d).select("op", "after_o_orderkey", "after_o_totalprice")
ORACLES["flagship_lake"] = "SELECT 'r' AS op, o_orderkey AS after_o_orderkey, o_totalprice AS after_o_totalprice FROM orders WHERE o_totalprice > 100000"
