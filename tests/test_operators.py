"""Operators on small inputs: predicates' missing-value rules, flattening, outbox, user functions, registries, batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowtide.functions import coerce, paths, templates
from rowtide.functions.types import ColumnInfo, TypeOptions, column_store_type, create_table, pg_name, spark_type
from rowtide.operators import batching, dlq, drift, progress, registry, sensing
from rowtide.operators.filter import EventFilter, Predicate
from rowtide.operators.flatten import CollisionError, FlattenOptions, flatten_struct, flatten_value
from rowtide.operators.numbering import row_numbers
from rowtide.operators.outbox import OutboxOptions, outbox
from rowtide.operators.udf import process_batch, route
from rowtide.plans import spec
from rowtide.schema import EVENT_SCHEMA, dedup, events, source_struct
from rowtide.sinks import avro, columnstore, envelopes, lake, network
from rowtide.sources import ingest


def make(spark, rows, schema=None, table="orders", op="u"):
    df = spark.createDataFrame([(i, json.dumps(b) if b is not None else None, json.dumps(a) if a is not None else None) for i, (b, a) in enumerate(rows)], "i int, b string, a string")
    return events(df, before=F.col("b"), after=F.col("a"), op=F.lit(op), ts_ms=F.lit(1_700_000_000_000), event_id=F.col("i").cast("string"), source=source_struct(connector=F.lit("mysql"), name=F.lit("m"), db=F.lit("shop"), table=F.lit(table), schema=F.lit(schema)))


def hits(e, *tests, mode="all"):
    return sorted(int(r[0]) for r in EventFilter(predicates=tests, mode=mode)(e).select("event_id").collect())


ROWS = [(None, {"a": 42, "s": "x"}), (None, {"a": 42.0, "n": {"d": [1, "p", {"k": 1}]}}), (None, {"a": None}), (None, {}), (None, None), ({"a": 1}, {"a": 1.0}), ({"a": 1}, {"a": 2}), ({"a": 1}, {"b": 1})]


@pytest.mark.parametrize(
    ("test", "want"),
    [
        (Predicate("a", "eq", 42), [0, 1]),
        (Predicate("a", "eq", "42"), []),
        (Predicate("a", "ne", 42), [5, 6]),
        (Predicate("a", "exists"), [0, 1, 5, 6]),
        (Predicate("a", "not_exists"), [2, 3, 4, 7]),
        (Predicate("a", "gte", 2), [0, 1, 6]),
        (Predicate("s", "gt", "w"), [0]),
        (Predicate("s", "gt", 1), []),
        (Predicate("a", "in", [1, 2]), [5, 6]),
        (Predicate("a", "not_in", [42]), [2, 3, 4, 5, 6, 7]),
        (Predicate("a", "not_in", 42), []),
        (Predicate("n.d", "contains", "p"), [1]),
        (Predicate("n.d", "contains", {"k": 1}), [1]),
        (Predicate("s", "regex", "^x$"), [0]),
        (Predicate("a", "regex", "4"), []),
        (Predicate("a", "changed"), [0, 1, 2, 3, 4, 6, 7]),
        (Predicate("n", "eq", {"d": [1, "p", {"k": 1}]}), [1]),
    ],
)
def test_predicates(spark, test, want):
    assert hits(make(spark, ROWS), test) == want


def test_filter_modes_and_errors(spark):
    e = make(spark, ROWS)
    assert hits(e, mode="any") == list(range(8))
    assert hits(e, Predicate("a", "eq", 2), Predicate("s", "eq", "x"), mode="any") == [0, 6]
    with pytest.raises(Exception, match="unterminated|missing"):
        Predicate("a", "regex", "(")
    with pytest.raises(ValueError):
        Predicate("a", "like", "x")


@pytest.mark.parametrize(
    ("value", "options", "want"),
    [
        ({"a": {"b": {"c": 1}}}, {}, {"a__b__c": 1}),
        ({"a": {"b": {"c": 1}}}, {"max_depth": 1}, {"a__b": {"c": 1}}),
        ({"a": {"b": 1}}, {"max_depth": 0}, {"a": {"b": 1}}),
        ({"a": {"b": 1}}, {"separator": "."}, {"a.b": 1}),
        ({"a": {}}, {}, {"a": {}}),
        ({"a": {}}, {"empty_object": "drop"}, {}),
        ({"a": {}}, {"empty_object": "null"}, {"a": None}),
        ({"a": [1, {"b": 2}]}, {}, {"a": [1, {"b": 2}]}),
        ({"a": [1, {"b": 2}]}, {"lists": "index"}, {"a__0": 1, "a__1__b": 2}),
        ({"a": []}, {"empty_list": "null"}, {"a": None}),
        ({"a": []}, {"empty_list": "drop"}, {}),
        ({"a": {"b": 1}, "a__b": 2}, {}, {"a__b": 2}),
        ({"a": {"b": 1}, "a__b": 2}, {"collision": "first"}, {"a__b": 1}),
        ([1], {}, [1]),
        (None, {}, None),
    ],
)
def test_flatten(value, options, want):
    assert flatten_value(value, FlattenOptions(**options)) == want


def test_flatten_collision_error_and_struct(spark):
    with pytest.raises(CollisionError):
        flatten_value({"a": {"b": 1}, "a__b": 2}, FlattenOptions(collision="error"))
    df = spark.createDataFrame([((1, ("x", 2)),)], "s struct<a: int, b: struct<c: string, d: int>>")
    assert df.select(*flatten_struct(df["s"], df.schema["s"].dataType)).first().asDict() == {"a": 1, "b__c": "x", "b__d": 2}


def test_outbox(spark):
    row = {"aggregate_type": "Order", "aggregate_id": "42", "event_type": "OrderCreated", "payload": {"order_id": 42, "total": 99.99}}
    e = make(spark, [(None, row), (None, [1]), (None, None)], schema="__outbox", op="c")
    out = outbox(e, OutboxOptions(topic="${aggregate_type}.${event_type}", headers={"x": "aggregate_id"})).collect()
    assert len(out) == 1
    assert (out[0].routing.topic, out[0].routing.key, out[0].source.schema, out[0].before) == ("Order.OrderCreated", "42", None, None)
    assert json.loads(out[0].after) == row["payload"]
    assert out[0].routing.headers["x"] == "42" and out[0].routing.headers["df-source-kind"] == "outbox"
    custom = make(spark, [(None, {"domain": "orders", "entity_id": "42", "action": "created", "payload": {"total": 99.99}})], schema="__outbox", op="c")
    opts = OutboxOptions(topic="${domain}.${action}", aggregate_type="domain", aggregate_id="entity_id", event_type="action", strict=True)
    assert outbox(custom, opts).first().routing.topic == "orders.created"
    assert outbox(make(spark, [(None, row)], schema="__outbox", op="u"), OutboxOptions()).count() == 0
    assert outbox(make(spark, [(None, row)]), OutboxOptions()).first().routing is None
    with pytest.raises(Exception, match="without topic"):
        outbox(e, OutboxOptions(strict=True)).collect()


def test_templates(spark):
    e = make(spark, [(None, {"a": {"b": 1}, "t": "x", "z": None})])
    one = lambda t, **k: e.select(templates.compile(t, paths.image("after"), **k)).first()[0]
    assert one("${source.table}/${a.b}-${t}") == "orders/1-x"
    assert one("${z}") is None and one("<${z}>", strict=False) == "<>"
    assert templates.is_static("abc") and not templates.is_static("${a}")
    for bad in ("${a", "${}", "${a.b.c.d}", "${a..b}"):
        with pytest.raises(templates.TemplateError):
            templates.parse(bad)


def test_user_functions(spark):
    e = make(spark, [(None, {"id": 1}), (None, {"id": 2})])
    assert process_batch(e, lambda b: None).count() == 2
    assert process_batch(e, lambda b: b[0]).count() >= 1
    assert process_batch(e, lambda b: []).count() == 0
    routed = process_batch(e, lambda b: [route(x, topic="t", headers={"h": "1"}) for x in b]).first()
    assert routed.routing.topic == "t" and routed.routing.headers == {"h": "1"}
    with pytest.raises(Exception, match="not events"):
        process_batch(e, lambda b: 7).collect()
    assert process_batch(e, lambda b: b).schema.simpleString() == EVENT_SCHEMA.simpleString()


def test_coercions(spark):
    def run(of, value):
        v, ok = of(F.parse_json(F.lit(json.dumps(value))))
        return tuple(spark.range(1).select(v, ok).first())

    assert run(coerce.int32, 5) == (5, True) and run(coerce.int32, 2**40) == (None, False) and run(coerce.int32, "7") == (None, False) and run(coerce.int32, None) == (None, True)
    assert run(coerce.int64, "7") == (7, True) and run(coerce.int64, "x") == (None, False)
    assert run(coerce.boolean, 1) == (True, True) and run(coerce.boolean, 2) == (None, False)
    assert run(coerce.utf8, {"a": 1}) == ('{"a":1}', True)
    assert run(coerce.binary, {"_base64": "aGk="})[0] == b"hi"
    assert str(run(coerce.date, "2024-02-30")) == "(None, False)" and str(run(coerce.date, "2024-02-29")[0]) == "2024-02-29"
    assert str(run(coerce.decimal(10, 2), "1.239")[0]) == "1.23" and str(run(coerce.decimal(10, 2), 1.239)[0]) == "1.24" and run(coerce.decimal(4, 2), "12345.1")[1] is False
    assert run(coerce.timestamp, "2024-01-01T00:00:00Z")[0] == run(coerce.timestamp, 1704067200000)[0]
    assert run(coerce.array(coerce.int32), [1, None, 3]) == ([1, None, 3], True) and run(coerce.array(coerce.int32), [1, "x"]) == (None, False)
    lsn = lambda t: spark.range(1).select(coerce.lsn_number(F.lit(t))).first()[0]
    assert lsn("16/B374D848") == 97500059720 < lsn("16/B374D849") < lsn("17/0")
    assert lsn("not-an-lsn") is None and lsn("16") is None


def test_types():
    c = lambda t, **k: ColumnInfo("x", t, **k)
    kind = lambda *a, **k: spark_type(c(*a, **k)).simpleString()
    assert kind("int unsigned") == "bigint" and kind("bigint unsigned") == "string" and kind("decimal(10,2)") == "decimal(10,2)"
    assert spark_type(c("bigint unsigned"), TypeOptions(unsigned_bigint="decimal")).simpleString() == "decimal(20,0)"
    assert kind("text[]", connector="postgresql") == "array<string>" and kind("hstore", connector="postgresql") == "map<string,string>"
    assert kind("numeric(50,2)", connector="postgresql") == "string" and kind("bit(8)") == "binary" and kind("bool") == "boolean"
    assert pg_name("Character Varying(20)") == "varchar" and column_store_type(c("bigint unsigned", nullable=False)) == "UInt64"
    assert "ReplacingMergeTree" in create_table("t", [c("int")], ["x"]) and create_table("t", [c("int")], [], "append").endswith("tuple()")


def test_pg_array_and_ddl(spark):
    assert ingest.pg_array('{1,t,NULL,"a,\\"b",2.5,x}') == [1, True, None, 'a,"b', 2.5, "x"]
    assert ingest.pg_array("{}") == [] and ingest.pg_array("nope") is None
    rows = spark.createDataFrame([("TRUNCATE TABLE `a`.`b`", "a", 1), ("SELECT 1", "a", 1)], "sql string, db string, ts_ms long")
    assert [r.source.table for r in ingest.ddl_events(rows).collect()] == ["_ddl"]


def test_sources(spark):
    log = spark.createDataFrame([("insert", "d", "t", None, '{"a":1}', 1, "b.000001", 4, "x"), ("update", "d", "t", '{"a":1}', '{"a":2}', 2, "b.000001", 5, "x"), ("delete", "d", "t", '{"a":2}', None, 3, "b.000001", 6, None), ("other", "d", "t", None, None, 4, None, None, None)], "kind string, db string, table string, before string, after string, ts_ms long, file string, pos long, tx_id string")
    got = ingest.row_changes(log, "mysql").orderBy("ts_ms").collect()
    assert [r.op for r in got] == ["c", "u", "d"] and got[0].transaction.id == "x" and got[2].after is None
    trunc = spark.createDataFrame([("d", [("public", "a"), ("public", "b")], True, False, 1)], "db string, relations array<struct<schema: string, table: string>>, cascade boolean, restart_identity boolean, ts_ms long")
    assert {r.source.table for r in ingest.truncate_events(trunc).collect()} == {"a", "b"}
    assert ingest.SnapshotOptions().wanted(False) is False and ingest.SnapshotOptions("initial").wanted(False) and not ingest.SnapshotOptions("initial").wanted(True)
    a = ingest.Identity("s1")
    assert a.compare(None) == "first_seen" and a.compare(a) == "same" and a.compare(ingest.Identity("s2")) == "changed"
    assert ingest.page_predicates(250, 10_000)[-1] == "ctid >= '(200,0)'::tid AND ctid < '(300,0)'::tid"


def test_lake_files(spark, tmp_path):
    e = make(spark, [(None, {"id": 1, "price": "9.999"}), (None, {"id": "bad"})])
    good, bad = lake.typed(e, [ColumnInfo("id", "int"), ColumnInfo("price", "decimal(10,2)")])
    assert [str(r.after_price) for r in good.collect()] == ["9.99"] and bad.first().error == "after.id: not int"
    lake.write_parquet(good, str(tmp_path / "lake"))
    assert (tmp_path / "lake/table=orders/year=2023/month=11/day=14").is_dir()
    lake.write_jsonl(e, str(tmp_path / "lines"), "none")
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first().value)["source"]["db"] == "shop"
    only_meta, none = lake.typed(e, None)
    assert len(only_meta.columns) == 10 and none.count() == 0


def test_envelopes_and_messages(spark):
    e = make(spark, [(None, {"id": 1})])
    native = json.loads(e.select(envelopes.native()).first()[0])
    assert native["after"] == {"id": 1} and "routing" not in native and "size_bytes" not in native
    wrapped = json.loads(e.select(envelopes.debezium()).first()[0])
    assert wrapped["schema"] is None and wrapped["payload"] == native
    ce = json.loads(e.select(envelopes.cloudevents()).first()[0])
    assert ce["type"].endswith(".updated") and ce["time"] == "2023-11-14T22:13:20.000Z" and ce["data"]["after"] == {"id": 1}
    good, bad = envelopes.messages(e)
    assert (good.count(), bad.count()) == (0, 1)


def test_network(spark):
    class Fake:
        def send(self, messages):
            if any('"id":13' in m["value"] for m in messages):
                raise network.DeliveryError("permanent", "refused")

        def close(self):
            pass

    e = make(spark, [(None, {"id": 1}), (None, {"id": 13})])
    good, _ = envelopes.messages(e, topic="t")
    failed = network.deliver(good, Fake, batch_size=1).collect()
    assert len(failed) == 1 and "refused" in failed[0].error
    assert [network.http_error_kind(c) for c in (401, 429, 503, 404)] == ["auth", "retry", "retry", "permanent"]
    assert network.backoff(3, roll=lambda: 0.5) == 8 and network.backoff(20, roll=lambda: 0.5) == 60
    assert network.subject_is_valid("a.b") and not network.subject_is_valid("a b") and not network.subject_is_valid("")
    assert network.redact("nats://u:p@h:1/x") == "nats://u:***@h:1/x"


def test_avro(spark):
    schema = avro.from_json_value("R", {"b": "x", "a": 1, "l": []})
    assert [f["name"] for f in schema["fields"]] == ["a", "b", "l"] and schema["fields"][2]["type"][1]["items"] == ["null", "string"]
    assert avro.encode(schema, {"a": -3, "b": "hi"}) == bytes([2, 5, 2, 4]) + b"hi" + bytes([0])
    assert avro.encode("long", "x") == b"\x00" and avro.encode("boolean", True) == b"\x01"
    df = avro.encode_rows(spark.createDataFrame([('{"a":1}',), (None,)], "j string"), "j", schema, 7)
    first, second = (r.avro for r in df.collect())
    assert bytes(first[:5]) == b"\x00\x00\x00\x00\x07" and second is None
    reg = avro.Registry()
    assert reg.register("s", schema) == reg.register("s", schema) == 1 and avro.subject("topic", "t", "r") == "t-value"
    assert avro.envelope_schema("E", [ColumnInfo("id", "int")])["fields"][1]["type"] == ["null", "Value"]


def test_registry_edge_cases(spark):
    rows = [("_", "d", "t", h, "{}", k, k) for k, h in enumerate(["a", "b", "a"])]
    reg = registry.register(spark.createDataFrame(rows, "tenant string, db string, `table` string, hash string, schema_json string, registered_at long, attempt long"))
    assert registry.latest(reg).first().hash == "b"  # an old hash that comes again isn't the latest
    declared = spark.createDataFrame([("shop", "orders", "a"), ("shop", "orders", "zz")], "db string, `table` string, name string")
    assert {(r["name"], r["events"]) for r in registry.missing(make(spark, [(None, {"a": 1}), (None, {"b": 1})]), declared).collect()} == {("a", 1), ("zz", 2)}


def test_batches_keep_transactions(spark):
    rows = spark.createDataFrame([("k", i, 10, "t" if 2 <= i <= 5 else None) for i in range(8)], "k string, i int, size_bytes int, tx string")
    cut = {r.i: r.batch_no for r in batching.by_bytes(rows, ["k"], ["i"], tx="tx", max_events=3, max_bytes=1000).collect()}
    assert cut[2] == cut[3] == cut[4] == cut[5] and cut[6] == cut[5] + 1
    assert batching.by_bytes(rows.limit(0), ["k"], ["i"]).count() == 0


def test_progress(spark):
    sinks = spark.createDataFrame([("s", "a", "b.999999", 9), ("s", "b", "b.1000000", 1)], "source_id string, sink_id string, file string, pos long")
    assert progress.min_checkpoint(sinks).first().file == "b.999999"  # by number, not as text
    assert progress.removed_sinks(["a", "b"], ["b"]) == ["a"]
    one = spark.range(1).select(progress.compare(progress.lsn_order(F.lit("1/0")), progress.lsn_order(F.lit("0/FFFFFFFF"))), progress.compare(progress.lsn_order(F.lit("x")), progress.lsn_order(F.lit("1/0")))).first()
    assert tuple(one) == (1, 0)


def test_sensing():
    a, b = {"x": 1, "y": {"z": [1]}}, {"y": {"z": [5]}, "x": 2}
    assert sensing.fingerprint_of(a) == sensing.fingerprint_of(b) != sensing.fingerprint_of({"x": "1", "y": {"z": [1]}})
    schema = sensing.json_schema(sensing.infer([{"a": 1, "b": None}, {"a": 2}]))
    assert schema["required"] == ["a"] and schema["properties"]["b"] == {"type": "null"}
    assert sensing.json_schema(sensing.infer([1, "x"]))["oneOf"] == [{"type": "integer"}, {"type": "string"}]
    assert ("s.<*>.ts", "int") in sensing.walk({"s": {"sess_1": {"ts": 1}}}, "", stable={"s": []}) and ("l[]", "int") in sensing.walk({"l": [1]}, "")


def test_dynamic_keys(spark):
    df = spark.createDataFrame([('{"id":1,"s_1":2}',), ('{"id":5,"s_9":2,"s_8":1}',), ('{"id":1}',)], "j string")
    fps = [r[0] for r in df.select(sensing.adaptive_fingerprint(F.col("j"), ["id"])).collect()]
    assert fps[0] == fps[1] != fps[2]
    assert json.loads(df.select(sensing.normalise_keys(F.col("j"), ["id"])).first()[0]) == {"id": "1", "<dynamic>": "2"}
    full = [r[0] for r in df.select(sensing.fingerprint("j")).collect()]
    assert len(set(full)) == 3


def test_spec():
    assert spec.merge({"a": [1, {"b": 2}], "c": 1}, {"a": [5, {"d": 3}]}) == {"a": [5, {"b": 2, "d": 3}], "c": 1}
    assert spec.expand("${HOME} ${a.b} ${NOPE}", {"HOME": "h"}) == "h ${a.b} ${NOPE}"
    with pytest.raises(ValueError):
        spec.processor({"type": "nothing"})


def test_spec_chain(spark):
    steps = spec.chain([{"type": "filter", "ops": ["u"], "predicates": [{"path": "a.b", "kind": "gt", "value": 0}]}, {"type": "flatten"}, {"type": "function", "name": "f"}], {"f": lambda b: b})
    e = make(spark, [(None, {"a": {"b": 1}}), (None, {"a": {"b": -1}})])
    for s in steps:
        e = s(e)
    assert [json.loads(r.after) for r in e.collect()] == [{"a__b": 1}]


def test_dedup_and_current_state(spark):
    e = make(spark, [(None, {"id": 1})])
    assert dedup(e.unionByName(e)).count() == 1
    log = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 0), (2, "x", 5, 0), (2, "x", 6, 1)], "id int, v string, _version long, _deleted int")
    assert [tuple(r) for r in columnstore.current_state(log, ["id"]).select("id", "v").collect()] == [(1, "b")]
    assert columnstore.dedup_token("p", "s", log) == "p:s:1:4"


def test_pg_values_that_are_not_of_their_type(spark):
    cases = [(16, "TRUE", "true"), (16, "Off", "false"), (16, "maybe", '"maybe"'), (20, "+5", "5"), (20, "five", '"five"'), (701, "1.5e3", "1.5e3"), (701, ".5", "0.5"), (701, "-Infinity", "null"), (701, "x", '"x"'),
             (17, r"\x6869", '{"_base64":"aGk="}'), (17, "hello", '"hello"'), (17, r"\x6", r'"\\x6"'), (114, '{"a":[1]}', '{"a":[1]}'), (114, "{a", '"{a"'), (1700, "1.10", '"1.10"'), (16, None, "null")]
    rows = spark.createDataFrame(cases, "oid int, text string, want string")
    for r in rows.select("*", ingest.pg_json(F.col("oid"), F.col("text")).alias("got")).collect():
        assert r.got == r.want, r


def test_dead_letters_take_two_kinds_and_are_numbered(spark):
    e = events(spark.range(2000).withColumnRenamed("id", "n"), op=F.lit("c"), ts_ms=F.lit(0), event_id=F.lpad(F.col("n").cast("string"), 6, "0"), source=source_struct(db=F.lit("d")))
    text = F.element_at(F.array(*map(F.lit, ("connection: refused", "routing: no topic", "serialization: bad", "auth: no"))), (F.col("event_id").cast("int") % 4 + 1))
    got = dlq.entries(e.withColumn("error", text), "p", "s", F.lit(0), 10).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(11, 1011)) and [r.event_id for r in got] == sorted(r.event_id for r in got) and {r.error_kind for r in got} == {"routing", "serialization"}
    known = dlq.entries(e.withColumns({"error": F.lit("auth: wrong type"), "error_kind": F.lit("serialization")}), "p", "s", F.lit(0))
    assert known.count() == 2000


def test_dead_letter_queue_policies(spark):
    old, new = spark.range(1, 9).withColumnRenamed("id", "seq"), spark.range(9, 15).withColumnRenamed("id", "seq")
    ids = lambda df: sorted(r.seq for r in df.collect())
    assert [ids(x) for x in dlq.admit(old, new, 10)] == [list(range(5, 15)), [1, 2, 3, 4]]
    assert [ids(x) for x in dlq.admit(old, new, 10, "reject")] == [list(range(1, 11)), [11, 12, 13, 14]]
    with pytest.raises(dlq.QueueFull):
        dlq.admit(old, new, 10, "block")
    assert [ids(x) for x in dlq.admit(old, new, 14, "block")] == [list(range(1, 15)), []]


def test_row_numbers(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"), "id")
    got = row_numbers(rows.repartition(7), ["k"], ["v", "id"]).collect()
    for k in (0, 1):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.row_no)
        assert [r.row_no for r in mine] == list(range(2500)) and [(r.v is not None, r.v or 0, r.id) for r in mine] == sorted((r.v is not None, r.v or 0, r.id) for r in mine)
    assert row_numbers(rows.limit(0), [], ["id"]).count() == 0


def test_delivery_sends_once(spark, tmp_path):
    sent = str(tmp_path / "sent")
    os.mkdir(sent)

    class Counting:
        """Leaves a byte for each message, and refuses a quarter of them."""

        def send(self, messages):
            for m in messages:
                with open(f"{sent}/{os.getpid()}", "a") as f:
                    f.write("x")
                if int(m["event_id"]) % 4 == 0:
                    raise network.DeliveryError("permanent", "refused")

        def close(self):
            pass

    rows = spark.createDataFrame([(str(i), None if i % 2 else "k", "t", "{}") for i in range(40)], "event_id string, key string, topic string, value string")
    failed = network.deliver(rows, Counting, batch_size=1)
    assert failed.count() == 10 == len(failed.collect()) and sum(os.path.getsize(f"{sent}/{f}") for f in os.listdir(sent)) == 40


def test_retries_go_on():
    class Flaky:
        left, sent = 9, []

        def send(self, messages):
            if self.left:
                self.left -= 1
                raise network.DeliveryError("retry", "busy") if self.left % 2 else OSError("reset")
            self.sent += messages

    client, pauses = Flaky(), []
    network.Retrying(client, pauses.append).send([{"a": 1}])
    assert client.sent == [{"a": 1}] and len(pauses) == 9
    refused = type("Refused", (), {"send": lambda self, m: (_ for _ in ()).throw(network.DeliveryError("permanent", "no"))})()
    with pytest.raises(network.DeliveryError):
        network.Retrying(refused, pauses.append).send([])


def test_avro_round_trip():
    schema = avro.envelope_schema("E", [ColumnInfo("k", "bigint"), ColumnInfo("p", "double"), ColumnInfo("b", "boolean")])
    value = {"after": {"k": -5, "p": 2.5, "b": True}, "op": "c", "ts_ms": 1, "source": {"db": "d"}}
    back, end = avro.decode(schema, memoryview(data := avro.encode(schema, value)))
    assert end == len(data) and back["after"] == value["after"] and back["before"] is None and back["source"]["db"] == "d"
    many = {"type": "map", "values": ["null", {"type": "array", "items": ["null", "long"]}]}
    assert avro.decode(many, memoryview(avro.encode(many, {"a": [1, None], "b": None, "c": []})))[0] == {"a": [1, None], "b": None, "c": []}


def test_evolution_across_ranges(spark):
    rows = [(k, i, "abc"[(i // 7 + i // 50) % 3] if i % 11 else None) for k in ("x", "y") for i in range(600)]
    got = sensing.evolution(spark.createDataFrame(rows, "k string, i int, fp string").repartition(5), ["k"], ["i"], "fp").collect()
    for k in ("x", "y"):
        want, last, n = [], object(), 0
        for _, _, fp in [r for r in rows if r[0] == k]:
            n, last = n + (fp != last), fp
            want.append(n)
        assert [r.schema_sequence for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == want


def test_batch_function_of_some_columns(spark):
    e = make(spark, [(None, {"v": k}) for k in range(10)])

    def change(batch):
        assert all(set(r) == {"after", "op", "_row"} for r in batch)
        kept = [r | {"after": json.dumps({"v": -json.loads(r["after"])["v"]})} for r in batch if json.loads(r["after"])["v"] % 2]
        return kept + [{"after": '{"v":100}', "op": "c"}]

    whole = {r.after: r for r in process_batch(e.coalesce(1), change, columns=("after", "op")).collect()}
    assert set(whole) == {'{"v": -1}', '{"v": -3}', '{"v": -5}', '{"v": -7}', '{"v": -9}', '{"v":100}'}
    assert whole['{"v": -3}'].event_id == "3" and whole['{"v": -3}'].source.db == "shop" and whole['{"v":100}'].event_id is None and whole['{"v":100}'].source is None


@pytest.mark.parametrize("value", [{"b": {"z": 1, "a": {}}, "a": [1, {"x": 2}], "b__z": 3, "c": {"d": {"e": None}}, "n": 1.5, "t": "é"}, [1], "x", {}, {"": {"": 1}}])
def test_flatten_without_options_is_the_general_one(value):
    from rowtide.operators.flatten import _plain

    assert _plain(value, "__") == flatten_value(value, FlattenOptions()) and (not isinstance(value, dict) or list(_plain(value, "__")) == list(flatten_value(value, FlattenOptions())))


def test_drift_deals_no_table_to_one_task(spark):
    """Whatever its size, the declared side goes to the events: dealt by table, a table's events would be one task's."""
    declared = spark.createDataFrame([("d", "t", "a", "int", False), ("d", "t", "b", "varchar(9)", True)], "db string, `table` string, name string, data_type string, nullable boolean")
    rows = spark.createDataFrame([("t", '{"a":1,"b":"x"}'), ("t", '{"a":"y","b":2.5}'), ("t", '{"a":null}'), ("t", None), ("other", '{"a":[]}')], "t string, body string")
    e = events(rows, after=F.col("body"), op=F.lit("c"), source=source_struct(db=F.lit("d"), table=F.col("t")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = drift.column_stats(e, declared)
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = {r.name: r for r in stats.collect()}
        drifts = {(r.name, r.seen): (r.n, r.samples) for r in drift.drift_events(e, declared).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(got[c].total, got[c].nulls, got[c].n_types, got[c].mismatches, got[c].dominant_type) for c in "ab"] == [(3, 1, 2, 1, "integer"), (3, 1, 2, 1, "number")]
    assert drifts == {("a", "string"): (1, ['"y"']), ("b", "number"): (1, ["2.5"])}


def test_outbox_looks_up_each_value_once(spark):
    """However many columns are made of the routing, each of the five keys and the payload is looked up once a row."""
    e = make(spark, [(None, {"topic": "t", "aggregate_type": "A", "aggregate_id": "1", "event_type": "E", "id": 7, "payload": {"x": 1}})], schema="__outbox", op="c")
    out = outbox(e, OutboxOptions(strict=True)).where("routing is not null")
    h = [F.try_element_at("routing.headers", F.lit(n)).alias(n) for n in ("df-aggregate-type", "df-event-type", "df-event-id")]
    made = out.select("routing.topic", "routing.key", "after", *h)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("variant_get(") == 6
    assert tuple(made.first()) == ("t", "1", '{"x":1}', "A", "E", "7")
