"""Pipelines and the sensor on file streams."""

import json
import random
import time
import weakref

import pandas as pd
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from rowtide.operators.filter import EventFilter
from rowtide.schema import EVENT_SCHEMA, dedup, events, source_struct
from rowtide.sources.ingest import read_event_stream
from rowtide.streaming.pipeline import CommitError, Manager, Pipeline, Progress, SharedProgress, Sink
from rowtide.streaming import sensor
from rowtide.streaming.sensor import Sensor, SensorOptions, SensorState, enrich, observe, sense


def write(spark, path, rows, mode="append"):
    df = spark.createDataFrame(rows, "id long, body string, op string")
    events(df, after=F.col("body"), op=F.col("op"), ts_ms=F.col("id") + 1_700_000_000_000, event_id=F.lpad(F.col("id").cast("string"), 6, "0"), source=source_struct(db=F.lit("d"), table=F.lit("t"))).coalesce(1).write.mode(mode).parquet(path)


def test_pipeline_progress_and_policy(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [(i, "{}", "c" if i % 2 else "u") for i in range(10)])
    broken = {"on": True}

    def flaky(df, batch):
        if broken["on"]:
            raise OSError("down")

    sinks = [Sink("files", lambda df, n: df.select("event_id").write.mode("append").parquet(out)), Sink("flaky", flaky, required=True)]
    p = Pipeline("p", [EventFilter(ops=("c",))], sinks, Progress(str(tmp_path / "progress.json")))
    m = Manager(str(tmp_path / "ckpt"))
    with pytest.raises(Exception, match="policy required"):
        m.start(p, lambda: read_event_stream(spark, src)).awaitTermination()
    assert issubclass(CommitError, Exception)
    broken["on"] = False
    p.sinks[1].required = False
    m.start(p, lambda: read_event_stream(spark, src)).awaitTermination()
    assert spark.read.parquet(out).count() in (5, 10)  # at least once: the first try wrote, but wasn't committed
    assert Progress(str(tmp_path / "progress.json")).last("p", "files") == 0
    before = spark.read.parquet(out).count()
    write(spark, src, [(20, "{}", "c")])
    m.resume("p").awaitTermination()
    assert spark.read.parquet(out).count() == before + 1 and m.status() == {"p": "paused"}
    m.stop("p")
    assert m.status() == {}


def test_dead_letters(spark, tmp_path):
    seen = []
    sink = Sink("s", lambda df, n: df.where("op = 'u'").withColumn("error", F.lit("x")))
    p = Pipeline("p", [], [sink], Progress(str(tmp_path / "p.json")), dead_letters=lambda bad, sid, n: seen.append((sid, bad.count())))
    df = spark.createDataFrame([], EVENT_SCHEMA)
    src = str(tmp_path / "in")
    write(spark, src, [(1, "{}", "u"), (2, "{}", "c")])
    assert p.run_batch(df.unionByName(spark.read.schema(EVENT_SCHEMA).parquet(src)), 0) == {"s": True} and seen == [("s", 1)]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(i, json.dumps({"v": i}), "c") for i in range(5)])
    write(spark, src, [(i, json.dumps({"v": i}), "c") for i in range(3, 8)])
    stream = read_event_stream(spark, src, max_files=1).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "1 hour")
    q = dedup(stream, "at").select("event_id").writeStream.format("memory").queryName("deduped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("deduped").collect()) == sorted(r[0] for r in dedup(spark.read.schema(EVENT_SCHEMA).parquet(src)).select("event_id").collect())


def test_sensor_rules():
    o = SensorOptions(warm_up=3, every=2, stabilise_at=100)
    s = SensorState()
    got = [observe(s, t, o) for t in ('{"a":1}', '{"a":2}', '{"a":"x"}', '{"a":"y"}', '{"a":"z"}', '{"b":1}')]
    assert got == ["NewSchema", "Unchanged", "Evolved", "Sampled", "Unchanged", "Sampled"] and s.sequence == 2 and s.count == 6
    assert observe(SensorState(unchanged=100), "{}", o) == "Stabilized" and observe(s, "{}", SensorOptions(enabled=False)) == "Disabled"


def test_sensor_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, '{"a":1}', "c"), (2, '{"a":2}', "c"), (3, '{"a":"x"}', "c")])
    q = sense(read_event_stream(spark, src)).writeStream.format("memory").queryName("sensed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("sensed").orderBy("event_id").collect()
    assert [r.outcome for r in rows] == ["NewSchema", "Unchanged", "Evolved"] and [r.schema_sequence for r in rows] == [1, 1, 2]


def test_deadline_of_a_sink(spark, tmp_path):
    done = []
    sinks = [Sink("quick", lambda df, n: done.append(df.count()) and None), Sink("hung", lambda df, n: time.sleep(30), required=False, deadline_s=0.5)]
    p = Pipeline("p", [], sinks, SharedProgress(spark, str(tmp_path / "p.json")))
    write(spark, str(tmp_path / "in"), [(1, "{}", "u"), (2, "{}", "c")])
    began = time.monotonic()
    assert p.run_batch(spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in")), 0) == {"quick": True, "hung": False}
    assert time.monotonic() - began < 15 and done == [2]
    again = SharedProgress(spark, str(tmp_path / "p.json"))
    assert again.last("p", "quick") == 0 and again.last("p", "hung") == -1
    again.commit("p", "hung", 4)
    assert SharedProgress(spark, str(tmp_path / "p.json")).held == {"p/quick": 0, "p/hung": 4}


def test_structure_cache():
    o = SensorOptions(cache=2)
    s = SensorState()
    texts = ('{"a":1}', '{"a":2}', '{"a":2.5}', '{"a":"x"}', '{"a":"y"}', '{"a":"z"}', '{"a":{"b":1}}', '{"a":{"b":2}}', '{"a":{"b":"deep"}}')
    got = [observe(s, t, o) for t in texts]
    # a change empties the cache, so the next event of the new structure is looked at again; a change below the top level is passed over
    assert got == ["NewSchema", "CacheHit", "CacheHit", "Evolved", "Unchanged", "CacheHit", "Evolved", "Unchanged", "CacheHit"] and s.sequence == 3
    full = SensorState()
    for k in range(4):
        observe(full, json.dumps({f"k{k}": 1}), SensorOptions(cache=2))
    assert len(full.known) <= 2


def test_events_with_what_was_sensed(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, '{"a":1}', "c"), (2, '{"a":2}', "c"), (3, '{"a":"x"}', "c")])
    q = enrich(read_event_stream(spark, src)).writeStream.format("memory").queryName("enriched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("enriched").orderBy("event_id").collect()
    assert [r.schema_sequence for r in rows] == [1, 1, 2] and rows[0].schema_version == rows[1].schema_version != rows[2].schema_version
    assert [r.after for r in rows] == ['{"a":1}', '{"a":2}', '{"a":"x"}'] and rows[0].source.db == "d"


class State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_sensor_sorts_a_large_batch_in_runs(monkeypatch):
    """More rows than a run holds, in no order, some without a time or an id: in order, in blocks, and never all in memory."""
    for name, value in {"RUN_BYTES": 50_000, "BLOCK_BYTES": 5_000, "FAN_IN": 3}.items():
        monkeypatch.setattr(sensor, name, value, raising=False)
    rows = [(i // 3, f"{i:05d}", '{"a":1}' if i // 7 % 2 else '{"a":"x"}') for i in range(4_000)] + [(None, "a", "{}"), (None, "b", '{"c":1}'), (5_000, None, '{"d":1}')]
    want, state, given = [], SensorState(), 0
    for _, i, text in [*rows[:4_000], rows[4_002], *rows[4_000:4_002]]:
        want.append((i, observe(state, text, SensorOptions()), state.sequence, state.count))
    mixed = random.Random(1).sample(rows, len(rows))
    alive, most = weakref.WeakSet(), 0

    def parts():
        nonlocal most
        for at in range(0, len(mixed), 100):
            part = pd.DataFrame(mixed[at : at + 100], columns=["ts_ms", "event_id", "after"])
            alive.add(part._mgr if hasattr(type(part._mgr), "__weakref__") else part)
            most = max(most, len(alive))
            yield part

    s = Sensor(SensorOptions())
    s.state = State()
    blocks = list(s.handleInputRows(("t",), parts(), None))
    found = pd.concat(blocks)
    assert [(None if pd.isna(i) else i, *r) for i, *r in found[["event_id", "outcome", "schema_sequence", "event_count"]].itertuples(index=False)] == want
    assert len(blocks) > 20 and most <= 3 and s.state.value[1:3] == (state.sequence, state.count)


def test_a_batch_is_held_compressed(spark, tmp_path):
    """A block is read whole by a sink's task: serialized blocks are compressed, others aren't."""
    levels = []
    write(spark, str(tmp_path / "in"), [(i, "{}", "c") for i in range(10)])
    p = Pipeline("p", [], [Sink("s", lambda df, n: levels.append(df.storageLevel) or df.where("false"))], Progress(str(tmp_path / "p.json")))
    p.run_batch(spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in")), 0)
    assert levels == [StorageLevel.MEMORY_AND_DISK]
