"""Stateful schema sensor per table: NewSchema, Evolved, Unchanged, CacheHit, Sampled, Stabilized.

State is a table's fingerprint, sequence, event count and a bounded set of known top-level structures. Needs the RocksDB state store provider.

A table's events of a micro-batch are a sequential fold, so one task, in bounded memory: they are sorted in runs on the executor's disk, and merged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter
from typing import IO, Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sensing import fingerprint_of

RESULT = "tbl string, event_id string, outcome string, fingerprint string, schema_sequence long, event_count long"
_STATE = "fingerprint string, sequence long, count long, unchanged long, known string"

#: Bytes of rows in memory while a run is sorted, runs that are merged at once, bytes of a block of each, and what a row takes besides its texts.
RUN_BYTES, FAN_IN, BLOCK_BYTES, ROW_BYTES, EVENT_BYTES = 128 << 20, 64, 1 << 20, 400, 4_000


@dataclass(frozen=True)
class SensorOptions:
    enabled: bool = True
    warm_up: int = 1_000  #: events that are all observed
    every: int = 10  #: after that, one in so many
    stabilise_at: int = 1_000  #: observations without a change
    cache: int = 0  #: top-level structures that are kept to be passed over; 0: none


@dataclass
class SensorState:
    fingerprint: str | None = None
    sequence: int = 0
    count: int = 0
    unchanged: int = 0
    known: tuple[str, ...] = ()


def observe(state: SensorState, text: str | None, options: SensorOptions) -> str:
    """One event: changes the state and says what came of it."""
    if not options.enabled:
        return "Disabled"
    state.count += 1
    if state.unchanged >= options.stabilise_at:
        return "Stabilized"
    value = None
    if options.cache:
        value = json.loads(text) if text is not None else None
        top = top_structure(value)
        if top in state.known:
            state.unchanged += 1
            return "CacheHit"
        if len(state.known) < options.cache:  # a full cache takes no more until the schema changes
            state.known = (*state.known, top)
    if state.count > options.warm_up and (state.count - options.warm_up) % options.every:
        return "Sampled"
    if not options.cache:
        value = json.loads(text) if text is not None else None
    fp = fingerprint_of(value)
    if state.fingerprint is None:
        state.fingerprint, state.sequence = fp, 1
        return "NewSchema"
    if fp == state.fingerprint:
        state.unchanged += 1
        return "Unchanged"
    state.fingerprint, state.sequence, state.unchanged, state.known = fp, state.sequence + 1, 0, ()
    return "Evolved"


_KIND = {type(None): "null", bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def top_structure(value: Any) -> str:
    """The kinds of an object's values by key, not going deeper."""
    if not isinstance(value, dict):
        return _KIND[type(value)]
    return _digest(tuple((k, _KIND[type(value[k])]) for k in sorted(value)))


@lru_cache(maxsize=1_000)
def _digest(kinds: tuple[tuple[str, str], ...]) -> str:
    return hashlib.sha256(json.dumps(kinds).encode()).hexdigest()[:16]


#: What is sorted: (key, bytes, ...).
Row = tuple


def _blocks(rows: Iterable[Row], size: int) -> Iterator[list[Row]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += row[1]
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _spilled(rows: Iterable[Row]) -> IO[bytes]:
    f = tempfile.TemporaryFile()
    for block in _blocks(rows, BLOCK_BYTES):
        data = pickle.dumps(block, pickle.HIGHEST_PROTOCOL)
        pickle.dump((len(data), pa.compress(data, codec="lz4", asbytes=True)), f)
    f.seek(0)
    return f


def _read(f: IO[bytes]) -> Iterator[Row]:
    with f:
        while True:
            try:
                n, data = pickle.load(f)
            except EOFError:
                return
            yield from pickle.loads(pa.decompress(data, decompressed_size=n, codec="lz4", asbytes=True))


def in_order(rows: Iterable[Row]) -> Iterator[Row]:
    """Rows by their keys, those of equal keys as they came. More than a run's bytes go to disk in sorted runs."""
    first = itemgetter(0)
    levels: list[list[IO[bytes]]] = []
    last: list[Row] = []
    for run in _blocks(rows, RUN_BYTES):
        if last:
            _add(levels, _spilled(last))
        last = run
        last.sort(key=first)
    yield from heapq.merge(*(_read(f) for level in reversed(levels) for f in level), last, key=first) if levels else last


def _add(levels: list[list[IO[bytes]]], run: IO[bytes], n: int = 0) -> None:
    """Keeps less than FAN_IN runs of each level; as many make one of the next."""
    if n == len(levels):
        levels.append([])
    levels[n].append(run)
    if len(levels[n]) == FAN_IN:
        full, levels[n] = levels[n], []
        _add(levels, _spilled(heapq.merge(*map(_read, full), key=itemgetter(0))), n + 1)


class Sensor(StatefulProcessor):
    def __init__(self, options: SensorOptions, keep: bool = False) -> None:
        self.options, self.keep = options, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("table", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = SensorState()
        if self.state.exists():
            f, s, c, u, k = self.state.get()
            held = SensorState(f, s, c, u, tuple(json.loads(k)))
        names = [c.split()[0] for c in RESULT.split(", ")] + ["event"] * self.keep
        for block in _blocks(in_order(self._rows(rows)), BLOCK_BYTES):
            out = []
            for _, _, event_id, text, *event in block:
                outcome = observe(held, text, self.options)
                out.append((key[0], event_id, outcome, held.fingerprint, held.sequence, held.count, *event))
            yield pd.DataFrame(out, columns=names)
        self.state.update((held.fingerprint, held.sequence, held.count, held.unchanged, json.dumps(held.known)))

    def _rows(self, parts: Iterator[pd.DataFrame]) -> Iterator[Row]:
        """(key, bytes, event_id, after, event if it is kept); no time and no id are last."""
        base = EVENT_BYTES if self.keep else ROW_BYTES
        for part in parts:  # of one table in one micro-batch; they come in no order
            texts = [t if isinstance(t, str) else None for t in part["after"]]
            ids = [i if isinstance(i, str) else None for i in part["event_id"]]
            for ts, i, text, *event in zip(part["ts_ms"], ids, texts, *([part["event"]] if self.keep else [])):
                late = ts is None or ts != ts
                yield (late, 0 if late else ts, i is None, i or ""), base + 3 * len(text or ""), i, text, *event

    def close(self) -> None:
        pass


def sense(events: DataFrame, options: SensorOptions = SensorOptions()) -> DataFrame:
    """Outcomes for a stream of events; within a micro-batch and table in the order of time and id."""
    rows = events.selectExpr("concat_ws('.', source.db, source.table) AS tbl", "event_id", "ts_ms", "after")
    return rows.groupBy("tbl").transformWithStateInPandas(statefulProcessor=Sensor(options), outputStructType=RESULT, outputMode="Append", timeMode="None")


def enrich(events: DataFrame, options: SensorOptions = SensorOptions()) -> DataFrame:
    """The stream's events with schema_version (the fingerprint) and schema_sequence of their table as sensed; other columns stay."""
    whole = events.select(F.concat_ws(".", "source.db", "source.table").alias("tbl"), "event_id", "ts_ms", "after", F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("event"))
    kind = events.schema.simpleString()
    found = whole.groupBy("tbl").transformWithStateInPandas(statefulProcessor=Sensor(options, keep=True), outputStructType=f"{RESULT}, event {kind}", outputMode="Append", timeMode="None")
    out = found.select("event.*", F.col("fingerprint").alias("_fingerprint"), F.col("schema_sequence").alias("_sequence"))
    sensed = {"schema_version": F.col("_fingerprint"), "schema_sequence": F.col("_sequence")}
    return out.select(*(sensed.get(c, F.col(f"`{c}`")).alias(c) for c in events.columns))
