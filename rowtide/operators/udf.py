"""User code over batches of events, routing, and marks on events that processors made."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import ROUTING


#: Where an event's other columns are, in the dictionaries of a function that reads some columns only.
ROW = "_row"


def process_batch(events: DataFrame, user: Callable[[list[dict[str, Any]]], Any], batch_size: int = 2_000, columns: Sequence[str] | None = None) -> DataFrame:
    """`user` gets a list of event dictionaries. A list replaces the batch, a dictionary stands for one event, None means that the
    given (perhaps changed) list goes on; anything else, or an exception, fails the job. Numbers stay as they are.

    With `columns` the dictionaries have these only, so that the others needn't become Python objects: they go with the event, by its `_row`,
    and are null for events that the function makes anew. What it returns beyond these columns is ignored.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema])  # the function may leave out any column
    arrow = to_arrow_schema(schema)
    some = list(columns) if columns is not None else None

    def rejoined(part: pa.RecordBatch, rows: list[dict[str, Any]]) -> pa.RecordBatch:
        at = pa.array([r.get(ROW) for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) if f.name in some else part.column(f.name).take(at).cast(f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                given = (part if some is None else part.select(some)).to_pylist(maps_as_pydicts="strict")
                for k, e in enumerate(given if some is not None else ()):
                    e[ROW] = k
                made = user(given)
                rows = given if made is None else [made] if isinstance(made, dict) else made
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                    raise TypeError(f"the batch function returned {type(made).__name__}, not events")
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], arrow) if some is None else rejoined(part, rows)

    return events.mapInArrow(run, schema)


def route(event: dict[str, Any], topic: str | None = None, key: str | None = None, headers: dict[str, str] | None = None, raw_payload: bool | None = None) -> dict[str, Any]:
    """Sets parts of an event's routing; parts that aren't given stay."""
    old = event.get("routing") or {}
    event["routing"] = {
        "topic": topic if topic is not None else old.get("topic"), "key": key if key is not None else old.get("key"),
        "headers": {**(old.get("headers") or {}), **(headers or {})} or None, "raw_payload": raw_payload if raw_payload is not None else old.get("raw_payload"),
    }
    return event


def route_all(events: DataFrame, topic=None, key=None, headers: dict | None = None) -> DataFrame:
    """The same for whole columns: expressions for topic and key, header expressions by name."""
    old = F.col("routing")
    more = F.create_map(*(x for n, v in (headers or {}).items() for x in (F.lit(n), v))) if headers else None
    merged = old["headers"] if more is None else F.when(old["headers"].isNull(), more).otherwise(F.map_concat(F.map_filter(old["headers"], lambda k, _: ~k.isin(*headers)), more))
    return events.withColumn("routing", F.struct(F.coalesce(topic, old["topic"]) if topic is not None else old["topic"], F.coalesce(key, old["key"]) if key is not None else old["key"], merged, old["raw_payload"]).cast(ROUTING))


def mark_synthetic(before: DataFrame, after: DataFrame, processor: str) -> DataFrame:
    """Events of `after` whose id isn't among those of `before` are the processor's own, unless one already claimed them.

    A processor that is one expression over the same rows doesn't need this; it serves those that make rows.
    """
    ids = before.select(F.col("event_id").alias("_id")).where("_id is not null").distinct().withColumn("_old", F.lit(True))
    joined = after.join(ids, F.col("event_id") == F.col("_id"), "left")
    return joined.withColumn("synthetic", F.coalesce("synthetic", F.when(F.col("_old").isNull(), processor))).drop("_id", "_old")
