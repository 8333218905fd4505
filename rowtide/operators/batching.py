"""Batches and files: cuts by count and bytes, rolling, lag."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import row_numbers

#: Default limits of a batch and of a file.
MAX_EVENTS, MAX_BYTES = 2_000, 16 << 20
ROLL_EVENTS, ROLL_BYTES, ROLL_AGE_MS, ROLL_IDLE_MS = 1_000_000, 256 << 20, 300_000, 60_000


def by_count(events: DataFrame, key: list[str], order: list[str], n: int = MAX_EVENTS) -> DataFrame:
    """`batch_no` of each event within its key, n events to a batch."""
    numbered = row_numbers(events, key, order, "_row_no")
    return numbered.select(*(F.col(f"`{c}`") for c in events.columns), F.floor(F.col("_row_no") / n).alias("batch_no"))


def _cut(key: list[str], size: str, tx: str | None, max_events: int, max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n, held, last_tx = None, 0, 0, 0, None
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key)))
            sizes = batch.column(batch.schema.get_field_index(size)).to_pylist()
            txs = batch.column(batch.schema.get_field_index(tx)).to_pylist() if tx else [None] * batch.num_rows
            for k, b, t in zip(keys, sizes, txs):
                if k != now:
                    now, number, n, held, last_tx = k, 0, 0, 0, None
                same_tx = tx is not None and t is not None and t == last_tx
                if n and not same_tx and (n >= max_events or held + (b or 0) > max_bytes):
                    number, n, held = number + 1, 0, 0
                n, held, last_tx = n + 1, held + (b or 0), t
                out.append(number)
            yield batch.append_column("batch_no", pa.array(out, pa.int64()))

    return run


def by_bytes(events: DataFrame, key: list[str], order: list[str], size: str = "size_bytes", tx: str | None = None, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`batch_no` by a greedy fold in order: a batch is full at max_events, or when the next event would exceed max_bytes. With `tx`, a transaction is never cut.

    Streams sorted partitions, so a key may be of any size.
    """
    rows = events.repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_no", T.LongType())])
    return rows.mapInArrow(_cut(key, size, tx, max_events, max_bytes), schema)


def _roll(key: list[str], size: str, ts: str, most: tuple[int, int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        max_events, max_bytes, max_age, idle = most
        now, number, n, held, opened, last = None, 0, 0, 0, 0, 0
        for batch in batches:
            out = []
            keys, (sizes, times) = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key)), (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (size, ts))
            for k, b, t in zip(keys, sizes, times):
                b, t = b or 0, last if t is None else t
                if k != now:
                    now, number, n, held, opened = k, 0, 0, 0, t
                elif n >= max_events or held + b > max_bytes or t - opened >= max_age or t - last >= idle:
                    number, n, held, opened = number + 1, 0, 0, t
                n, held, last = n + 1, held + b, t
                out.append(number)
            yield batch.append_column("file_no", pa.array(out, pa.int64()))

    return run


def roll_files(
    events: DataFrame, key: list[str], order: list[str], size: str = "size_bytes", ts: str = "ts_ms", max_events: int = ROLL_EVENTS, max_bytes: int = ROLL_BYTES, max_age_ms: int = ROLL_AGE_MS, idle_ms: int = ROLL_IDLE_MS
) -> DataFrame:
    """`file_no` by a fold in order: a key's file ends when it is full by events or bytes, when it was opened max_age_ms ago, or after idle_ms without an event.

    Streams sorted partitions, so a key may be of any size; the fold is sequential, so a key is one task.
    """
    rows = events.repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("file_no", T.LongType())])
    return rows.mapInArrow(_roll(key, size, ts, (max_events, max_bytes, max_age_ms, idle_ms)), schema)


def table_lag(events: DataFrame, now_ms: Column) -> DataFrame:
    """By table: events, bytes, and the lag of the latest event (not negative)."""
    latest = F.max_by("ts_ms", F.struct("ts_ms", "event_id"))
    return events.groupBy(F.col("source.db").alias("db"), F.col("source.table").alias("table")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("size_bytes").alias("bytes"), F.greatest(now_ms - latest, F.lit(0)).cast("bigint").alias("lag_ms")
    )
