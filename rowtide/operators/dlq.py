"""Dead-letter entries: a table of (seq, timestamp_ms, pipeline, stream, event_id, cursor, error_kind, error, event, payload_truncated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import row_numbers

#: Limits of the queue, and shares of capacity that raise a warning and an alarm.
CAPACITY, PEEK, MAX_PEEK, MAX_PAYLOAD, MAX_AGE_MS = 10_000, 50, 1_000, 256 * 1024, 7 * 86_400_000
WARN_AT, ALARM_AT = 0.80, 0.95
ELIGIBLE = ("serialization", "routing")


def truncate_payload(before: Column, after: Column, limit: int = MAX_PAYLOAD) -> tuple[Column, Column, Column]:
    """Both images replaced by a note if the event is too large; and whether it was."""
    large = F.coalesce(F.octet_length(before), F.lit(0)) + F.coalesce(F.octet_length(after), F.lit(0)) > limit
    note = F.lit('{"_truncated":true}')
    return F.when(large & before.isNotNull(), note).otherwise(before), F.when(large & after.isNotNull(), note).otherwise(after), large


def entries(bad: DataFrame, pipeline: str, stream: str, now_ms: Column, start_seq: int = 0) -> DataFrame:
    """Journal rows from failed events (columns error and, if it is known, error_kind); only serialization and routing errors go there.

    Without an error_kind column the kind is the error's text up to its first colon. Numbers are dense within a batch: bad
    rows of one micro-batch, in the order of their event ids.
    """
    kind = F.col("error_kind") if "error_kind" in bad.columns else F.split_part(F.col("error"), F.lit(":"), F.lit(1))
    bad = row_numbers(bad.withColumn("_kind", kind).where(F.col("_kind").isin(*ELIGIBLE)), [], ["event_id"], "_seq")
    before, after, large = truncate_payload(F.col("before"), F.col("after"))
    seq = F.col("_seq") + F.lit(start_seq + 1)
    return bad.select(
        seq.cast("bigint").alias("seq"), now_ms.cast("bigint").alias("timestamp_ms"), F.lit(pipeline).alias("pipeline"), F.lit(stream).alias("stream"), "event_id", F.to_json("source").alias("cursor"),
        F.col("_kind").alias("error_kind"), F.col("error"), F.struct(before.alias("before"), after.alias("after"), "op").alias("event"), large.alias("payload_truncated"),
    )


def peek(journal: DataFrame, limit: int = PEEK, where: Column | None = None) -> DataFrame:
    """The oldest entries; a filter applies to those, not before."""
    head = journal.orderBy("seq").limit(min(limit, MAX_PEEK))
    return head if where is None else head.where(where)


def drop_oldest(journal: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest entries up to the capacity. The cut is found by a bounded top-n, so that no task sorts the whole journal."""
    cut = journal.select("seq").orderBy(F.desc("seq")).limit(capacity).agg(F.min("seq").alias("cut"))
    return journal.join(F.broadcast(cut), F.col("seq") >= F.col("cut")).drop("cut")


class QueueFull(Exception):
    """The queue has no room and its policy is to block: the batch comes again when entries have been acknowledged."""


def admit(journal: DataFrame, new: DataFrame, capacity: int = CAPACITY, policy: str = "drop_oldest") -> tuple[DataFrame, DataFrame]:
    """(the queue with the new entries, those that aren't in it). What is too much goes by the policy: the oldest entries (drop_oldest), the
    newest of the new ones (reject), or nothing, as QueueFull is raised (block)."""
    room = capacity - journal.count()
    if policy == "drop_oldest":
        both = journal.unionByName(new)
        kept = drop_oldest(both, capacity)
        return kept, both.join(kept.select("seq"), "seq", "left_anti")
    fits = new.orderBy("seq").limit(max(0, room))
    away = new.join(fits.select("seq"), "seq", "left_anti")
    if policy == "block" and not away.isEmpty():
        raise QueueFull(f"{max(0, room)} of {capacity} entries are free")
    if policy not in ("reject", "block"):
        raise ValueError(f"{policy!r} is none of drop_oldest, reject, block")
    return journal.unionByName(fits), away


def acknowledge(journal: DataFrame, up_to: int) -> DataFrame:
    return journal.where(F.col("seq") > up_to)


def expire(journal: DataFrame, now_ms: int, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    return journal.where(F.col("timestamp_ms") >= now_ms - max_age_ms)


def saturation(journal: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    n = journal.agg(F.count(F.lit(1)).alias("entries"))
    ratio = F.col("entries") / capacity
    return n.select("entries", ratio.alias("saturation"), F.when(ratio >= ALARM_AT, "alarm").when(ratio >= WARN_AT, "warn").otherwise("ok").alias("state"))
