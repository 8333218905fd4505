"""Sink progress: checkpoints, commit policies, and what a restart has to redo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import lsn_number


def binlog_order(file: Column, pos: Column) -> Column:
    """Sortable position: the file's numeric suffix, then the offset."""
    return F.struct(F.regexp_extract(file, r"\.(\d+)$", 1).try_cast("bigint").alias("file_no"), pos.cast("bigint").alias("pos"))


def lsn_order(lsn: Column) -> Column:
    return lsn_number(lsn)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; what can't be read is equal."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def min_checkpoint(checkpoints: DataFrame, source: str = "source_id") -> DataFrame:
    """By source the least position over its sinks (source_id, sink_id, file, pos): a restart begins there."""
    order = binlog_order(F.col("file"), F.col("pos"))
    return checkpoints.groupBy(source).agg(F.min_by(F.struct("file", "pos"), order).alias("at"), F.count(F.lit(1)).alias("sinks")).select(source, "at.file", "at.pos", "sinks")


def reachable(checkpoints: DataFrame, logs: DataFrame, source: str = "source_id", file: str = "file") -> DataFrame:
    """Checkpoints (source_id, file) with whether the source still has that log file (logs: source_id, file). A source that lists none isn't judged."""
    listed = logs.groupBy(source).agg(F.count(F.lit(1)).alias("_listed"))
    there = logs.select(source, file).distinct().withColumn("_there", F.lit(True))
    out = checkpoints.join(listed, source, "left").join(there, [source, file], "left")
    return out.withColumn("reachable", F.col("_listed").isNull() | F.col("_there").isNotNull()).drop("_listed", "_there")


def committed(acks: DataFrame, policy: str, quorum: int | None = None) -> DataFrame:
    """By batch whether it may be committed (batch_id, sink_id, required, acked). all: every sink; required: every required one; quorum: so many."""
    ok = F.count_if("acked")
    test = {"all": ok == F.count(F.lit(1)), "required": F.count_if(F.col("required") & ~F.col("acked")) == 0, "quorum": ok >= F.lit(quorum if quorum is not None else 1)}[policy]
    return acks.groupBy("batch_id").agg(ok.alias("acks"), test.alias("committed"))


def unfinished(tables: DataFrame, done: DataFrame, on: tuple[str, ...] = ("db", "table")) -> DataFrame:
    """Tables that a snapshot still has to read."""
    return tables.join(done.select(*on).distinct(), list(on), "left_anti")


def removed_sinks(old: list[str], new: list[str]) -> list[str]:
    return sorted(set(old) - set(new))


def gtid_merge(sets: DataFrame, uuid: str = "uuid", first: str = "first", last: str = "last") -> DataFrame:
    """By server the merged interval of executed transactions."""
    return sets.groupBy(uuid).agg(F.min(first).alias(first), F.max(last).alias(last))


def cache_stats(counters: DataFrame) -> DataFrame:
    """Hit rate over all tables (hits, misses)."""
    total = F.sum("hits") + F.sum("misses")
    return counters.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.when(total > 0, F.sum("hits") / total).otherwise(0.0).alias("hit_rate"))
