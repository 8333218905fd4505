"""Numbers rows in an order without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import shared_folder

#: Bits of a monotonically increasing id that count within a partition.
_WITHIN = 33


def held(df: DataFrame) -> DataFrame:
    """df, computed once: in the session's shared checkpoint folder, or cached where there is none."""
    if shared_folder(df.sparkSession) is None:
        return df.persist()
    return df.checkpoint(eager=True)


def row_numbers(df: DataFrame, key: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """df with each row's number (from 0) within its key, in order.

    Rows are dealt to sorted ranges of key and order, so a key with very many rows is many tasks. A row's number is its place in its
    range, plus the rows of its key in earlier ranges; of these there are as many counts as ranges and keys in them.
    """
    ranged = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = held(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", _WITHIN)))
    counts = placed.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_of"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *(F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return placed.join(offsets, same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
