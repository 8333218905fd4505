"""Schema registry as DataFrames: versions, as-of lookups, differences.

A registry table has tenant, db, table, hash, schema_json, sequence, registered_at (a timestamp). Lookups by sequence or time are as-of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ("tenant", "db", "table")


def register(attempts: DataFrame) -> DataFrame:
    """Versions from registrations (key, hash, schema_json, registered_at, attempt: a total order). A known hash keeps its version; the sequence counts
    new versions over all tables. Distinct schemas are few, as the first attempts are aggregated before any ordering."""
    first = attempts.groupBy(*KEY, "hash").agg(F.min("attempt").alias("attempt"), F.min_by("schema_json", "attempt").alias("schema_json"), F.min_by("registered_at", "attempt").alias("registered_at"))
    versions = first.withColumn("version", F.row_number().over(W.partitionBy(*KEY).orderBy("attempt")))
    return versions.withColumn("sequence", F.row_number().over(W.orderBy("attempt")))


def latest(registry: DataFrame) -> DataFrame:
    return registry.groupBy(*KEY).agg(F.max_by(F.struct("version", "hash", "schema_json", "sequence"), "version").alias("s")).select(*KEY, "s.*")


def asof(events: DataFrame, registry: DataFrame, at: str, valid_from: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Each event with the version that holds at `at`: the greatest `valid_from` not after it; null columns if there is none.

    Versions become intervals (lead), and the join is an equi-join on the table plus a range check; a table's versions are few. Adaptive
    execution broadcasts the registry if it proves small, and splits tables with very many events.
    """
    w = W.partitionBy(*key).orderBy(valid_from)
    spans = registry.withColumn("_until", F.lead(valid_from).over(w)).withColumnRenamed(valid_from, "_from")
    others = [c for c in spans.columns if c not in key and not c.startswith("_")]
    right = spans.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "_from", "_until", *(F.col(c).alias(f"schema_{c}" if c in events.columns else c) for c in others))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    on: Column = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    for s in same:
        on = on & s
    return events.join(right, on, "left").drop("_from", "_until", *(f"_k{i}" for i in range(len(key))))


def diff(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Differences of two catalogs (db, table, name, data_type, pk_ordinal): kind is added, dropped, type_changed, pk_changed or table_dropped, with
    `is_stop` for changed keys. Tables that aren't stored have none."""
    tables = lambda d: d.select("db", "table").distinct()
    known = tables(stored)
    lost = known.join(tables(live), ["db", "table"], "left_anti").withColumn("_lost", F.lit(True))
    a = stored.select("db", "table", "name", F.col("data_type").alias("was"), F.col("pk_ordinal").alias("pk_was"), F.lit(True).alias("in_stored"))
    b = live.join(known, ["db", "table"], "left_semi").select("db", "table", "name", F.col("data_type").alias("now"), F.col("pk_ordinal").alias("pk_now"), F.lit(True).alias("in_live"))
    both = a.join(b, ["db", "table", "name"], "full").join(lost, ["db", "table"], "left").where("_lost is null")
    kind = F.when(F.col("in_stored").isNull(), "added").when(F.col("in_live").isNull(), "dropped").when(F.col("was") != F.col("now"), "type_changed")
    columns = both.select("db", "table", "name", kind.alias("kind"), "was", "now").where("kind is not null")
    keys = both.where("not (pk_was <=> pk_now)").select("db", "table", "name", F.lit("pk_changed").alias("kind"), F.col("pk_was").cast("string").alias("was"), F.col("pk_now").cast("string").alias("now"))
    gone = lost.select("db", "table", F.lit(None).cast("string").alias("name"), F.lit("table_dropped").alias("kind"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now"))
    return columns.unionByName(keys).unionByName(gone).withColumn("is_stop", F.col("kind") == "pk_changed")


def undeclared(events: DataFrame, declared: DataFrame) -> DataFrame:
    """Payload keys that no declared column (db, table, name) has, with the number of events."""
    keys = events.select(F.col("source.db").alias("db"), F.col("source.table").alias("table"), F.explode(F.json_object_keys("after")).alias("name"))
    counted = keys.groupBy("db", "table", "name").agg(F.count(F.lit(1)).alias("events"))
    return counted.join(declared.select("db", "table", "name"), ["db", "table", "name"], "left_anti")


def missing(events: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared columns by the number of events that lack their key."""
    keys = events.where("after is not null").select(F.col("source.db").alias("db"), F.col("source.table").alias("table"), F.json_object_keys("after").alias("keys"))
    total = keys.groupBy("db", "table").agg(F.count(F.lit(1)).alias("total"))
    found = keys.select("db", "table", F.explode("keys").alias("name")).groupBy("db", "table", "name").agg(F.count(F.lit(1)).alias("seen"))
    out = declared.select("db", "table", "name").join(total, ["db", "table"]).join(found, ["db", "table", "name"], "left")
    return out.select("db", "table", "name", (F.col("total") - F.coalesce("seen", F.lit(0))).alias("events")).where("events > 0")
