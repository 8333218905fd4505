"""Drift of payloads against declared columns: statistics per column, mismatches, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths

#: A NOT NULL column with a larger share of nulls is reported.
HIGH_NULL_RATE = 0.001
SAMPLES, SAMPLE_CHARS = 5, 100


#: What json_type gives.
JSON_TYPES = ("null", "boolean", "integer", "number", "string", "array", "object", "other")
#: First letters of a variant's type name, and its JSON type.
_TYPES = {
    "STR": "string", "BOO": "boolean", "ARR": "array", "OBJ": "object", "BIG": "integer", "INT": "integer", "SMA": "integer", "TIN": "integer", "DOU": "number", "DEC": "number", "FLO": "number", "VOI": "null",
}


def json_type(v: Column) -> Column:
    """null, boolean, integer, number, string, array, object. The value is looked at once."""
    known = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.substring(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), 1, 3)), F.lit("other"))


def expected(data_type: Column, seen: Column) -> Column:
    """Whether a JSON type is one that a column of this SQL type can have. Decimals travel as text; unknown types take anything."""
    t = F.regexp_replace(F.lower(data_type), r"\(.*\)|\s*unsigned", "")
    ok = (
        F.when(t.isin("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year", "int2", "int4", "int8", "serial", "bigserial"), seen.isin("integer", "boolean") | ((seen == "string") & t.isin("bigint", "int8")))
        .when(t.isin("float", "double", "real", "float4", "float8", "double precision"), seen.isin("integer", "number"))
        .when(t.isin("decimal", "numeric"), seen.isin("integer", "number", "string"))
        .when(t.isin("boolean", "bool", "bit"), seen.isin("boolean", "integer"))
        .when(t.isin("json", "jsonb"), F.lit(True))
        .when(t.isin("blob", "binary", "varbinary", "tinyblob", "mediumblob", "longblob", "bytea"), seen.isin("string", "object"))
        .when(t.rlike(r"char|text|enum|set|uuid|date|time|inet|xml|money|interval"), seen.isin("string", "integer"))
        .otherwise(F.lit(True))
    )
    return (seen == "null") | F.coalesce(ok, F.lit(True))


def observations(events: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per event and declared column (db, table, name, data_type, nullable): seen type, whether it is as expected, and a text sample.

    Keys of the envelope are pruned here. The declared columns are broadcast (one row a table, no more than the schemas have): dealt by
    table, a table's events would all be one task. What a column may hold is found once a declared column, not once a value.
    """
    rows = events.where("after is not null").select(F.col("source.db").alias("db"), F.col("source.table").alias("table"), "event_id", paths.image("after").alias("row"))
    takes = F.filter(F.array(*map(F.lit, JSON_TYPES)), lambda seen: expected(F.col("data_type"), seen))
    own = declared.withColumn("takes", takes).groupBy("db", "table").agg(F.collect_list(F.struct("name", "data_type", "nullable", "takes")).alias("columns"))
    each = rows.join(F.broadcast(own), ["db", "table"]).select("db", "table", "event_id", "row", F.explode("columns").alias("c")).select("db", "table", "event_id", "c.*", F.try_variant_get("row", F.concat(F.lit("$."), F.col("c.name")), "variant").alias("v"))
    seen = json_type(F.col("v"))
    return each.select("db", "table", "event_id", "name", "data_type", "nullable", seen.alias("seen"), F.array_contains("takes", seen).alias("is_expected"), F.substring(F.to_json("v"), 1, SAMPLE_CHARS).alias("sample"))


def column_stats(events: DataFrame, declared: DataFrame) -> DataFrame:
    """By column: total, nulls, null_rate, n_types, dominant_type (ties: the name), mismatches, is_high_null."""
    seen = observations(events, declared)
    by_type = seen.groupBy("db", "table", "name", "data_type", "nullable", "seen").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("seen") != "null"
    stats = by_type.groupBy("db", "table", "name", "data_type", "nullable").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(real).alias("n_types"),
        F.max(F.when(real, F.struct("n", F.translate("seen", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("z"), "seen")))["seen"].alias("dominant_type"),
        F.coalesce(F.sum(F.when(~expected(F.col("data_type"), F.col("seen")), F.col("n"))), F.lit(0)).alias("mismatches"),
    )
    rate = F.col("nulls") / F.col("total")
    return stats.withColumn("null_rate", rate).withColumn("is_high_null", ~F.col("nullable") & (F.col("null_rate") > HIGH_NULL_RATE))


def drift_events(events: DataFrame, declared: DataFrame) -> DataFrame:
    """Mismatches by column and type, with the first samples in the order of event ids. Samples are pre-aggregated to the five least, never a group's whole list."""
    bad = observations(events, declared).where("not is_expected")
    keys = ["db", "table", "name", "data_type", "seen"]
    counted = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(_least(bad, keys), keys, "left")


def _least(bad: DataFrame, keys: list[str]) -> DataFrame:
    """The SAMPLES first samples: a salted top-n, then a top-n of those."""
    first = bad.select(*keys, "event_id", "sample", F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("_salt"))
    near = first.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy("event_id"))).where(F.col("_n") <= SAMPLES)
    top = near.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("event_id"))).where(F.col("_n") <= SAMPLES)
    return top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "sample"))), lambda x: x["sample"]).alias("samples"))


def summary(stats: DataFrame) -> DataFrame:
    """By table: columns, columns with mismatches, mismatching values, columns with too many nulls."""
    return stats.groupBy("db", "table").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(F.col("mismatches") > 0).alias("drifted_columns"), F.sum("mismatches").alias("mismatches"), F.count_if("is_high_null").alias("high_null_columns")
    )


def by_column(drifts: DataFrame) -> DataFrame:
    """By column over all types: types seen, total, up to five samples."""
    return drifts.groupBy("db", "table", "name").agg(F.sort_array(F.collect_set("seen")).alias("types"), F.sum("n").alias("n"), F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seen", "samples"))), lambda x: x["samples"])), 1, SAMPLES).alias("samples"))
