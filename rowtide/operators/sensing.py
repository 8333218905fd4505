"""Schema sensing: structure fingerprints, evolution in order, dynamic keys, and export of inferred schemas.

A structure is the canonical text of a value's types with sorted keys. The batch form orders each table's events and numbers the changes; the
streaming form is in rowtide.streaming.sensor.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .numbering import held

STABLE_FREQUENCY, MIN_DYNAMIC, MIN_CONFIDENCE, MIN_EVENTS = 0.5, 5, 0.7, 100
TOP_KEYS, SAMPLE_KEYS = 50, 50
MAX_SCHEMA_DEPTH = 10


def structure(value: Any) -> Any:
    """Types of a JSON value: null, bool, int, float, string; [item] by the first item; {key: ...} with sorted keys."""
    if isinstance(value, dict):
        return {k: structure(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [structure(value[0])] if value else []
    return {type(None): "null", bool: "bool", int: "int", float: "float", str: "string"}[type(value)]


def fingerprint_of(value: Any) -> str:
    return hashlib.sha256(json.dumps(structure(value), separators=(",", ":")).encode()).hexdigest()[:16]


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Structure fingerprint of JSON texts; each distinct text is parsed once a batch."""
    return texts.map({t: fingerprint_of(json.loads(t)) for t in texts.dropna().unique()})


def key_fingerprint(text: Column) -> Column:
    """Fingerprint of the top level's keys alone, without Python."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.json_object_keys(text)), "\x01"), 256), 1, 16)


def _changes(table: list[str], fp: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to sorted rows whether each one's structure differs from the row's before it in its table; null for the first of a table in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        last = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*table, fp)]
            out: list[int | None] = []
            for *now, value in zip(*columns):
                out.append(None if tuple(now) != key else int(value != last))
                key, last = tuple(now), value
            yield batch.append_column("_changed", pa.array(out, pa.int32()))

    return run


def evolution(rows: DataFrame, table: list[str], order: list[str], fp: str) -> DataFrame:
    """Rows with `schema_sequence`: 1 for a table's first structure, and one more at each change from the event before.

    Rows are dealt to sorted ranges of table and order, so a table with very many events is many tasks. Of each range and table only the
    first and last structure and the number of changes are compared with those of the ranges before.
    """
    ranged = rows.repartitionByRange(*table, *order).sortWithinPartitions(*table, *order).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_changed", T.IntegerType())])
    placed = held(ranged.mapInArrow(_changes(table, fp), schema).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy("_range", *table).agg(F.sum(F.coalesce("_changed", F.lit(0))).alias("_n"), F.min_by(F.struct(fp), "_at").alias("_first"), F.max_by(F.struct(fp), "_at").alias("_last"))
    w = W.partitionBy(*table).orderBy("_range")
    starts = F.when(F.lag("_last").over(w).eqNullSafe(F.col("_first")), 0).otherwise(1)  # 1 also for a table's very first row
    counted = parts.withColumn("_starts", starts).withColumn("_before", F.coalesce(F.sum(F.col("_n") + F.col("_starts")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_starts"))
    offsets = counted.select(F.col("_range").alias("_of"), "_before", *(F.col(c).alias(f"_key_{i}") for i, c in enumerate(table)))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(table):
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    within = W.partitionBy("_range", *table).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    numbered = placed.withColumn("_sum", F.sum(F.coalesce("_changed", F.lit(0))).over(within))
    return numbered.join(offsets, same).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_sum") + F.col("_before")).alias("schema_sequence"))


def key_counts(rows: DataFrame, path: str, keys: Column) -> DataFrame:
    """(path, key, n) over all events, for keys: an array of the object's keys per event."""
    return rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(path).alias("path"), "key", "n")


def classify_paths(counts: DataFrame, events: int, min_events: int = MIN_EVENTS) -> DataFrame:
    """By path: stable keys (in at least half of the events), number of dynamic ones, confidence, and whether the path is a map."""
    freq = F.least(F.lit(1.0), F.col("n") / F.lit(float(max(events, 1))))
    stable = freq >= STABLE_FREQUENCY
    out = counts.groupBy("path").agg(F.count(F.lit(1)).alias("keys"), F.count_if(stable).alias("n_stable"), F.min(F.when(stable, freq)).alias("least"), F.sort_array(F.collect_list(F.when(stable, F.col("key")))).alias("stable_keys"))
    separation = F.when(F.col("least").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("least") - STABLE_FREQUENCY) / F.col("least"))))
    confidence = 0.5 * math.sqrt(min(1.0, events / min_events)) + 0.5 * separation
    dynamic = F.col("keys") - F.col("n_stable")
    return out.select("path", "keys", "n_stable", "stable_keys", dynamic.alias("n_dynamic"), confidence.alias("confidence"), ((dynamic >= MIN_DYNAMIC) & (confidence >= MIN_CONFIDENCE)).alias("is_map"))


def heavy_hitters(counts: DataFrame, k: int = TOP_KEYS) -> DataFrame:
    """The k commonest keys, exactly; ties by key."""
    return counts.orderBy(F.desc("n"), "key").limit(k)


def sample_keys(counts: DataFrame, k: int = SAMPLE_KEYS) -> DataFrame:
    """A sample of k distinct keys that any run gives again."""
    return counts.orderBy(F.xxhash64("key"), "key").limit(k)


def distinct_keys(rows: DataFrame, keys: Column) -> DataFrame:
    """Approximate number of distinct keys (HLL)."""
    return rows.select(F.explode(keys).alias("key")).agg(F.approx_count_distinct("key", 0.016).alias("distinct_keys"))


def normalise_keys(text: Column, stable: list[str]) -> Column:
    """An object's dynamic keys replaced by one `<dynamic>` entry (the first by key)."""
    entries = F.from_json(text, "map<string,string>")
    kept = F.map_filter(entries, lambda k, _: k.isin(*stable) if stable else F.lit(False))
    other = F.array_sort(F.map_entries(F.map_filter(entries, lambda k, _: ~k.isin(*stable) if stable else F.lit(True))))
    return F.to_json(F.when(F.size(other) > 0, F.map_concat(kept, F.create_map(F.lit("<dynamic>"), F.get(other, 0)["value"]))).otherwise(kept))


def adaptive_fingerprint(text: Column, stable: list[str]) -> Column:
    """Stable keys, a map mark and nothing of how many dynamic keys there are: equal for objects that differ in those only."""
    keys = F.json_object_keys(text)
    fixed = F.array_sort(F.array_intersect(keys, F.array(*(F.lit(s) for s in stable)) if stable else F.array().cast("array<string>")))
    return F.substring(F.sha2(F.concat(F.array_join(fixed, "\x01"), F.when(F.size(keys) > F.size(fixed), F.lit("\x01<MAP>")).otherwise(F.lit(""))), 256), 1, 16)


def walk(value: Any, path: str, depth: int = 0, stable: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(path, type) of all parts: `a.b`, `a[]` for a list's first item, `a.<*>` for a map's entries."""
    kind = structure(value)
    out = [(path, kind if isinstance(kind, str) else "object" if isinstance(kind, dict) else "array")]
    if isinstance(value, dict):
        for k in sorted(value):
            fixed = stable is None or path not in stable or k in stable[path]
            out += walk(value[k], (f"{path}.{k}" if path else k) if fixed else f"{path}.<*>", depth + 1, stable)
    elif isinstance(value, list) and value:
        out += walk(value[0], f"{path}[]", depth + 1, stable)
    return out


def path_types(rows: DataFrame, column: str, stable: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, type, n) over all JSON texts of a column: how many values have a part of this type at this path. Each distinct text of a batch is parsed once."""

    @F.pandas_udf("array<struct<path: string, type: string>>")
    def parts(texts: pd.Series) -> pd.Series:
        known = {t: walk(json.loads(t), "", 0, stable) for t in texts.dropna().unique()}
        return texts.map(lambda t: [{"path": p, "type": k} for p, k in known[t]], na_action="ignore")

    return rows.select(F.explode(parts(F.col(column))).alias("part")).groupBy("part.path", "part.type").agg(F.count(F.lit(1)).alias("n"))


def infer(rows: list[Any]) -> dict[str, Any]:
    """Merged description of JSON values: kinds seen, and for objects each key's description and count. For profiles of samples."""
    node: dict[str, Any] = {"n": 0, "kinds": {}, "fields": {}, "items": None}
    for value in rows:
        _merge(node, value)
    return node


def _merge(node: dict[str, Any], value: Any) -> None:
    node["n"] += 1
    kind = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(value)]
    node["kinds"][kind] = node["kinds"].get(kind, 0) + 1
    if kind == "object":
        for k, v in value.items():
            _merge(node["fields"].setdefault(k, {"n": 0, "kinds": {}, "fields": {}, "items": None}), v)
    elif kind == "array":
        for v in value:
            node["items"] = node["items"] or {"n": 0, "kinds": {}, "fields": {}, "items": None}
            _merge(node["items"], v)


def json_schema(node: dict[str, Any], depth: int = 0) -> dict[str, Any]:
    """JSON Schema (draft 2020-12) of a description. Required: in every object and never null."""
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema"} if not depth else {}
    if depth > MAX_SCHEMA_DEPTH:
        return head
    shapes = []
    for kind in sorted(node["kinds"]):
        if kind == "object":
            n = node["kinds"]["object"]
            required = sorted(k for k, f in node["fields"].items() if f["n"] == n and "null" not in f["kinds"])
            shapes.append({"type": "object", "properties": {k: json_schema(f, depth + 1) for k, f in sorted(node["fields"].items())}} | ({"required": required} if required else {}))
        elif kind == "array":
            shapes.append({"type": "array"} | ({"items": json_schema(node["items"], depth + 1)} if node["items"] else {}))
        else:
            shapes.append({"type": kind})
    return head | (shapes[0] if len(shapes) == 1 else {"oneOf": shapes} if shapes else {})
