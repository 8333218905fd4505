"""Wire envelopes of an event, as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, templates
from ..schema import EVENT_SCHEMA, INTERNAL, full_table, idempotency_key

#: Event type suffix by operation.
SUFFIXES = {"c": "created", "u": "updated", "d": "deleted", "r": "snapshot", "t": "truncated"}


def _body() -> Column:
    """The event without what never leaves the engine; images as JSON, not as text."""
    images = [paths.image(c).alias(c) for c in ("before", "after")]
    return F.struct(*images, *(F.col(f"`{f.name}`") for f in EVENT_SCHEMA if f.name not in ("before", "after", *INTERNAL)))


def native() -> Column:
    return F.to_json(_body())


def debezium() -> Column:
    return F.concat(F.lit('{"schema":null,"payload":'), native(), F.lit("}"))


def cloudevents(type_prefix: str = "rowtide.change") -> Column:
    return F.to_json(cloudevents_struct(type_prefix))


def cloudevents_struct(type_prefix: str = "rowtide.change") -> Column:
    table = full_table(F.col("source"))
    suffix = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.struct(
        F.lit("1.0").alias("specversion"), F.col("event_id").alias("id"), F.concat(F.lit("rowtide/"), F.col("source.name"), F.lit("/"), table).alias("source"),
        F.concat(F.lit(f"{type_prefix}."), F.try_element_at(suffix, F.col("op"))).alias("type"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        table.alias("subject"), F.lit("application/json").alias("datacontenttype"),
        F.struct(paths.image("before").alias("before"), paths.image("after").alias("after"), F.col("op").alias("op")).alias("data"),
    )


ENVELOPES = {"native": native, "debezium": debezium, "cloudevents": cloudevents}


def payload(envelope: str = "native") -> Column:
    """The message body; raw messages are the row image alone (`null` if there is none)."""
    raw = F.coalesce(F.col("routing.raw_payload"), F.lit(False))
    return F.when(raw, F.coalesce("after", F.lit("null"))).otherwise(ENVELOPES[envelope]())


def messages(events: DataFrame, topic: str | None = None, key: str | None = None, envelope: str = "native") -> tuple[DataFrame, DataFrame]:
    """(messages with topic, key, value, headers; events without a topic, for the dead-letter table).

    Topic: routing, then the template; an empty one is an error. Key: routing, template, then the idempotency key.
    """
    row = paths.image("after")
    blank = lambda c: F.nullif(c, F.lit(""))
    made = [blank(templates.compile(topic, row))] if topic else []
    keys = [blank(templates.compile(key, row, strict=False))] if key else []
    out = events.withColumn("_topic", F.coalesce(blank(F.col("routing.topic")), *made)).withColumn("_key", F.coalesce(blank(F.col("routing.key")), *keys, idempotency_key()))
    good = out.where("_topic is not null").select(F.col("_topic").alias("topic"), F.col("_key").alias("key"), payload(envelope).alias("value"), F.col("routing.headers").alias("headers"), "event_id")
    bad = out.where("_topic is null").drop("_topic", "_key").withColumns({"error": F.lit("routing: no topic"), "error_kind": F.lit("routing")})
    return good, bad
