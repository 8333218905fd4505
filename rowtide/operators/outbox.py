"""Transactional outbox: rows captured from outbox tables become routed messages; all other events pass unchanged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, patterns, templates
from ..schema import ROUTING

OUTBOX_SCHEMA = "__outbox"


@dataclass(frozen=True)
class OutboxOptions:
    tables: Sequence[str] = ()
    topic: str | None = None  #: template; empty results fall through
    topic_column: str = "topic"
    default_topic: str | None = None
    key: str | None = None  #: template; falls back to the aggregate id
    payload: str = "payload"
    aggregate_type: str = "aggregate_type"
    aggregate_id: str = "aggregate_id"
    event_type: str = "event_type"
    event_id: str = "id"
    headers: Mapping[str, str] = field(default_factory=dict)  #: header name to column
    raw_payload: bool = False
    strict: bool = False  #: a message that lacks its topic, payload or a standard column fails the job


def is_outbox(options: OutboxOptions) -> Column:
    return F.coalesce(F.col("source.schema") == OUTBOX_SCHEMA, F.lit(False)) & patterns.allowed(options.tables, (), F.col("source.db"), F.col("source.table"))


def outbox(events: DataFrame, options: OutboxOptions = OutboxOptions()) -> DataFrame:
    """Drops outbox rows that aren't inserts of an object; routes the rest and puts the payload in the row's place."""
    row = F.col("_row")
    names = [options.topic_column, options.aggregate_id, options.event_id, options.aggregate_type, options.event_type, *options.headers.values()]
    at = {name: i for i, name in enumerate(dict.fromkeys([*names, options.payload]))}
    scalar = lambda name: F.col(f"_text_{at[name]}")
    blank = lambda c: F.when(c != "", c)
    # Each step is evaluated once a row, whatever is made of it: the image, the values at its keys, their texts, topic and key.
    parsed = paths.computed(events, _row=F.when(is_outbox(options), paths.image("after")), _mine=is_outbox(options))
    usable = (F.col("op") == "c") & F.coalesce(paths.kind_of(row) == "object", F.lit(False))
    found = paths.computed(parsed.where(~F.col("_mine") | usable), **{f"_value_{i}": paths.get(row, name) for name, i in at.items()})
    made = {f"_made_{which}": templates.compile(template, row, strict=False) for which, template in (("topic", options.topic), ("key", options.key)) if template}
    texts = paths.computed(found, **{f"_text_{at[name]}": paths.scalar_of(F.col(f"_value_{at[name]}")) for name in dict.fromkeys(names)}, **made)
    agg_id = scalar(options.aggregate_id)
    topic = F.coalesce(*([blank(F.col("_made_topic"))] if options.topic else []), blank(scalar(options.topic_column)), F.lit(options.default_topic).cast("string"))
    key = F.coalesce(blank(F.col("_made_key")), agg_id) if options.key else agg_id
    headers = {
        "df-event-id": F.coalesce(scalar(options.event_id), F.col("event_id")), "df-aggregate-type": scalar(options.aggregate_type), "df-aggregate-id": agg_id, "df-event-type": scalar(options.event_type),
        **{name: scalar(column) for name, column in options.headers.items()}, "df-source-kind": F.lit("outbox"),
    }
    pairs = F.map_filter(F.create_map(*(x for n, v in headers.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
    payload = F.col(f"_value_{at[options.payload]}")
    lacks = {"topic": topic, "payload": payload, "aggregate_type": scalar(options.aggregate_type), "aggregate_id": agg_id, "event_type": scalar(options.event_type)}
    routing = F.struct(topic.alias("topic"), key.alias("key"), pairs.alias("headers"), F.lit(options.raw_payload).alias("raw_payload")).cast(ROUTING)
    if options.strict:
        for name, value in lacks.items():
            routing = F.when(value.isNull(), F.raise_error(F.lit(f"outbox message without {name}")).cast(ROUTING)).otherwise(routing)
    done = paths.computed(texts, _routing=F.when(F.col("_mine"), routing).otherwise(F.col("routing")))
    return done.withColumns({
        "routing": F.col("_routing"),
        "before": F.when(F.col("_mine"), F.lit(None)).otherwise(F.col("before")),
        "after": F.when(F.col("_mine"), F.to_json(F.coalesce(payload, row))).otherwise(F.col("after")),
        "source": F.col("source").withField("schema", F.when(F.col("_mine"), F.lit(None).cast("string")).otherwise(F.col("source.schema"))),
    }).select(*(F.col(f"`{c}`") for c in events.columns))


def capture(events: DataFrame, tables: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Tags rows of the outbox tables, and logical messages of the given prefixes, as outbox rows."""
    hit = patterns.allowed(tables, (), F.col("source.db"), F.col("source.table")) if tables else F.lit(False)
    if prefixes:
        hit = hit | F.coalesce((F.col("source.schema") == "__wal_message") & F.col("source.table").isin(*prefixes), F.lit(False))
    return events.withColumn("source", F.col("source").withField("schema", F.when(hit, OUTBOX_SCHEMA).otherwise(F.col("source.schema"))))
