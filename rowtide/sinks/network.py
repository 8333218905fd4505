"""Message and HTTP sinks. Each is a client that gets a partition's messages in order; `deliver` runs one inside foreachBatch.

Clients are made on the executors by a factory, so nothing but the factory travels. Delivery is at least once; every message carries its
idempotency key, by which receivers drop repeats.
"""

from __future__ import annotations

import json
import posixpath
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates
from ..schema import shared_folder


class DeliveryError(Exception):
    """kind: auth, retry or permanent."""

    def __init__(self, kind: str, text: str) -> None:
        super().__init__(f"{kind}: {text}")
        self.kind = kind


class Client(Protocol):
    def send(self, messages: list[dict]) -> None: ...

    def close(self) -> None: ...


def http_error_kind(status: int) -> str:
    return "auth" if status in (401, 403) else "retry" if status in (408, 429) or status >= 500 else "permanent"


def backoff(attempt: int, first_s: float = 1.0, most_s: float = 60.0, jitter: float = 0.2, roll: Callable[[], float] = random.random) -> float:
    """Doubling delay with a jitter of a fifth to either side."""
    return min(most_s, first_s * 2**attempt) * (1 + jitter * (2 * roll() - 1))


@dataclass
class HttpClient:
    """A POST per message, or one JSON array a batch to the first message's URL."""

    batch: bool = False
    method: str = "POST"
    timeout_s: float = 10
    attempts: int = 5
    pause: Callable[[float], None] = time.sleep

    def _post(self, url: str, body: str, headers: dict[str, str]) -> None:
        for attempt in range(self.attempts):
            try:
                request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers}, method=self.method)
                with urllib.request.urlopen(request, timeout=self.timeout_s):
                    return
            except urllib.error.HTTPError as e:
                kind, text = http_error_kind(e.code), str(e)
            except OSError as e:
                kind, text = "retry", str(e)
            if kind != "retry" or attempt == self.attempts - 1:
                raise DeliveryError(kind, text)
            self.pause(backoff(attempt))

    def send(self, messages: list[dict]) -> None:
        if self.batch and messages:
            self._post(messages[0]["topic"], "[" + ",".join(m["value"] for m in messages) + "]", {})
        else:
            for m in messages:
                self._post(m["topic"], m["value"], dict(m["headers"] or {}))

    def close(self) -> None:
        pass


def stream_entry(message: dict) -> dict[str, str]:
    """Fields of a Redis stream entry."""
    return {"event_id": message["event_id"] or "", "idempotency_key": message["idempotency_key"], "df-event": message["value"], "df-key": message["key"]}


def subject_is_valid(subject: str) -> bool:
    """NATS subjects that can be published to."""
    return bool(subject) and not any(c in subject for c in " *>")


def subject_column(column: str) -> object:
    return F.coalesce((F.length(column) > 0) & ~F.col(column).rlike(r"[ *>]"), F.lit(False))


def message_headers(message: dict) -> dict[str, str]:
    return {**(message["headers"] or {}), "Nats-Msg-Id": message["idempotency_key"]}


def deliver(messages: DataFrame, factory: Callable[[], Client], order: list[str] | None = None, batch_size: int = 500) -> DataFrame:
    """Sends all messages, now and once; returns those that failed for good, with an error column. A message of a key keeps its place; those
    without a key have none and are spread. Failures are written to the session's shared folder, so reading the result sends nothing again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        try:
            for batch in batches:
                bad: list[dict] = []
                for start in range(0, batch.num_rows, batch_size):
                    part = batch.slice(start, batch_size).to_pylist(maps_as_pydicts="strict")
                    try:
                        client.send(part)
                    except DeliveryError as e:
                        if e.kind != "permanent":
                            raise
                        bad += [m | {"error": str(e)} for m in part]
                yield pa.RecordBatch.from_pylist(bad, pa.schema([*batch.schema, pa.field("error", pa.string())]))
        finally:
            client.close()

    rows = messages.repartition(F.coalesce("key", "event_id")).sortWithinPartitions("key", *(order or ["event_id"]))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    failed = rows.mapInArrow(run, f"{kind}, error string")
    base = shared_folder(messages.sparkSession)
    if base is None:
        failed = failed.persist()
        failed.count()
        return failed
    path = posixpath.join(base, f"undelivered-{uuid.uuid4().hex}")
    failed.write.parquet(path)
    return messages.sparkSession.read.schema(failed.schema).parquet(path)


@dataclass
class Retrying:
    """A client that tries again for as long as it takes, with a doubling delay; what fails for good isn't tried again."""

    client: Client
    pause: Callable[[float], None] = time.sleep

    def send(self, messages: list[dict]) -> None:
        attempt = 0
        while True:
            try:
                return self.client.send(messages)
            except DeliveryError as e:
                if e.kind != "retry":
                    raise
            except OSError:
                pass
            self.pause(backoff(min(attempt, 16)))
            attempt += 1

    def close(self) -> None:
        self.client.close()


def write_kafka(messages: DataFrame, servers: str, **options: str) -> None:
    """Needs Spark's Kafka package. Acknowledged by all replicas, without repeats by the producer's own retries."""
    headers = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))
    writer = messages.select("topic", "key", "value", headers.alias("headers")).write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("includeHeaders", "true").option("kafka.acks", "all").option("kafka.enable.idempotence", "true").options(**options).save()


def url_column(template: str, payload) -> object:
    return templates.compile(template, payload)


def redact(url: str) -> str:
    """A URL without its password."""
    head, at, tail = url.rpartition("@")
    scheme, sep, user = head.partition("://")
    return f"{scheme}{sep}{user.partition(':')[0]}:***@{tail}" if at and sep else url


def redact_column(url: Column) -> Column:
    """The same for a column of URLs."""
    return F.regexp_replace(url, r"^([^:]+://[^:@]*)(?::.*)?@([^@]*)$", "$1:***@$2")


def to_json_lines(messages: list[dict]) -> str:
    return "\n".join(json.dumps(m, sort_keys=True) for m in messages)
