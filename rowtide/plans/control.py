"""The control plane's views: schemas, drift, dead letters and pipelines as DataFrames or plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dlq, drift, registry, sensing
from ..streaming.pipeline import Manager


@dataclass
class ControlPlane:
    manager: Manager
    schemas: DataFrame  #: a registry table
    journal: DataFrame  #: dead letters

    def list_schemas(self) -> DataFrame:
        return registry.latest(self.schemas)

    def schema_versions(self, db: str, table: str) -> DataFrame:
        return self.schemas.where((F.col("db") == db) & (F.col("table") == table)).orderBy("sequence")

    def drift(self, events: DataFrame, declared: DataFrame) -> DataFrame:
        return drift.summary(drift.column_stats(events, declared))

    def json_schema(self, events: DataFrame, table: str, sample: int = 1_000) -> dict:
        """JSON Schema of a table's payloads, from a sample of a stated size."""
        import json

        rows = events.where((F.col("source.table") == table) & F.col("after").isNotNull()).select("after").limit(sample).collect()
        return sensing.json_schema(sensing.infer([json.loads(r[0]) for r in rows]))

    def dead_letters(self, limit: int = dlq.PEEK) -> DataFrame:
        return dlq.peek(self.journal, limit)

    def dead_letter_state(self) -> DataFrame:
        return dlq.saturation(self.journal)

    def pipelines(self) -> dict[str, str]:
        return self.manager.status()

    def health(self) -> dict[str, object]:
        state = self.pipelines()
        return {"ready": all(v == "running" for v in state.values()), "pipelines": state}
