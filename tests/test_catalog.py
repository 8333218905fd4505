"""Every registered query of the engine against its DuckDB SQL."""

import decimal
import os

import duckdb
import pytest

from rowtide.plans import catalog, logs  # noqa: F401  (both register queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_structure_fingerprints_reads_integral_values(spark, tmp_path):
    rows = [(1, 1.5), (2, 2.5), (20, 3.0), (30, 4.0)]  # plain, plain, a text as user, a key too many
    made = spark.createDataFrame(rows, "event_id long, value double").selectExpr("event_id", "timestamp'2024-01-01' AS ts", "1L AS user_id", "'view' AS event_type", "value", "'{}' AS props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["structure_fingerprints"](spark, str(tmp_path)).first().structures == 3
