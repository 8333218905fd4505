"""Helpers that the corpus operators share: column picking, bounded slices of Arrow batches, shared storage."""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator's Python code holds at once, besides one whole text that is longer.
SLICE_BYTES = 4 << 20

#: Byte tables. A byte that becomes a space separates words; A-Z are lower-cased, other bytes stay.
#: WORDS: the rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` over lower-cased text. TOKENS: `[^\x20\x09-\x0D]+` over lower-cased text.
#: BLANKS: what white space in ASCII separates, case kept.
WORDS = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], np.uint8)
TOKENS = np.array([32 if 9 <= b <= 13 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
BLANKS = np.array([32 if b in (9, 10, 13) else b for b in range(256)], np.uint8)


class Coded(NamedTuple):
    """Texts as word codes: the words of text i are codes[starts[i] : starts[i + 1]], and code c means unique[c]."""

    codes: np.ndarray
    unique: pa.BinaryArray
    starts: np.ndarray

    @property
    def words(self) -> list[bytes]:
        return self.unique.to_pylist()


def encode_words(texts: pa.Array, table: np.ndarray) -> Coded:
    """Splits binary texts (nulls: empty) into words by a byte table and numbers the distinct ones, without a Python loop."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets_buffer, data_buffer = texts.buffers()
    bounds = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[bounds[0] : bounds[-1]] if data_buffer else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    data = table[data]
    inside = data != 32
    after = np.ones(len(data) + 1, bool)
    after[1:] = ~inside[:]
    after[bounds] = True
    firsts = np.flatnonzero(inside & after[:-1])
    places = np.cumsum(inside)
    offsets = np.append(places[firsts] - 1, places[-1] if len(places) else 0).astype(np.int32)
    letters = data[inside]
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return Coded(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(firsts, bounds))


def words_of(text: bytes) -> list[bytes]:
    """Words of one text by the table WORDS."""
    return text.translate(WORDS.tobytes()).split()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name first, whatever else the table carries (columns that differ in case, say)."""
    at: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c.lower(), i)
    for i, c in reversed(list(enumerate(df.columns))):
        at[f"={c}"] = i
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{at.get(f'={n}', at.get(n.lower()))}").alias(n) for n in names))


def lengths_of(column: pa.Array) -> list[int]:
    """Bytes of each value of a binary column (null: 0)."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts Arrow batches into row ranges of about `limit` bytes of text; gives each with its texts as a binary array without nulls."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()), b"")
        start, held = 0, 0
        for i, n in enumerate(lengths_of(texts)):
            if held and held + n > limit:
                yield batch.slice(start, i - start), texts.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start), texts.slice(start)


def keep(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary one if all runs on this machine; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoint")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Spark's setting by which an execution's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds between two collections of the driver's garbage, at least; and when the last one was.
RELEASE_SECONDS = 2.0
_released: list[float] = []


def release(spark: SparkSession) -> None:
    """Has the driver drop plans that nothing refers to any more, with their broadcasts, map statuses and checkpoints.

    Its JVM collects garbage only where its heap grows towards the limit; until then all plans of a job of many cuts stay.
    """
    if not _released or time.monotonic() - _released[-1] >= RELEASE_SECONDS:
        spark._jvm.System.gc()
        _released[:] = [time.monotonic()]


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, and with that ends its lineage; survives lost executors. Its shuffle files go at once:
    nothing reads them again, and else they would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df = df.select("*").checkpoint(eager=True)  # a plan takes the setting of when it was made
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)
    release(spark)
    return df


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size partitions by."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n, size
