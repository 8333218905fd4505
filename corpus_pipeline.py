"""A training-data pipeline over `documents`: language, repeated lines, near copies, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import decontam, langid, line_dedup, near, packing
from rowtide.llm.common import pick, read, shared_dir
from rowtide.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language can't be told (no letter, or no text) or the best guess is less likely than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a probability of at least LEAST_SCORE."""
    model = langid.fit(docs, F.lit(True))
    told = langid.predict(docs, model, list(COLUMNS))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; documents of which nothing is left go. n_chars follows the text."""
    clean = line_dedup.dedup_lines(docs, COLUMNS)
    gone = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.where(~F.coalesce(gone, F.lit(False))).select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group; of fully equal rows, one."""
    rows = pick(docs, *COLUMNS)
    kept = near.near_duplicates(docs).where("is_kept").groupBy("row_key", "doc_id").count().select("row_key", F.col("doc_id").alias("kept_id"), F.col("count").alias("equal"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = rows.join(kept, (key == F.col("row_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")))
    again = joined.where("equal > 1").groupBy("kept_id", "row_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return joined.where("equal = 1").select(*COLUMNS).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of ten words of a benchmark item occurs."""
    return decontam.clean_texts(docs, read(spark, sf_dir, "benchmark"), list(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: where each piece of each document lies."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what each stage returns is written to the shared folder, until the next has read it."""
    docs = read(spark, sf_dir, "documents")
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = posixpath.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, posixpath.join(folder, str(k - 1)))
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
