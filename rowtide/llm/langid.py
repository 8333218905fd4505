"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training: a bounded sample of labelled rows (at most `PER_LANG` a language, the least by a hash of id and text, and `SAMPLE` in
all, but one of each language at least), from which a fifth is set aside. Every label is a class. Features are hashed character n-grams (1 to 3 characters of lower-cased text, with
runs of anything but letters as one blank) with TF-IDF weights of unit length. Follow-the-regularised-leader (FTRL-proximal)
with elastic-net penalties learns one sparse weight vector a language; the set-aside fifth fits the temperature.

Prediction: whole texts in Arrow batches, vectorised over a slice of documents; the model is a matrix of `2**BITS` rows and a
column a language, which is broadcast. No shuffle. Language, source and id are never inputs.

`und` with score 0 for texts that are null or have no letter. With no labelled rows everything is `und`. With one
language, that one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, pick, slices

BITS = 15
ORDERS = (1, 2, 3)
#: Labelled rows that are learnt from: at most so many a language, and in all (but one a language).
PER_LANG, SAMPLE = 400, 8_000
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
#: Letters of text that are featured at once.
PART = 1 << 20


def _letter_table() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, each lower-cased, with one 0 for each run of other characters and around
    each text; and where each text begins (one more at the end)."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    joined = "\0".join(["", *(t.decode("utf-8", "replace").replace("\0", " ") for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.flatnonzero(points == 0)
    low = _TABLE[0][points]
    blank = low == 0
    kept = ~blank
    kept[0] = True
    kept[1:] |= blank[1:] & ~blank[:-1]
    kept[bounds] = True  # a text's own border stays, even beside a blank
    places = np.cumsum(kept) - 1
    return low[kept], places[bounds]


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text: text number, feature, term frequency; and the letters of each text."""
    points, bounds = letters(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    points = points[: bounds[-1]].astype(np.uint64) if n else points.astype(np.uint64)
    keys = []
    for order in ORDERS:
        mixed = np.zeros(max(0, len(points) - order + 1), np.uint64)
        for k in range(order):
            mixed = (mixed ^ points[k : len(points) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        has = points[: len(mixed)] != 0 if order == 1 else np.ones(len(mixed), bool)
        has &= owner[: len(mixed)] == owner[order - 1 :]
        keys.append((owner[: len(mixed)][has].astype(np.uint64) << np.uint64(bits)) | ((mixed[has] ^ np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)))
    found = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if n << bits <= 1 << 22:
        counts = np.bincount(found.astype(np.int64), minlength=1)
        uniq = np.flatnonzero(counts)
        counts = counts[uniq]
    else:
        uniq, counts = np.unique(found, return_counts=True)
    count = np.bincount(owner, points != 0, n).astype(np.int64) if n else np.zeros(0, np.int64)
    return (uniq >> bits if uniq.dtype == np.int64 else (uniq >> np.uint64(bits)).astype(np.int64)), uniq.astype(np.int64) & ((1 << bits) - 1), counts, count


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: feature x language
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Untempered scores by text and language, and the letters of each text. Texts are taken a few at a time."""
        out, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        step = max(1, (1 << 22) >> (self.idf.size - 1).bit_length())
        for a in range(0, len(texts), step):
            part = texts[a : a + step]
            doc, feature, tf, count[a : a + len(part)] = features(part, (self.idf.size - 1).bit_length())
            value = (1 + np.log(tf)) * self.idf[feature]
            norm = np.sqrt(np.bincount(doc, value * value, len(part)))
            for c in range(len(self.languages)):
                out[a : a + len(part), c] = np.bincount(doc, value * self.weights[feature, c], len(part)) / np.maximum(norm, 1e-12) + self.bias[c]
        return out, count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], bits: int = BITS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model | None:
    """FTRL-proximal over the texts in their given order, each epoch; every fifth text only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return None
    width = 1 << bits
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        _, feature, tf, _ = features([t], bits)
        rows.append((feature, 1 + np.log(tf)))
    held = [i for i in range(len(texts)) if i % 5 == 4]
    used = [i for i in range(len(texts)) if i % 5 != 4]
    df = np.zeros(width)
    for i in used:
        df[rows[i][0]] += 1
    idf = np.log((1 + len(used)) / (1 + df)) + 1
    target = [languages.index(y) for y in labels]
    k = len(languages)
    z, n, bias = np.zeros((width + 1, k)), np.zeros((width + 1, k)), width

    def current(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in used:
            feature, tf = rows[i]
            x = tf * idf[feature]
            x = np.append(x / max(np.linalg.norm(x), 1e-12), 1.0)
            at = np.append(feature, bias)
            w = current(at)
            p = softmax((x @ w)[None, :])[0]
            p[target[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = current(np.arange(width + 1))
    model = Model(languages, idf, w[:width], w[width], 1.0)
    if k > 1 and held:
        scores, _ = model.logits([texts[i] for i in held])
        truth = np.array([target[i] for i in held])
        grid = np.geomspace(0.25, 20, 89)
        loss = [-np.mean(np.log(np.maximum(softmax(scores / t)[np.arange(len(held)), truth], 1e-12))) for t in grid]
        model = model._replace(temperature=float(grid[int(np.argmin(loss))]))
    return model


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Model | None:
    """Learns from the rows of docs (doc_id, text, lang) where `learn` holds and lang and text aren't null.

    Languages are counted over all rows; a hash of id and text thins each to about four times its share before the exact cut, so no
    task or the driver sees more than the bound. The row with the least hash is always taken, so that no language is lost where rows are equal.
    """
    rows = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rank = F.xxhash64("doc_id", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("least")).orderBy("lang").collect()
    if not counts:
        return None
    share = min(per_lang, max(1, sample // len(counts)))
    bound = 1 << 20
    by_lang = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.struct(F.lit(int(min(1, 4 * (share + 16) / r["n"]) * bound)).alias("chance"), F.lit(r["least"]).alias("least")))))
    own = F.try_element_at(by_lang, F.col("lang"))
    thin = rows.withColumn("rank", rank).where((F.pmod("rank", F.lit(bound)) < own["chance"]) | (F.col("rank") == own["least"]))
    order = W.partitionBy("lang").orderBy("rank", "doc_id", "text")
    taken = thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share)
    found = sorted((r["rank"], r["text"], r["lang"]) for r in taken.select("rank", "text", "lang").collect())
    return train([t.encode() for _, t, _ in found], [y for _, _, y in found])


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch, texts in slices(batches, limit=PART):
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None:
                logits, count = model.logits(texts.to_pylist())
                p = softmax(logits / model.temperature)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(count):
                    names[i], scores[i] = model.languages[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([*keep(batch, ["row"]), pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """The named columns of every row of docs, with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = pick(docs, *dict.fromkeys([*columns, "text"])).select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_predict(shared), f"row {kind}, lang_pred string, score double").select("row.*", F.col("lang_pred").alias("lang_pred"), F.col("score").alias("score"))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score; learns from the rows where `held_out` doesn't hold."""
    model = fit(docs, ~held_out)
    ids = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return predict(ids, model, ["doc_id"]).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
