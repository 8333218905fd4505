"""Benchmark decontamination by suffix arrays over the training text.

Each slice of documents (a shard of about 2 MB) becomes one sequence of word ids, over which a suffix array is
built by prefix doubling. Every test suffix is then binary-searched in it: the range of suffixes that begin with
the suffix's first ten words gives all verbatim occurrences and their locations, and runs of occurrences on one
diagonal (document position minus item position) give the longest verbatim match.

Words that no item has can't take part in a match, so they get id 0, and a shard's array holds only the runs of
known words that are long enough for some window; that drops no match.

The items are a stated query set: they are broadcast in blocks of about `block_bytes`, one pass over the documents per
block. If there are several, each pass ends (its hits are written to the shared folder) and its broadcast is dropped before the next
begins, so one block is held at a time, and what is broadcast grows with neither table. With one block no shuffle is needed; with
several, the documents' hits are joined to them by id and text hash.

Nulls have no words; so do empty texts. Items without words are ignored; items that share text each count.
Repeated document rows each get their own result row. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Coded, cut, encode_words, keep, pick, slices, union, words_of

WINDOW = 10
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Bytes of document text in one shard.
SHARD_BYTES = 2 << 20
RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, longest_item long, longest_start long"
)
_STATE = "doc_id long, text string, spans array<long>, items array<string>, longest array<long>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of seq in lexicographic order, by prefix doubling (a shorter suffix sorts first)."""
    n = len(seq)
    if n < 2:
        return np.arange(n)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 1
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n or k >= n:
            return order


def search(seq: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query row (padded to the same width) the range of `order` whose suffixes begin with its first `lengths` ids."""
    width = queries.shape[1]
    padded = np.concatenate([seq, np.zeros(width, seq.dtype)])
    used = np.arange(width) < lengths[:, None]

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            diff = np.where(used[open_], padded[order[mid][:, None] + np.arange(width)] - queries[open_], 0)
            first = np.argmax(diff != 0, axis=1)
            sign = diff[np.arange(len(open_)), first]
            right = sign <= 0 if after else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    return bound(False), bound(True)


class Items:
    """A block of benchmark items as word ids, with their distinct windows."""

    def __init__(self, rows: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.ids, self.vocab = window, [r[0] for r in rows], {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(rows):
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for p in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[p : p + window]), []).append((i, p))
        keys = sorted(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.windows = np.array([k + (0,) * (window - len(k)) for k in keys], np.int64).reshape(len(keys), window)
        self.places = [found[k] for k in keys]
        self.least = int(self.lengths.min()) if keys else 0

    def hits(self, docs: Coded) -> Iterator[tuple[list[int], list[int], tuple[int, int, int]]]:
        """Per document: hit word ranges (start, end, start, end, ...), block indexes of items found, longest match (words, item, start)."""
        n = len(docs.starts) - 1
        known = np.fromiter(map(self.vocab.get, docs.words, repeat(0)), np.int64, len(docs.unique))
        starts = docs.starts + np.arange(n + 1)  # with a separator after each document
        seq = np.insert(known[docs.codes], docs.starts[1:], 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], seq != 0, [0]]).astype(np.int8)))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= max(1, self.least)] if self.least else runs[:0]
        none: tuple[list[int], list[int], tuple[int, int, int]] = ([], [], (0, -1, -1))
        if not len(runs):
            yield from (none for _ in range(n))
            return
        width = runs[:, 1] - runs[:, 0] + 1  # with a separator, which is 0 in seq
        at = np.repeat(runs[:, 0] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
        short = np.append(seq, 0)[at]
        order = suffix_array(short)
        lo, hi = search(short, order, self.windows, self.lengths)
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for w in np.flatnonzero(hi > lo):
            for q in at[order[lo[w] : hi[w]]].tolist():
                by_doc.setdefault(int(np.searchsorted(starts, q, "right")) - 1, []).append((q, int(w)))
        for d in range(n):
            yield self._of_doc(by_doc[d], int(starts[d])) if d in by_doc else none

    def _of_doc(self, found: list[tuple[int, int]], start: int) -> tuple[list[int], list[int], tuple[int, int, int]]:
        spans: list[int] = []
        items: set[int] = set()
        run: dict[tuple[int, int], int] = {}  # (item, diagonal) -> start of the run of windows that is open
        last: dict[tuple[int, int], int] = {}
        best = (0, -1, -1)
        for q, w in sorted(found):
            a, b = q - start, q - start + int(self.lengths[w])
            if spans and a <= spans[-1]:
                spans[-1] = max(spans[-1], b)
            else:
                spans += [a, b]
            for i, p in self.places[w]:
                items.add(i)
                line = (i, a - p)
                if last.get(line) != a - 1:
                    run[line] = a
                last[line] = a
                best = max(best, (b - run[line], -i, -run[line]))
        return spans, sorted(items), (best[0], -best[1], -best[2])


def _scan(shared, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass: adds a block's hits to what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, window)
        for batch, docs in slices(batches, limit=SHARD_BYTES):
            spans, names, longest = (c.to_pylist() for c in keep(batch, ["spans", "items", "longest"]))
            for i, (more, found, best) in enumerate(items.hits(encode_words(docs, WORDS))):
                if more:
                    spans[i] = _merged([*spans[i], *more])
                    names[i] = [*names[i], *(str(items.ids[k]) for k in found)]
                    longest[i] = longest[i] if longest[i][0] >= best[0] else [best[0], items.ids[best[1]], best[2]]
            yield pa.RecordBatch.from_arrays(
                [*keep(batch, ["doc_id", "text"]), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.list_(pa.int64()))],
                names=["doc_id", "text", "spans", "items", "longest"],
            )

    return run


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, docs in slices(batches):
        spans, names, longest = (c.to_pylist() for c in keep(batch, ["spans", "items", "longest"]))
        names, spans = [sorted(set(x)) for x in names], [_merged(s) for s in spans]
        hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [
                *keep(batch, ["doc_id"]),
                pa.array(np.diff(encode_words(docs, WORDS).starts)),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array([h > 0 for h in hit]),
                *(pa.array([x[k] if x[0] else None for x in longest], pa.int64()) for k in range(3)),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_start"],
        )


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """How many blocks of about `block_bytes` the items are, and these; one block is on the driver at a time."""
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    return blocks, (sorted((r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()) for k in range(blocks))


def _state(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "text",
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.array(F.lit(0), F.lit(-1), F.lit(-1)).cast("array<long>").alias("longest"),
    )


def _hits(docs: DataFrame, blocks: Iterator[list[tuple[int, bytes]]], window: int) -> DataFrame:
    """Per document with hits (hit_id, hit_key): spans, items and longest match over all blocks, one pass after another."""
    found: list[DataFrame] = []
    for rows in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        hit = _state(docs).mapInArrow(_scan(shared, window), _STATE).where(F.size("spans") > 0)
        found.append(cut(hit.select(F.col("doc_id").alias("hit_id"), F.xxhash64("text").alias("hit_key"), "spans", "items", "longest")))
        shared.destroy()
    best = F.max(F.struct(F.col("longest")[0].alias("n"), (-F.col("longest")[1]).alias("item"), (-F.col("longest")[2]).alias("start"))).alias("b")
    merged = union(found).groupBy("hit_id", "hit_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), best)
    return merged.select("hit_id", "hit_key", "spans", "items", F.array(F.col("b.n"), -F.col("b.item"), -F.col("b.start")).alias("longest"))


def _of_hit() -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("hit_key"))


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, blocks = _blocks(benchmark, block_bytes)
    if n < 2:
        state = _state(plain)
        for rows in blocks:
            state = state.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(rows), window), _STATE)
        return state
    joined = plain.join(_hits(plain, blocks, window), _of_hit(), "left")
    clean = {"spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>"), "longest": F.array(F.lit(0), F.lit(-1), F.lit(-1)).cast("array<long>")}
    return joined.select("doc_id", "text", *(F.coalesce(c, v).alias(c) for c, v in clean.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text) against benchmark (item_id, text): words hit, items found, longest verbatim match.

    `longest_start` is the match's first word in the document; the three `longest_` columns are null where nothing is hit.
    Items with a null id or text take no part.
    """
    return _scanned(docs, benchmark, window, block_bytes).mapInArrow(_report, RESULT)


def clean_texts(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The named columns (doc_id and text among them) of the documents in which no window occurs."""
    n, blocks = _blocks(benchmark, block_bytes)
    named = pick(docs, *columns)
    if n > 1:
        plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        hit = _hits(plain, blocks, window).select("hit_id", "hit_key")
        rows = named.select(F.struct(*columns).alias("row"), F.col("doc_id"), F.col("text"))
        return rows.join(hit, _of_hit(), "left_anti").select("row.*")
    packed = named.select(F.col("text"), F.struct(*columns).alias("row"))
    for rows in blocks:
        packed = packed.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(rows), window), packed.schema)
    return packed.select("row.*")


def _drop(shared, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, window)
        for batch, docs in slices(batches, limit=SHARD_BYTES):
            yield batch.filter(pa.array([not spans for spans, _, _ in items.hits(encode_words(docs, WORDS))], pa.bool_()))

    return run
