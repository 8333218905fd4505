"""N-gram Jaccard join by MinHash banding: near-duplicate documents with verified similarities.

1. Texts become sets of hashed n-grams of `width` words (a shorter text is one n-gram). Rows with the same words in
   the same order are one class of copies from here on, found by a 128-bit hash; each class counts its rows.
2. A class gets `bands * rows` minima of hash functions; `plan_bands` chooses the counts so that a pair at the
   threshold meets in some band with the target recall.
3. The shuffle on band hashes links each class to the least class of each of its buckets: a bucket of n gives n - 1
   edges, never n * n. Components of these edges hold all candidate pairs, and each n-gram set travels once, to its
   component.
4. Components are verified on the full sets: small ones many to a task; one of over `BLOCK` classes or `BLOCK_GRAMS`
   n-grams as pairs of blocks, of which only those meet that share a bucket (or a group within a block). A pair gives one row per block
   with all its link counts as an array, and an edge for each two groups of the blocks that are joined: a group of m classes makes about
   m + (m / BLOCK)^2 edges.
5. Components of the verified links are the result's groups.

Nulls and texts without words have no n-grams: they are linked to nothing and are groups of their own. Repeated rows
and equal texts are linked to each other. Documents without an id take part; the group's id is the least id in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, cut, encode_words, keep, pick, slices
from .components import components
from .lm import mix

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 5
#: Classes and n-grams in one block of a large component, about.
BLOCK = 256
BLOCK_GRAMS = 1_000_000
#: n-grams that one task of small components takes, about.
TASK_GRAMS = 200_000
#: Cells of a block's dense incidence matrix, at most; beyond, pairs are intersected one by one.
DENSE_CELLS = 12_000_000


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands that a pair at the threshold needs to meet in one of them with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes, in order."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) ^ words[k : len(words) - n + 1 + k]
    return mix(out ^ np.uint64(n))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = encode_words(texts, WORDS)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.words), np.uint64, len(coded.unique))
    return hashes[coded.codes], coded.starts


def _signatures(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(2, -1)
        factors[0] |= np.uint64(1)
        for batch, texts in slices(batches):
            words, starts = _hashed(texts)
            full = np.flatnonzero(np.diff(starts))
            grams = [gram_hashes(words[starts[i] : starts[i + 1]], width) for i in full]
            buckets = np.zeros((len(full), bands), np.int64)
            if len(full):
                flat = np.concatenate(grams)
                firsts = np.cumsum([0] + [len(g) for g in grams[:-1]])
                for b in range(bands):
                    own = np.full(len(full), b, np.uint64)
                    for r in range(rows):
                        k = b * rows + r
                        own = mix(own ^ np.minimum.reduceat(flat * factors[0, k] + factors[1, k], firsts))
                    buckets[:, b] = own.view(np.int64)
            keys: list[bytes | None] = [None] * len(texts)
            sizes = np.zeros(len(texts), np.int64)
            rows_of: list[list[int] | None] = [None] * len(texts)
            for j, i in enumerate(full):
                keys[i] = xxhash.xxh3_128_digest(words[starts[i] : starts[i + 1]].tobytes())
                sizes[i], rows_of[i] = len(grams[j]), buckets[j].tolist()
            yield pa.RecordBatch.from_arrays(
                [*keep(batch, ["doc_id", "row_key"]), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(rows_of, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "class_key", "n_grams", "buckets"],
            )

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words, starts = _hashed(texts)
            sets = [np.unique(gram_hashes(words[a:b], width)).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([*keep(batch, ["class_key"]), pa.array(sets, pa.binary())], names=["class_key", "grams"])

    return run


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric boolean matrix: whose sets have at least this Jaccard similarity. The diagonal is False."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    uniq, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner = np.repeat(np.arange(n), sizes)[shared]
    _, column = np.unique(inverse[shared], return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    if n * width <= DENSE_CELLS:
        dense = np.zeros((n, width), np.float32)
        dense[owner, column] = 1
        both = (dense @ dense.T).astype(np.int64)
    else:
        both = np.zeros((n, n), np.int64)
        order = np.argsort(sizes, kind="stable")
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if sizes[i] < threshold * sizes[j]:
                    break
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


_LINKS = "root binary, block int, keys array<binary>, links array<long>, edges array<struct<a:binary,b:binary>>"
_ARROW = pa.schema([("root", pa.binary()), ("block", pa.int32()), ("keys", pa.list_(pa.binary())), ("links", pa.list_(pa.int64())), ("edges", pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))])


def groups_of(match: np.ndarray) -> np.ndarray:
    """The least member of each row's connected component in a symmetric boolean matrix."""
    n = len(match)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(match, label[None, :], n).min(axis=1, initial=n))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _pair(left: int, right: int, blocks: np.ndarray, keys: list[bytes], n_rows: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, list[bytes], list[int], list[tuple[bytes, bytes]]]]:
    """Per block: its classes, the rows linked to each (of a pair, across the blocks only), and edges that join groups."""
    match = linked(sets, threshold)
    if not match.any():
        return
    if left == right:
        label = groups_of(match)
        yield left, keys, (match @ n_rows).tolist(), [(keys[i], keys[j]) for i, j in enumerate(label.tolist()) if i != j]
        return
    same = blocks[:, None] == blocks[None, :]
    across, label = match & ~same, groups_of(match & same)
    if not across.any():
        return
    i, j = np.nonzero(across)
    joins = np.unique(np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])]), axis=1).T
    links = across @ n_rows
    for block in (left, right):
        own = np.flatnonzero(blocks == block).tolist()
        yield block, [keys[k] for k in own], links[own].tolist(), [(keys[a], keys[b]) for a, b in joins.tolist()] if block == left else []


def _verify(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Verifies each component, or pair of blocks, of a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("root", "left", "right", "class_key")]).combine_chunks()
        roots, keys = table["root"].to_pylist(), table["class_key"].to_pylist()
        left, right, blocks, n_rows = (table[c].to_numpy() for c in ("left", "right", "block", "n_rows"))
        grams = table["grams"]
        firsts = [i for i in range(len(roots)) if not i or (roots[i], left[i], right[i]) != (roots[i - 1], left[i - 1], right[i - 1])]
        out: list[tuple] = []
        for a, b in zip(firsts, [*firsts[1:], len(roots)]):
            sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in range(a, b)]
            out += [(roots[a], *x) for x in _pair(int(left[a]), int(right[a]), blocks[a:b], keys[a:b], n_rows[a:b].astype(np.int64), sets, threshold)]
        columns = list(zip(*out)) or [[]] * 5
        edges = [[{"a": x, "b": y} for x, y in e] for e in columns[4]]
        return pa.table([pa.array(c, f.type) for c, f in zip([*columns[:4], edges], _ARROW)], schema=_ARROW)

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, row_key, class_id (the group's least doc_id), n_links (rows of docs
    that are similar to this one, itself not counted), n_copies (rows with the same words), is_kept (the one row of each group that stays;
    of fully equal rows all say so).

    Reads docs several times; a caller whose docs are costly should pass a written table.
    """
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("row_key", F.xxhash64("doc_id", "text"))
    signed = cut(plain.mapInArrow(_signatures(width, plan_bands(threshold, recall, rows), rows), "doc_id long, row_key long, class_key binary, n_grams long, buckets array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("least")
    classes = cut(signed.where("class_key is not null").groupBy("class_key").agg(least, F.count(F.lit(1)).alias("n_rows"), F.first("n_grams").alias("n_grams"), F.first("buckets").alias("buckets")))

    # links between the classes of a bucket, as a star
    held = classes.select("class_key", F.posexplode("buckets").alias("band", "bucket"))
    stars = held.groupBy("band", "bucket").agg(F.min("class_key").alias("first"), F.max("class_key").alias("last")).where("first <> last").select("band", "bucket", "first")
    roots = components(held.join(stars, ["band", "bucket"]).where("class_key <> first").select(F.col("class_key").alias("a"), F.col("first").alias("b")))

    # candidates by component, or by pair of blocks of a large one
    held_by = roots.select(F.col("node").alias("class_key"), "root").join(classes.select("class_key", "least", "n_rows", "n_grams", "buckets"), "class_key")
    sized = held_by.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    placed = cut(held_by.join(sized, "root").withColumn("n_blocks", F.least("n_blocks", F.lit(1 << 20))).withColumn("block", F.pmod(F.xxhash64("class_key"), F.col("n_blocks")).cast("int")))
    gathered, large = placed.agg(F.coalesce(F.sum("n_grams"), F.lit(0)), F.coalesce(F.max("n_blocks"), F.lit(0))).first()
    tasks = max(1, -(-gathered // TASK_GRAMS))
    facts = ("class_key", "root", "n_rows", "block")
    spread = placed.where("n_blocks = 1").select(*facts, F.lit(0).alias("left"), F.lit(0).alias("right"), F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"))
    if large > 1:
        in_blocks = placed.where("n_blocks > 1")
        meet = in_blocks.select("root", "block", F.posexplode("buckets").alias("band", "bucket")).groupBy("root", "band", "bucket").agg(F.sort_array(F.collect_set("block")).alias("b")).where("size(b) > 1")
        meet = meet.select("root", "b", F.posexplode("b").alias("at", "left")).select("root", "left", F.explode(F.slice("b", F.col("at") + 1, F.size("b"))).alias("right"))
        own = in_blocks.select("root", F.col("block").alias("left"), F.col("block").alias("right"))
        pairs = cut(meet.union(own).distinct())
        sides = pairs.select("root", F.col("left").alias("block"), "left", "right").union(pairs.where("left <> right").select("root", F.col("right").alias("block"), "left", "right"))
        spread = spread.union(in_blocks.join(sides, ["root", "block"]).select(*facts, "left", "right", F.xxhash64("root", "left", "right").alias("task")))
    wanted = placed.select(F.col("least.doc_id").alias("of_id"), F.col("least.row_key").alias("of_row"), "class_key")
    is_least = (F.col("row_key") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    texts = plain.join(wanted, is_least).groupBy("class_key").agg(F.min("text").alias("text"))
    grams = texts.mapInArrow(_sets(width), "class_key binary, grams binary")
    links = cut(spread.join(grams, "class_key").groupBy("task").applyInArrow(_verify(threshold), _LINKS))

    # groups: components of the verified links; the counts of a block's pairs are added up as arrays
    groups = components(links.select(F.explode("edges").alias("e")).select("e.a", "e.b")).withColumnRenamed("node", "class_key")
    add = F.aggregate("counts", F.transform(F.get("counts", F.lit(0)), lambda x: F.lit(0).cast("long")), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    summed = links.groupBy("root", "block").agg(F.first("keys").alias("keys"), F.collect_list("links").alias("counts")).select(F.explode(F.arrays_zip("keys", add.alias("links"))).alias("x"))
    counted = summed.select(F.col("x.keys").alias("class_key"), F.col("x.links").alias("links"))
    grouped = classes.select("class_key", "n_rows", "least").join(counted, "class_key", "left").join(groups, "class_key", "left").withColumn("root", F.coalesce("root", "class_key"))
    kept = grouped.groupBy("root").agg(F.min("least").alias("kept"))
    known = grouped.join(kept, "root").select("class_key", "n_rows", "links", "kept")
    return signed.select("doc_id", "row_key", "class_key").join(known, "class_key", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("n_rows", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("n_rows", F.lit(1)).alias("n_copies"),
        (F.col("class_key").isNull() | (F.col("row_key") == F.col("kept.row_key")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))).alias("is_kept"),
    )
