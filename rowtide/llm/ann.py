"""Approximate nearest neighbours by additive quantisation.

Codebooks: `BOOKS` full-dimensional codebooks of `WORDS` vectors, learnt on a bounded sample (`SAMPLE` vectors, the least by
a hash of their id): each in turn by k-means on what the earlier ones leave, then all refitted together by least squares
to the codes. A vector's code is one word of each book, found by beam search over the residuals; its reconstruction is
the words' sum. Codes are stored with a norm: the squared norm of the vector over its product with the reconstruction, by
which a score from lookup tables is scaled, so that reconstructions that fall short aren't ranked too low.

The index (ids, codes, norms) is made once, and written to the shared folder. Queries are taken in batches of at most `QUERY_BYTES`, which
are broadcast. For each batch the index is scored from lookup tables, one part of `PART_ROWS` rows to a task (and, if that makes few tasks, one
share of the batch); a task gives its best `SHORTLIST` a query, and these are merged, so a query's shortlist is of the whole table and does not grow with
it. Shortlists (of one batch, so bounded) are broadcast to the rows, which stay where they are, for exact scores in double precision, of which the best
`k` are merged. Every row is indexed and scored; vectors are never shuffled.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do those of another length than the
most common one. Ties go to the smaller id; rows that share the query's id are its own. With fewer candidates than
`k`, all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, union

BOOKS, WORDS, BEAM = 32, 32, 4
SAMPLE = 8_192
K = 20
#: Rows of the whole table that are scored exactly for each query.
SHORTLIST = 512
#: Bytes of query vectors in a batch, at most; a batch's shortlists are in proportion.
QUERY_BYTES = 2 << 20
#: Rows in a block of the index, and in the part of it that a task scores.
ROW_BLOCK, PART_ROWS = 4_096, 65_536
#: Tasks that a batch is scored in, at least.
TASKS = 8
RESULT = "query_id long, rank int, vec_id long, score double"


class Codebooks(NamedTuple):
    """books: BOOKS x WORDS x dimensions."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors by beam search, and the squared norms of their reconstructions."""
        n, dims = x.shape
        books, words, _ = self.books.shape
        residual, error = x[:, None, :], (x * x).sum(1)[:, None]
        codes = np.zeros((n, 1, 0), np.uint8)
        for m in range(books):
            book = self.books[m]
            # |r - c|^2 = |r|^2 - 2 r.c + |c|^2 for each kept path and word
            reach = error[:, :, None] - 2 * residual @ book.T + (book * book).sum(1)
            flat = reach.reshape(n, -1)
            width = min(beam, flat.shape[1]) if m < books - 1 else 1
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            path, word = best // words, best % words
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, path], word[:, :, None].astype(np.uint8)], axis=2)
            error = flat[rows, best]
            residual = residual[rows, path] - book[word]
        made = x - residual[:, 0]
        return codes[:, 0], (made * made).sum(1)


def _kmeans(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        near = np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, axis=1)
        counts = np.bincount(near, minlength=words)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(len(x), size=words)])
    return centers


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2) -> Codebooks:
    """Codebooks of a sample: residual k-means, then rounds of beam-search encoding and least squares over all books at once."""
    rng = np.random.default_rng(7)
    found, rest = [], x.astype(np.float64)
    for _ in range(books):
        book = _kmeans(rest, words, rng)
        found.append(book)
        rest = rest - book[np.argmin((book * book).sum(1) - 2 * rest @ book.T, axis=1)]
    out = Codebooks(np.array(found))
    for _ in range(rounds):
        codes, _ = out.encode(x)
        hot = np.zeros((len(x), books * words))
        hot[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        gram = hot.T @ hot + 0.1 * np.eye(books * words)
        out = Codebooks(np.linalg.solve(gram, hot.T @ x + 0.1 * out.books.reshape(books * words, -1)).reshape(out.books.shape))
    return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to the smaller id."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= bound)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _index(shared, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to blocks of packed ids, codes and norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(shared.value.books.astype(np.float32))
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                ids, x = _vectors(batch.slice(a, size))
                codes, _ = books.encode(_unit(x).astype(np.float32))
                made = _made(shared.value.books, codes)
                norms = np.linalg.norm(x, axis=1) / np.maximum(np.einsum("nd,nd->n", made, _unit(x)), 1e-3)
                out = [ids.tobytes(), codes.tobytes(), norms.astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.binary()) for o in out], names=["ids", "codes", "norms"])

    return run


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy().astype(np.int64)
    return ids, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of norm 1; the largest component is divided out first, as squares may overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _made(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Reconstructions of codes."""
    return sum(books[m][codes[:, m]] for m in range(len(books)))


class Batch(NamedTuple):
    """Queries, in order of their ids."""

    ids: np.ndarray
    vectors: np.ndarray


def _search(shared, books: Codebooks, shares: int, shortlist: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of a task's blocks for each query of a share of the batch, by scores from lookup tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, _ = books.books.shape
        blocks: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), m).astype(np.intp)
                pairs = [codes[:, b] * words + codes[:, b + 1] if b + 1 < m else codes[:, b] for b in range(0, m, 2)]  # two books to a table
                blocks.setdefault((row["part"], row["share"]), []).append((ids, np.array(pairs), np.frombuffer(row["norms"], np.float32)))
        for (_, share), held in blocks.items():
            queries = shared.value
            ids, norms = (np.concatenate([h[c] for h in held]) for c in (0, 2))
            pairs = np.concatenate([h[1] for h in held], axis=1)
            for i in range(share, len(queries.ids), shares):
                table = (books.books @ _unit(queries.vectors[i : i + 1])[0]).astype(np.float32)
                tables = [(table[b][:, None] + table[b + 1][None, :]).ravel() if b + 1 < m else table[b] for b in range(0, m, 2)]
                score = tables[0].take(pairs[0])
                for b in range(1, len(tables)):
                    score += tables[b].take(pairs[b])
                score *= norms
                own = ids == queries.ids[i]
                score[own] = -np.inf
                near = top(score, ids, shortlist)
                near = near[~own[near]]
                if len(near):
                    yield _packed([(int(queries.ids[i]), ids[near], score[near].astype(np.float64))])

    return run


def _packed(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c].tobytes() for r in rows], pa.binary()) for c in (1, 2))]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "ids", "scores"])


def _rerank(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact scores of the rows that are on a query's shortlist; the best `k` of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, firsts, by = shared.value  # by[firsts[j] : firsts[j + 1]]: queries that have wanted[j] on their list
        of, near, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not len(wanted):
                continue
            for a in range(0, batch.num_rows, ROW_BLOCK):
                ids, x = _vectors(batch.slice(a, ROW_BLOCK))
                at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
                rows = np.flatnonzero(wanted[at] == ids)
                sizes = firsts[at[rows] + 1] - firsts[at[rows]]
                row = np.repeat(rows, sizes)
                query = by[np.repeat(firsts[at[rows]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
                exact = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", x[row[b : b + 65_536]], queries.vectors[query[b : b + 65_536]]) for b in range(0, len(row), 65_536))])
                of, near, scores = np.concatenate([of, query]), np.concatenate([near, ids[row]]), np.concatenate([scores, exact])
                order = np.lexsort((near, -scores, of))
                of, near, scores = of[order], near[order], scores[order]
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
                best = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < k
                of, near, scores = of[best], near[best], scores[best]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(of))
        for a in range(0, len(first), 1000):
            yield _packed([(int(queries.ids[of[f]]), near[f:e], scores[f:e]) for f, e in zip(first[a : a + 1000], ends[a : a + 1000])])

    return run


def _merge(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best k of each query; a query's rows are adjacent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        done: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([np.full(len(i), q) for q, i, _ in done] or [np.zeros(0)]).astype(np.int64), np.concatenate([np.arange(1, len(i) + 1) for _, i, _ in done] or [np.zeros(0)]).astype(np.int32)]
            columns += [np.concatenate([i for _, i, _ in done] or [np.zeros(0)]).astype(np.int64), np.concatenate([s for _, _, s in done] or [np.zeros(0)]).astype(np.float64)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now:
                    if now is not None:
                        done.append((now, ids, scores))
                    now, ids, scores = q, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = np.concatenate([ids, np.frombuffer(i, np.int64)]), np.concatenate([scores, np.frombuffer(s)])
                best = top(scores, ids, k)
                ids, scores = ids[best], scores[best]
            yield flush()
        if now is not None:
            done.append((now, ids, scores))
            yield flush()

    return run


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vectors take part, as (vec_id long, vector array<double>)."""
    rows = pick(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    top_size = 1.7976931348623157e308
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce((x >= -top_size) & (x <= top_size), F.lit(False))) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["dims"] if sizes else -1))


_PACKED = "query_id long, ids binary, scores binary"


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), RESULT)


def _lists(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranked rows, a query's adjacent, to lists: a query may be cut where a batch ends."""
    for batch in rows:
        ids = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        near = batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array([x.tobytes() for x in np.split(near, first[1:])] if len(ids) else [], pa.binary())], names=["query_id", "ids"])


def _shortlists(queries: Batch, lists: pa.Table) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray]:
    """By id of a row: the queries (as places in the batch) that have it on their list."""
    at = np.searchsorted(queries.ids, lists["query_id"].to_numpy())
    near = [np.frombuffer(x, np.int64) for x in lists["ids"].to_pylist()]
    pairs = np.unique(np.stack([np.concatenate([*near, np.zeros(0, np.int64)]), np.repeat(at, [len(x) for x in near])]).astype(np.int64), axis=1)
    wanted, firsts = np.unique(pairs[0], return_index=True)
    return queries, wanted, np.append(firsts, pairs.shape[1]), pairs[1]


def nearest(rows: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, shortlist: int = SHORTLIST, query_block: int | None = None, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k nearest other rows (vec_id, embedding) by inner product for each row where `is_query` (over vec_id) holds: query_id, rank, vec_id, score.

    A query id that several rows share is searched by its least vector (in the order of arrays), once. `query_block` is the
    size of a batch of queries, by default as many as QUERY_BYTES hold.
    """
    spark = rows.sparkSession
    good = usable(rows)
    taken = good.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vec_id", "vector").toArrow()
    if not taken.num_rows:
        return spark.createDataFrame([], RESULT)
    x = _vectors(taken.combine_chunks().to_batches()[0])[1]
    books = learn(_unit(x))
    queries = good.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_rows, n_queries = good.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    context = spark.sparkContext
    index = cut(good.mapInArrow(_index(context.broadcast(books), row_block), "ids binary, codes binary, norms binary"))
    parts = -(-n_rows // PART_ROWS)
    shares = max(1, -(-TASKS // parts))
    dealt = index.select("*", F.pmod(F.xxhash64("ids"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    # each part and share is a task; a part in one piece needs no index moved
    dealt = dealt.repartitionById(parts * shares, (F.col("part") * shares + F.col("share")).cast("int"))
    batches = -(-n_queries // (query_block or max(1, QUERY_BYTES // (8 * x.shape[1]))))
    found = []
    for b in range(batches):
        held = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(batches)) == b).orderBy("vec_id").toArrow()
        if not held.num_rows:
            continue
        batch = Batch(*_vectors(held.combine_chunks().to_batches()[0]))
        near = dealt.mapInArrow(_search(context.broadcast(batch), books, shares, shortlist), _PACKED)
        lists = _merged(near, shortlist).mapInArrow(_lists, "query_id long, ids binary").toArrow()
        exact = good.mapInArrow(_rerank(context.broadcast(_shortlists(batch, lists)), k), _PACKED)
        found.append(cut(_merged(exact, k)) if batches > 1 else _merged(exact, k))
    return union(found)
