"""Language-model scoring with a weighted backoff automaton over smoothed n-grams.

The model: interpolated absolute discounting. For a history h and a word w,
    p(w | h) = max(c(hw) - D, 0) / c(h) + D * T(h) / c(h) * p(w | h'),
with T(h) the number of different words seen after h, h' the history without its first word, and D = n1 / (n1 + 2 n2)
by order; the unigrams are (c + 0.5) / (N + 0.5 (V + 1)). As an automaton: a state per history that was seen, an arc
for each n-gram that was seen, and a failure arc of weight log10(D T(h) / c(h)) from h to h'. Histories begin with a
start mark at a text's head; a text ends with an end token.

The automaton has as many arcs as the corpus has n-grams, so no task holds all of it. Texts are dealt into chunks of
about `CHUNK_BYTES` by a hash.
1. A chunk asks for the arcs that its texts can use: its distinct n-grams, as sorted 64-bit keys, packed into one binary
   value per shard of the key space that has any, with the chunk's training counts.
2. A shard sums these counts, which makes it a part of the model, and answers each chunk. Of each n-gram that was seen it
   tells one chunk that it owns it.
3. A chunk counts, for each history, the n-grams that it owns, and tells the history's shard, which adds these up to
   T(h) and answers each chunk that has the history.
4. The chunk builds its part of the automaton from the answers, and its texts are traversed.
A frequent n-gram costs a shard one key per chunk, so no key is hot. Messages are never empty, so there are no more of
them than n-grams, and one of four totals for each order to each chunk. Nothing is collected or broadcast; all is one
plan, in which the texts are shuffled once.

Keys: a word's key is its 64-bit hash; an n-gram's is a 64-bit hash of its history's key and its last word's.

Nulls and empty texts are the end token alone. Repeated rows count and are scored each. With no training rows all
scores are those of unseen tokens. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKENS, encode_words, pick, text_bytes

CHUNK_BYTES = 10 << 20
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ASKED = pa.schema([("shard", pa.int32()), ("k", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int32()), ("k", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("owned", pa.binary()), ("followers", pa.binary()), ("totals", pa.list_(pa.int64()))])
_ASKED_ROWS = "shard int, k int, chunk int, keys binary, counts binary"
_TOLD_ROWS = "chunk int, k int, shard int, counts binary, owned binary, followers binary, totals array<long>"

END = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=2))
START = np.uint64(xxhash.xxh3_64_intdigest(b"", seed=3))
_32 = np.uint64(32)
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; 255 stands for a larger one, which follows at the end."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, each in as many bytes as the largest one takes; that number and the first key lead."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards' ranges begin and end in sorted keys; the top 32 bits of a key decide."""
    firsts = [-(-(k << 32) // shards) for k in range(shards)]
    return np.append(np.searchsorted(keys, np.array(firsts, np.uint64) << _32), len(keys))


class Grams:
    """The n-grams of a chunk's texts: by order the key at each place of the stream `start, words, end, start, ...`."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        coded = encode_words(texts, TOKENS)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=1) for w in coded.words), np.uint64, len(coded.unique))
        n, starts = len(coded.starts) - 1, coded.starts
        self.firsts = starts[:-1] + 2 * np.arange(n)  # place of each text's start mark
        self.ends = starts[1:] + 2 * np.arange(n) + 1
        stream = np.zeros(len(coded.codes) + 2 * n, np.uint64)
        word = np.ones(len(stream), bool)
        word[self.firsts] = word[self.ends] = False
        stream[word] = hashes[coded.codes]
        stream[self.firsts], stream[self.ends] = START, END
        self.doc = np.repeat(np.arange(n), self.ends - self.firsts + 1)
        self.depth = np.arange(len(stream)) - self.firsts[self.doc] if n else np.zeros(0, np.int64)
        self.at: list[np.ndarray] = [stream]
        for k in range(2, order + 1):
            key = np.zeros(len(stream), np.uint64)
            key[1:] = mix(self.at[-1][:-1] * _STEP + stream[1:])
            self.at.append(key)
        #: places that hold an n-gram of the order
        self.has = [self.depth >= k for k in range(order)]

    def number(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of order k: the distinct keys, sorted; a place of each; and for each place the number of its key, or -1."""
        places = np.flatnonzero(self.has[k - 1])
        keys, first, inverse = np.unique(self.at[k - 1][places], return_index=True, return_inverse=True)
        number = np.full(len(self.depth), -1, np.int64)
        number[places] = inverse
        return keys, places[first], number


def _requests(order: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        grams = Grams(table["text"].combine_chunks(), order)
        chunk = table["chunk"][0].as_py()
        train = table["train"].to_numpy(zero_copy_only=False).astype(bool)[grams.doc]
        rows: list[dict] = []
        for k in range(1, order + 1):
            keys, _, number = grams.number(k)
            counts = np.bincount(number[train & (number >= 0)], minlength=len(keys))
            rows += _by_shard(keys, counts, shards, k, chunk)
        return pa.Table.from_pylist(rows, _ASKED)

    return run


def _by_shard(keys: np.ndarray, counts: np.ndarray, shards: int, k: int, chunk: int) -> list[dict]:
    """A message for each shard that has some of the keys, which are sorted."""
    edges = shard_edges(keys, shards).tolist()
    return [{"shard": s, "k": k, "chunk": chunk, "keys": pack_keys(keys[a:b]), "counts": pack_counts(counts[a:b])} for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of messages of one order: the distinct keys, the sum of each one's counts, which key each message's entries have, and the messages' sizes."""
    asked = [unpack_keys(r["keys"]) for r in rows]
    sizes = list(map(len, asked))
    given = np.concatenate([unpack_counts(r["counts"], n) for r, n in zip(rows, sizes)])
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    return keys, np.bincount(inverse, given, len(keys)).astype(np.int64), inverse, sizes


def _answers(table: pa.Table) -> pa.Table:
    """A shard's part of the model: sums the counts, answers the chunks, and gives n-grams that were seen to the first chunk that has them.

    A row to chunk -1 has the totals of an order: tokens, distinct n-grams, those seen once, and twice.
    """
    out: list[dict] = []
    rows = sorted(table.to_pylist(), key=lambda r: (r["k"], r["chunk"]))
    for k in sorted({r["k"] for r in rows}):
        mine = [r for r in rows if r["k"] == k]
        keys, counts, inverse, sizes = _summed(mine)
        owned = np.zeros(len(inverse), bool)
        if k > 1:
            owned[np.unique(inverse, return_index=True)[1]] = True
            owned &= counts[inverse] > 0
        real = counts[keys != START] if k == 1 else counts
        totals = [int(real.sum()), *(int(x.sum()) for x in (real > 0, real == 1, real == 2))]
        out.append({"chunk": -1, "k": k, "shard": mine[0]["shard"], "totals": totals})
        start = 0
        for r, n in zip(mine, sizes):
            part = slice(start, start + n)
            start += n
            out.append({"chunk": r["chunk"], "k": k, "shard": r["shard"], "counts": pack_counts(counts[inverse[part]]), "owned": np.packbits(owned[part]).tobytes() if k > 1 else b""})
    return pa.Table.from_pylist(out, _TOLD)


def _gathered(rows: list[dict], field: str, keys: list[np.ndarray], shards: int, unpack: Callable[[bytes, int], np.ndarray]) -> list[np.ndarray]:
    """The answers' values by order, for a chunk's keys; 0 for what wasn't answered."""
    out = []
    for k, own in enumerate(keys, 1):
        edges, values = shard_edges(own, shards), np.zeros(len(own), np.int64)
        for r in rows:
            if r["k"] == k and r[field]:
                a, b = edges[r["shard"] : r["shard"] + 2]
                values[a:b] = unpack(r[field], int(b - a))
        out.append(values)
    return out


def _unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int64)


def _followers(order: int, shards: int, chunks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per history that was seen: how many n-grams that the chunk owns go on from it. Chunk -1 adds up the totals and tells all chunks, as order 0."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if answers.num_rows and answers["chunk"][0].as_py() < 0:
            totals = np.zeros((order, 4), "<i8")
            for k, own in zip(answers["k"].to_pylist(), answers["totals"].to_pylist()):
                totals[k - 1] += np.array(own)
            rows = [{"shard": c % shards, "k": 0, "chunk": c, "keys": totals.tobytes(), "counts": b""} for c in range(chunks)]
        elif texts.num_rows:
            grams, told = Grams(texts["text"].combine_chunks(), order), answers.to_pylist()
            numbered = [grams.number(k) for k in range(1, order + 1)]
            keys = [x[0] for x in numbered]
            counts, owned = _gathered(told, "counts", keys, shards, unpack_counts), _gathered(told, "owned", keys, shards, _unpack_bits)
            for k in range(1, order):
                _, places, _ = numbered[k]
                history = numbered[k - 1][2][places - 1]
                follow = np.bincount(history[owned[k] > 0], minlength=len(keys[k - 1]))
                seen = counts[k - 1] > 0
                rows += _by_shard(keys[k - 1][seen], follow[seen], shards, k, texts["chunk"][0].as_py())
        return pa.Table.from_pylist(rows, _ASKED)

    return run


def _spread(table: pa.Table) -> pa.Table:
    """A shard adds up the followers of each history and answers the chunks; it hands on the totals."""
    rows = table.to_pylist()
    out = [{"chunk": r["chunk"], "k": 0, "totals": np.frombuffer(r["keys"], "<i8").tolist()} for r in rows if not r["k"]]
    for k in sorted({r["k"] for r in rows} - {0}):
        mine = [r for r in rows if r["k"] == k]
        _, sums, inverse, sizes = _summed(mine)
        start = 0
        for r, n in zip(mine, sizes):
            out.append({"chunk": r["chunk"], "k": k, "shard": r["shard"], "followers": pack_counts(sums[inverse[start : start + n]])})
            start += n
    return pa.Table.from_pylist(out, _TOLD)


class Automaton:
    """The part of the automaton that a chunk's texts can reach.

    n-grams are numbered through all orders; 0 is the empty one. `arc` is the log10 weight of the arc into an n-gram
    from its history, for those that were seen and for all words; `target` is the state where it ends; `fail` and `back` are a
    state's failure arc and its weight. A state is an n-gram that was seen as a history; its number is the n-gram's.
    """

    def __init__(self, grams: Grams, answers: list[dict], totals: list[list[int]], shards: int) -> None:
        order = len(totals)
        numbered = [grams.number(k) for k in range(1, order + 1)]
        keys = [x[0] for x in numbered]
        counts = _gathered(answers, "counts", keys, shards, unpack_counts)
        # a chunk asked for the followers of the histories that were seen only
        follow = []
        for own, c in zip(keys[:-1], counts):
            values = np.zeros(len(own), np.int64)
            values[c > 0] = _gathered([r for r in answers if r["k"] == len(follow) + 1], "followers", [own[:0]] * len(follow) + [own[c > 0]], shards, unpack_counts)[-1]
            follow.append(values)
        self.grams, (self.n, self.v, *_) = grams, totals[0]
        self.known = np.append(counts[0], 0)[numbered[0][2]] > 0
        base = np.cumsum([1, *map(len, keys)])
        size = int(base[-1])
        self.at = [np.where(x[2] >= 0, x[2] + base[k], -1) for k, x in enumerate(numbered)]
        self.order, self.seen = np.zeros(size, np.int8), np.zeros(size, bool)
        self.arc, self.back = np.zeros(size), np.zeros(size)
        self.fail, self.target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, (_, places, _) in enumerate(numbered):
            own = np.arange(base[k], base[k + 1])
            self.order[own] = k + 1
            suffix = self.at[k - 1][places] if k else np.zeros(len(own), np.int64)
            if not k:
                self.arc[own] = np.log10((counts[0] + 0.5) / (self.n + 0.5 * (self.v + 1)))
                self.seen[own] = True  # the empty history has an arc for any word
            else:
                history, seen = self.at[k - 1][places - 1], counts[k] > 0
                self.seen[own] = seen
                h, g, c = history[seen], own[seen], counts[k][seen]
                self.arc[g] = np.log10((c - discount(totals[k])) / counts[k - 1][h - base[k - 1]] + 10.0 ** (self.back[h] + self.arc[suffix[seen]]))
            # a state fails to its suffix, and what isn't a state stands for the state of its suffix
            state = (counts[k] > 0) & (follow[k] > 0) if k < order - 1 else np.zeros(len(own), bool)
            self.fail[own] = self.target[suffix]
            self.target[own] = np.where(state, own, self.target[suffix])
            if state.any():
                self.back[own[state]] = np.log10(discount(totals[k + 1]) * follow[k][state] / counts[k][state])

    def base(self) -> np.ndarray:
        return self.arc[self.at[0]]

    def traverse(self) -> np.ndarray:
        """log10 weight of the path at each place: one traversal from left to right that carries the state.

        The stream is cut into lanes that advance together. As a state depends on no more than the last `order - 1` tokens, a lane
        that begins as many tokens earlier at the empty state is in the right one where it has to be.
        """
        n, early = len(self.grams.depth), len(self.at) - 1
        total = np.zeros(n)
        if not n:
            return total
        step = max(1, int(n**0.5))
        heads = np.arange(0, n, step)
        at = np.array(self.at)
        state = np.zeros(len(heads), np.int64)
        for t in range(-early, step):
            lanes = np.flatnonzero((heads + t >= 0) & (heads + t < n))
            places = heads[lanes] + t
            here, weight = state[lanes], np.zeros(len(lanes))
            arc = at[self.order[here], places]
            while (lost := np.flatnonzero((arc < 0) | ~self.seen[arc])).size:
                weight[lost] += self.back[here[lost]]
                here[lost] = self.fail[here[lost]]
                arc[lost] = at[self.order[here[lost]], places[lost]]
            if t >= 0:
                total[places] = weight + self.arc[arc]
            state[lanes] = self.target[arc]
        return total


def discount(totals: list[int]) -> float:
    """n1 / (n1 + 2 n2), kept off 0 and 1."""
    n1, n2 = totals[2:]
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _scores(order: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], pa.int64() if i in (0, 2, 3, 4) else pa.bool_() if i == 1 else pa.float64()) for i in range(7)], names)
        grams, told = Grams(texts["text"].combine_chunks(), order), answers.to_pylist()
        totals = np.array(next(r["totals"] for r in told if not r["k"])).reshape(order, 4).tolist()
        auto = Automaton(grams, told, totals, shards)
        marks = grams.depth == 0
        total = lambda x: np.add.reduceat(np.where(marks, 0, x), grams.firsts)
        held = ~texts["train"].to_numpy(zero_copy_only=False).astype(bool)
        columns = [texts["doc_id"].combine_chunks(), pa.array(held), pa.array(grams.ends - grams.firsts), pa.array(total(auto.known.astype(np.int64))), pa.array(np.full(texts.num_rows, auto.n)), pa.array(total(auto.base())), pa.array(total(auto.traverse()))]
        return pa.table(columns, names)

    return run


def score(docs: DataFrame, train: Column, order: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a model of the given order, learnt from the rows where `train` holds.

    `train` is an expression over doc_id and text (null: false). One row per row of docs.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = text_bytes(rows)
    chunks = max(1, -(-(size + 16 * n) // chunk_bytes))
    shards = max(1, -(-chunks // 2))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text")
    texts = dealt.groupBy("chunk")
    told = texts.applyInArrow(_requests(order, shards), _ASKED_ROWS).groupBy("shard").applyInArrow(_answers, _TOLD_ROWS)
    followers = texts.cogroup(told.groupBy("chunk")).applyInArrow(_followers(order, shards, chunks), _ASKED_ROWS)
    spread = followers.groupBy("shard").applyInArrow(_spread, _TOLD_ROWS)
    return texts.cogroup(told.union(spread).groupBy("chunk")).applyInArrow(_scores(order, shards), RESULT)
