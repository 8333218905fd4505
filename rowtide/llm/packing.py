"""Best-fit packing of tokenised documents into sequences of fixed length, improved by a swap-based local search.

1. Tokenise (mapInArrow, no shuffle). White space separates the tokenizer's words, so a bounded cache from word to
   ids does most of the work; the tokenizer itself is asked for each word that the cache doesn't hold.
2. Pieces that fill a sequence are done. Of the others only the lengths are shuffled: to shards of about `SHARD_PIECES` pieces by a
   hash of document and piece, so that equal lengths or copies spread evenly and a shard's size doesn't depend on the data.
3. A shard packs its pieces: best fit in decreasing order, then local search over all underfull bins: documents move to
   fuller bins' gaps, or are exchanged one for one or two for one, each step increasing the sum of squared fills,
   until bins empty and no step is left. If that isn't the least number of bins that could do, the search is made once more
   from bins that are best fit in a mixed order, and the better result stays.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, encode_words, keep, pick, slices

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs.
SHARD_PIECES = 20_000
#: Words or parts of words that a worker's cache holds before it starts anew.
CACHE_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Punctuation that may follow a plain word; runs of it are one token class in the tokenizer's own rule. Not the apostrophe.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return whole, Tokenizer.from_str(json.dumps(json.loads(whole.to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def _gather(pool: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[first : first + size] for each pair, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(firsts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


class WordIds:
    """Ids of texts. A word is what ASCII white space separates; the tokenizer never joins across it.

    A plain word (letters below U+0240, then punctuation) is two of the tokenizer's pre-tokens at most, so only distinct
    lower-cased letter parts go to the tokenizer's merge model, and are cached. Any other word goes through the whole
    tokenizer, with a cache of its own. `plain` is False where the tokenizer file doesn't lower-case and split so.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.merge = _tokenizer(path)
        self.chars, self.plain = _byte_chars(), True
        self.parts: dict[str, bytes] = {"": b""}
        self.others: dict[str, bytes] = {}
        probe = ["Word.", "été,", "a", "On##", "ABC", "...", "Ça"]
        self.plain = self.of(pa.array(probe, pa.binary()))[0].tobytes() == b"".join(self._whole(probe))

    def _bare(self, texts: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, already lower-cased."""
        marks = [t if t.isascii() else t.encode().decode("latin-1").translate(self.chars) for t in texts]
        return [array("I", e.ids).tobytes() for e in self.merge.encode_batch_fast(marks, add_special_tokens=False)]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _cached(cache: dict[str, bytes], encode, texts: list[str], step: int) -> list[bytes]:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = [t for t in texts if t not in cache]
        for k in range(0, len(new), step):
            cache.update(zip(new[k : k + step], encode(new[k : k + step])))
        return list(map(cache.__getitem__, texts))

    def of(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        n = len(words)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        text = words.cast(pa.string())
        low = pc.utf8_lower(text)
        head = pc.utf8_rtrim(low, characters=TAIL)
        size = pc.binary_length(low).to_numpy().astype(np.int64)
        tail_size = size - pc.binary_length(head).to_numpy()
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
        largest = np.maximum.reduceat(np.frombuffer(words.buffers()[2], np.uint8), offsets[:-1])
        fast = (largest <= 0xC8) & ~pc.match_substring(text, "\u0130").to_numpy(zero_copy_only=False)
        fast &= pc.or_(pc.utf8_is_alpha(head), pc.equal(head, "")).to_numpy(zero_copy_only=False)
        if not self.plain:
            fast[:] = False
        # tails as an array of their own: the last bytes of each lower-cased word
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset + 1 : low.offset + n + 1].astype(np.int64)
        tail_bytes = _gather(np.frombuffer(low.buffers()[2], np.uint8), ends - tail_size, tail_size)
        tail = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, np.cumsum(tail_size)).astype(np.int32)), pa.py_buffer(tail_bytes))
        parts = pa.chunked_array([head.filter(pa.array(fast)), tail.filter(pa.array(fast))]).combine_chunks().dictionary_encode()
        part_ids = self._cached(self.parts, self._bare, parts.dictionary.to_pylist(), 20_000)
        other_ids = self._cached(self.others, self._whole, text.filter(pa.array(~fast)).to_pylist(), 5_000)
        pool = np.frombuffer(b"".join([*part_ids, *other_ids]), "<u4")
        sizes = np.fromiter((len(x) // 4 for x in [*part_ids, *other_ids]), np.int64, len(part_ids) + len(other_ids))
        firsts = np.cumsum(sizes) - sizes
        # each word is two stretches of the pool; the second of a word that isn't plain is empty
        at, m = np.zeros((n, 2), np.int64), int(fast.sum())
        code = parts.indices.to_numpy()
        at[fast, 0], at[fast, 1] = code[:m], code[m:]
        at[~fast, 0] = len(part_ids) + np.arange(n - m)
        length = np.where(fast[:, None] | np.array([True, False]), sizes[at] if len(sizes) else 0, 0)
        return _gather(pool, firsts[at].ravel(), length.ravel()), length.sum(axis=1)

    def __call__(self, texts: pa.Array) -> list[memoryview]:
        """Ids of each text, as little-endian 32-bit numbers."""
        coded = encode_words(texts, BLANKS)
        pool, sizes = self.of(coded.unique)
        firsts = np.cumsum(sizes) - sizes
        counts = sizes[coded.codes]
        ids = _gather(pool, firsts[coded.codes], counts)
        bounds = np.append(0, np.cumsum(counts))[coded.starts]
        return [memoryview(ids[a:b]).cast("B") if b > a else memoryview(b"") for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker."""
    return WordIds(path)


def pieces_of(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end = _word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch, docs in slices(batches):
            out: list[list[int]] = [[] for _ in range(6)]
            ids, keys = (c.to_pylist() for c in keep(batch, ["doc_id", "row_key"]))
            for doc_id, key, data in zip(ids, keys, ids_of(docs)):
                data = data.tobytes() + end
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    for c, v in zip(out, (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part), key)):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row_key"])

    return run


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> np.ndarray:
    """Bin of each length, taken in decreasing or in the given order: the fullest bin with room."""
    bins = np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for i in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room = made, capacity
            made += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[i] = b
        if (left := room - n) > 0:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class LocalSearch:
    """Exchanges documents between underfull bins until none is left that increases the sum of squared fills.

    In each round the bins are taken from the fullest on, and each takes what fills it best from the bins after it (the
    donors): a document for its gap, one for one, one for two of its own, or two for one of its own. A donor loses what a
    fuller bin gains, so the sum of squares grows with each exchange and the search ends; the emptiest bins empty. Donors'
    documents are held by length, so the best partner of an exchange is found without a walk through them.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.capacity, self.length, self.bin = capacity, lengths.tolist(), bins.tolist()
        self.fill = np.bincount(bins, lengths).astype(int).tolist() if len(bins) else []
        self.items: list[set[int]] = [set() for _ in self.fill]
        for i, b in enumerate(self.bin):
            self.items[b].add(i)

    def run(self) -> np.ndarray:
        least = -(-sum(self.length) // self.capacity)
        while sum(f > 0 for f in self.fill) > least and self._round():
            pass
        return np.unique(self.bin, return_inverse=True)[1]

    def _round(self) -> bool:
        under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (-self.fill[b], b))
        self.held: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        self.free: set[int] = set()
        self.number = np.zeros(self.capacity + 1, np.int64)
        self.mask, self.floor = 0, None
        for b in reversed(under):
            for i in sorted(self.items[b]):
                self._give(i)
        changed = False
        for a in under:
            for i in self.items[a]:
                self._keep(i)
            while self.fill[a] and self.fill[a] < self.capacity and self.mask and self._step(a):
                changed = True
        return changed

    def _give(self, i: int) -> None:
        """A document of a donor."""
        n = self.length[i]
        self.held[n].append(i)
        self.free.add(i)
        self.number[n] += 1
        if self.number[n] == 1:
            self.mask |= 1 << n
            self.floor = None

    def _keep(self, i: int) -> None:
        n = self.length[i]
        self.free.discard(i)
        self.number[n] -= 1
        if not self.number[n]:
            self.mask ^= 1 << n
            self.floor = None

    def _of(self, n: int, but: int = -1) -> int:
        """A donors' document of this length."""
        held = self.held[n]
        while held[-1] not in self.free:
            held.pop()
        if held[-1] != but:
            return held[-1]
        return next(i for i in reversed(held) if i in self.free and i != but)

    def _largest(self, most: int) -> int:
        """The largest length of at most `most` that a donor's document has, or 0."""
        return max(0, (self.mask & ((2 << min(most, self.capacity)) - 1)).bit_length() - 1)

    def _two(self, most: int) -> tuple[int, int]:
        """The two lengths of donors' documents with the largest sum of at most `most`, or zeros."""
        if self.floor is None:
            self.floor = np.maximum.accumulate(np.where(self.number > 0, np.arange(self.capacity + 1), 0))
        first = np.flatnonzero(self.number[: min(most, self.capacity)])
        second = self.floor[np.minimum(most - first, first)]
        second = np.where((second == first) & (self.number[first] < 2), self.floor[np.maximum(first - 1, 0)], second)
        both = np.where(second > 0, first + second, 0)
        if not len(both) or not both.max():
            return 0, 0
        k = int(both.argmax())
        return int(first[k]), int(second[k])

    def _step(self, a: int) -> bool:
        """The exchange that fills bin a most, if there is one."""
        gap = self.capacity - self.fill[a]
        own = sorted({self.length[i]: i for i in sorted(self.items[a], reverse=True)}.items())
        best, out, into = self._largest(gap), [], [self._largest(gap)]
        twice = Counter(self.length[i] for i in self.items[a])
        options = [([i], n) for n, i in own]
        for k, (n, i) in enumerate(own):
            options += [([i, j], n + m) for m, j in own[k + 1 :]]
            if twice[n] > 1:
                options.append(([i, next(j for j in self.items[a] if j != i and self.length[j] == n)], 2 * n))
        for leave, n in options:
            if best < gap and (m := self._largest(n + gap)) - n > best:
                best, out, into = m - n, leave, [m]
        for n, i in own:
            if best < gap and sum(two := self._two(n + gap)) - n > best:
                j = self._of(two[0])
                places = self._place(a, i, [j, self._of(two[1], j)])
                if places:
                    best, out, into = sum(two) - n, [i], list(two)
        if not best:
            return False
        come = [self._of(into[0])]
        if len(into) > 1:
            come.append(self._of(into[1], come[0]))
        home = self.bin[come[0]] if len(into) == 1 else self._place(a, out[0], come)[0]
        for j in come:
            self._keep(j)
            self._move(j, a)
        for i in out:
            self._move(i, home)
            self._give(i)
        return True

    def _place(self, a: int, i: int, come: list[int]) -> list[int]:
        """The bins of two documents that bin a would take for its document i where i fits then and the sum of squares grows."""
        lost: dict[int, int] = {}
        for j in come:
            lost[self.bin[j]] = lost.get(self.bin[j], 0) + self.length[j]
        gain = sum(lost.values()) - self.length[i]
        grown = (self.fill[a] + gain) ** 2 - self.fill[a] ** 2
        found = []
        for home in lost:
            after = {b: self.fill[b] - n + self.length[i] * (b == home) for b, n in lost.items()}
            if after[home] <= self.capacity and grown + sum(f * f - self.fill[b] ** 2 for b, f in after.items()) > 0:
                found.append(home)
        return found

    def _move(self, i: int, b: int) -> None:
        was, n = self.bin[i], self.length[i]
        self.items[was].remove(i)
        self.items[b].add(i)
        self.bin[i] = b
        self.fill[was] -= n
        self.fill[b] += n


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Bins after the local search, numbered from 0."""
    return LocalSearch(lengths, bins, capacity).run()


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; bins are numbered from 0."""
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    if bins.max() >= -(-lengths.sum() // capacity):  # unsorted bins leave the search more to exchange
        mixed = np.random.default_rng(len(lengths)).permutation(len(lengths))
        bins = min(bins, local_search(lengths, best_fit(lengths, capacity, mixed), capacity), key=np.max)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    base = (ends - lengths[order])[first][np.cumsum(first) - 1]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = ends - lengths[order] - base
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text; null or empty text: the end id alone) with its sequence and offset.

    Documents of up to `capacity` ids stay whole, longer ones are cut at multiples of it. Repeated rows are packed each.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = cut(rows.withColumn("row_key", F.xxhash64("doc_id", F.octet_length("text"))).mapInArrow(pieces_of(tokenizer_path, capacity, end_id), PIECES))
    # full pieces are sequences by themselves, with negative numbers; the others are dealt to shards
    columns = RESULT_COLUMNS[:5]
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack_lengths(table["length"].to_numpy(), capacity)
        numbers = pa.array(table["shard"].to_numpy() * (1 << 32) + bins)
        return table.select(columns).append_column("sequence_id", numbers).append_column("offset", pa.array(offsets))

    shard = F.pmod(F.xxhash64("row_key", "piece"), F.lit(shards))
    return rest.withColumn("shard", shard).groupBy("shard").applyInArrow(one, RESULT).union(full)


RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
