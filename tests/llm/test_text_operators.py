"""Language model, near duplicates, line dedup, decontamination against brute force, and their edge cases."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowtide.llm import common, decontam, line_dedup, lm, near
from rowtide.llm.common import TOKENS, WORDS, encode_words, pick, words_of

SCHEMA = "doc_id long, text string"


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def sample_texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["été", "Ünï", "中文"]
    out = [" ".join(rng.choices(vocab, k=rng.randint(0, 80))) for _ in range(n)]
    for i in range(0, n, 7):  # near copies
        words = out[i - 1].split()
        if len(words) > 20:
            words[5] = "changed"
        out[i] = " ".join(words)
    return out + ["", None, "one", "A\tB\nC  d", out[3], out[3]]


# -- shared helpers ---------------------------------------------------------------------------------------------------


def shuffles_left(spark, since, until, registered=False):
    """How many of these shuffles have files still, or are known to the driver still, once Spark has had time to remove some."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    end = time.monotonic() + 10
    while True:
        files = env.blockManager().diskBlockManager().getAllFiles().mkString(" ")
        left = sum(env.mapOutputTracker().containsShuffle(i) if registered else f"shuffle_{i}_" in files for i in range(since, until))
        if not left or time.monotonic() > end:
            return left
        time.sleep(0.1)


def test_a_cut_gives_back_what_it_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "RELEASE_SECONDS", 0.0)
    mark = spark._jsc.sc().newShuffleId
    since = mark()
    counts = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = mark()
    assert shuffles_left(spark, since, until) == 0
    for _ in range(3):
        common.cut(spark.range(3))
    assert shuffles_left(spark, since, until, registered=True) == 0
    assert sorted(r["count"] for r in counts.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get(common.FREE_SHUFFLES) == "false"  # only a cut's own plan
    kept = spark.range(9).repartition(2, "id")
    assert [kept.count(), len(kept.collect()), len(kept.collect())] == [9, 9, 9]


def test_encode_words_matches_plain_splitting():
    texts = [t.encode() if t is not None else None for t in [*sample_texts(), " lead", "trail ", "a-b_c9Z"]]
    for table, split in ((WORDS, words_of), (TOKENS, lambda b: b.translate(TOKENS.tobytes()).split())):
        coded = encode_words(pa.array(texts, pa.binary()), table)
        for i, t in enumerate(texts):
            assert [coded.words[c] for c in coded.codes[coded.starts[i] : coded.starts[i + 1]]] == split(t or b"")
    assert encode_words(pa.array([], pa.binary()), WORDS).starts.tolist() == [0]


def test_pick_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b", 3)], "doc_id long, text string, Text string, _c0 int")
    assert pick(df, "text", "doc_id").first().asDict() == {"text": "a", "doc_id": 1}


# -- language model ---------------------------------------------------------------------------------------------------


def brute_lm(rows, train, order):
    """The smoothed model by dictionaries and recursion."""
    streams = {i: ["<s>", *(w.decode() for w in (t or "").encode().translate(TOKENS.tobytes()).split()), "</s>"] for i, t in rows}
    counts = [Counter() for _ in range(order + 1)]
    for i, s in streams.items():
        if train(i):
            for k in range(1, order + 1):
                counts[k].update(tuple(s[j - k + 1 : j + 1]) for j in range(k - 1, len(s)))
    types = [Counter(g[:-1] for g in counts[k]) for k in range(order + 1)]
    n = sum(c for g, c in counts[1].items() if g != ("<s>",))
    v = sum(1 for g in counts[1] if g != ("<s>",))

    def d(k):
        n1, n2 = sum(c == 1 for c in counts[k].values()), sum(c == 2 for c in counts[k].values())
        return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5

    discounts = [0, 0] + [d(k) for k in range(2, order + 1)]

    def p(gram):
        k = len(gram)
        if k == 1:
            return (counts[1][gram] + 0.5) / (n + 0.5 * (v + 1))
        h = gram[:-1]
        c = counts[k - 1][h]
        if not c or not types[k][h]:
            return p(gram[1:])
        return max(counts[k][gram] - discounts[k], 0) / c + discounts[k] * types[k][h] / c * p(gram[1:])

    out = {}
    for i, s in streams.items():
        base = sum(math.log10(p((w,))) for w in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j + 1]))) for j in range(1, len(s)))
        out[i] = (len(s) - 1, sum(counts[1][(w,)] > 0 for w in s[1:]), n, base, score)
    return out


@pytest.mark.parametrize(("order", "chunk"), [(2, 1 << 20), (2, 700), (3, 700)])
def test_lm_against_brute_force(spark, order, chunk):
    rows = list(enumerate(sample_texts()))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = {r.doc_id: r for r in lm.score(docs_of(spark, rows), ~held, order, chunk).collect()}
    want = brute_lm(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1, order)
    assert len(got) == len(rows)
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_lm_edges(spark):
    assert lm.score(docs_of(spark, []), F.lit(True)).count() == 0
    none = lm.score(docs_of(spark, [(1, "a b"), (None, None)]), F.lit(False)).collect()
    assert len(none) == 2 and all(r.train_tokens == 0 and r.score == r.base_score for r in none)
    again = lm.score(docs_of(spark, [(1, "a b")] * 3), F.lit(True)).collect()
    assert len(again) == 3 and again[0].train_tokens == 9
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all() and not len(lm.unpack_keys(lm.pack_keys(keys[:0]))) and (lm.unpack_keys(lm.pack_keys(keys[:1])) == keys[:1]).all()
    counts = np.array([0, 254, 255, 256, 10**9])
    assert (lm.unpack_counts(lm.pack_counts(counts), 5) == counts).all()


def test_lm_keys_that_collide_in_32_bits(spark):
    """Two words whose hashes share their low half: neither has the other's history, and no probability is above 1."""
    low = {}
    for k in range(200_000):
        half = int(lm.xxhash.xxh3_64_intdigest(f"w{k}".encode(), seed=1)) & 0xFFFFFFFF
        if half in low:
            break
        low[half] = k
    first, second = f"w{low[half]}", f"w{k}"
    rows = [(i, f"{second} zz") for i in range(100)] + [(200, f"{first} yy"), (300, first), (301, f"{first} zz")]
    got = {r.doc_id: r.score for r in lm.score(docs_of(spark, rows), F.col("doc_id") < 300).collect()}
    want = brute_lm(rows, lambda i: i < 300, 2)
    assert all(v == pytest.approx(want[i][4]) and v <= 0 for i, v in got.items())


def test_lm_lanes_and_long_texts(spark):
    rng = random.Random(9)
    rows = [(0, " ".join(rng.choices("abcdefgh", k=5000))), (1, "a b"), (2, None), (3, " ".join(rng.choices("abcdefghij", k=700)))]
    for order in (1, 2, 4):
        got = {r.doc_id: r.score for r in lm.score(docs_of(spark, rows), F.col("doc_id") < 3, order, 3000).collect()}
        assert got == pytest.approx({i: w[4] for i, w in brute_lm(rows, lambda i: i < 3, order).items()})


def test_lm_probabilities_sum_to_one(spark):
    """Over all words of the vocabulary and one unseen word, p(w | h) sums to 1."""
    train = [(i, t) for i, t in enumerate(["a b a c", "b a b", "c c a"])]
    probe = [(100 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "unseen"])]
    rows = {r.doc_id: r.score for r in lm.score(docs_of(spark, train + probe + [(200, "a")]), F.col("doc_id") < 100).collect()}
    first = brute_lm(train + [(200, "a")], lambda i: i < 100, 2)
    assert rows[200] == pytest.approx(first[200][4])
    # p(a | start) cancels; what follows `a` is one of the words or the end
    ends = {k: brute_lm(train + [(k, f"a {w}")], lambda i: i < 100, 2) for k, w in ((100, "a"),)}
    assert rows[100] == pytest.approx(ends[100][100][4])


# -- near duplicates --------------------------------------------------------------------------------------------------


def shingles(text, width=5):
    w = words_of((text or "").encode())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (min(groups[find(i)]), links[i]) for i in range(n)}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(3)
    base = [f"x{i}" for i in range(200)]
    family = []
    for k in range(25):  # a chain of edits: neighbours are linked, far ones aren't all
        words = list(base)
        for j in range(k):
            words[(7 * j) % 200] = f"e{j}"
        family.append(" ".join(words))
    rows = list(enumerate(family + [" ".join(rng.choices(base, k=150)) for _ in range(20)] + sample_texts()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_edges(spark):
    assert near.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(5, "a b c d e f"), (3, "A, b c D e f!"), (3, "A, b c D e f!"), (None, "a b c d e f"), (9, None), (8, ""), (7, "!!!"), (None, None)]
    out = near.near_duplicates(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    linked = [r for r in out if r.n_links]
    assert len(linked) == 4 and {r.class_id for r in linked} == {3} and all(r.n_links == 3 and r.n_copies == 4 for r in linked)
    assert sum(r.is_kept for r in linked) == 2  # the two equal rows
    assert all(r.is_kept and r.class_id == r.doc_id for r in out if not r.n_links)
    assert near.plan_bands(0.8, 0.999, 5) == 18
    extra = spark.createDataFrame([(1, "a b c d e f", "x", 1)], "doc_id long, text string, row_key string, class_id int")
    assert near.near_duplicates(extra).first().class_id == 1


def test_near_duplicates_edges_grow_with_classes_only(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 32)
    counted, plain = [], near.components
    monkeypatch.setattr(near, "components", lambda edges: counted.append(edges.count()) or plain(edges))
    found = []
    for n in (100, 200):
        rng = random.Random(n)
        base = [f"x{i}" for i in range(300)]
        rows = [(i, " ".join([*base[:k], f"own{i}", *base[k:]])) for i, k in enumerate(rng.randrange(300) for _ in range(n))]
        out = near.near_duplicates(docs_of(spark, rows)).collect()
        assert {(r.class_id, r.n_links) for r in out} == {(0, n - 1)}
        found.append(counted[-2:])
    for small, large in zip(*found):  # 2 x the classes, 4 x their pairs
        assert large <= 2.6 * small


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(400, 400)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if n != 400 and any(n in e and e[0] != e[1] for e in edges)}


# -- line dedup -------------------------------------------------------------------------------------------------------


PASSAGE = "\n".join(" ".join(f"p{i}w{j}" for j in range(14)) for i in range(5))


def filler(seed, lines):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"f{seed}q{rng.randint(0, 10**9)}" for _ in range(rng.randint(3, 60))) for _ in range(lines))


def test_line_dedup_removes_passages_anywhere(spark):
    rows = [(k, "\n".join(x for x in (filler(2 * k, k % 4), PASSAGE, filler(2 * k + 1, (k + 1) % 3)) if x)) for k in range(40)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0  # the first occurrence stays
    for k in range(1, 40):
        left = [x for x in rows[k][1].split("\n") if x not in PASSAGE.split("\n")]
        assert out[k].text == "\n".join(left) and out[k].n_removed == 5


def test_line_dedup_leaves_clean_text(spark):
    short = "All rights reserved."
    rows = [(k, f"{filler(k + 100, 6)}\n{short}\n\n{filler(k + 500, 3)}") for k in range(30)]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert all(r.n_removed == 0 and r.text == rows[r.doc_id][1] for r in out)


def test_line_dedup_every_line_stays_somewhere(spark):
    rng = random.Random(5)
    pool = [" ".join(f"v{rng.randint(0, 10**9)}" for _ in range(rng.randint(5, 70))) for _ in range(30)]
    rows = [(k, "\n".join(pool[i] for i in sorted(rng.sample(range(30), 12)))) for k in range(40)]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    before, after = ({x for t in texts for x in t.split("\n")} for texts in ([t for _, t in rows], [r.text for r in out]))
    assert before == after - {""} and sum(r.n_removed for r in out) > 0
    for r in out:  # what is removed occurs elsewhere, too
        lines = rows[r.doc_id][1].split("\n")
        assert r.n_lines == len(lines) and len(r.text.split("\n") if r.text else []) == r.n_lines - r.n_removed


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (4, f"{PASSAGE}\n{PASSAGE}")]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert len(out) == 6
    by = {(r.doc_id, r.n_lines): r for r in out}
    assert by[1, 0].text is None and by[2, 1].text == "" and by[None, 5].n_removed == 0 and by[3, 5].n_removed == 5 and by[4, 10].n_removed == 10
    extra = spark.createDataFrame([(1, "x", "y", 2)], "doc_id long, text string, marks string, hash int")
    assert line_dedup.dedup_lines(extra, ("doc_id", "text", "marks")).first().asDict() == {"doc_id": 1, "text": "x", "marks": "y", "n_lines": 1, "n_removed": 0}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_removes_passages_of_short_lines(spark, seed):
    rng = random.Random(seed)
    rows, passages = [], {}
    for p in range(40):
        lines = [rng.choice(" \t").join(f"s{seed}p{p}l{i}w{j}" for j in range(rng.randint(3, 7))) for i in range(rng.randint(8, 20))]
        lines[5:5] = [""] * (p % 2)
        passages |= dict.fromkeys(range(4 * p, 4 * p + 4), lines)
        rows += [(k, "\n".join([filler(9000 + 1000 * seed + 2 * k, 1 + k % 3), *lines, filler(9001 + 1000 * seed + 2 * k, 1 + k % 2)])) for k in range(4 * p, 4 * p + 4)]
    for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect():
        assert r.n_removed == (len(passages[r.doc_id]) if r.doc_id % 4 else 0)


def test_line_dedup_copies_with_other_chunks_at_their_edges(spark):
    rows = []
    for p in range(150):
        lines = [" ".join(f"e{p}l{i}w{j}" for j in range(20)) for i in range(3)]
        rows += [(k, "\n".join([filler(20000 + 2 * k, 2), *lines, filler(20001 + 2 * k, 2)])) for k in range(4 * p, 4 * p + 4)]
    out = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {k: 3 if k % 4 else 0 for k in range(600)}


def test_line_dedup_against_brute_force(spark):
    """Passages of 50 words or more at random offsets, in lines of any length: every line of a later copy goes, and nothing else."""
    rng = random.Random(11)
    rows, want = [], {}
    for p in range(60):
        lines, words = [], 0
        while words < 50 or len(lines) < 2:
            n = rng.choice([1, 2, 5, 9, 15, 30, 48])
            lines.append(" ".join(f"b{p}l{len(lines)}w{j}" for j in range(n)))
            words += n
            if rng.random() < 0.2:
                lines.append("")
        while not lines[-1]:
            lines.pop()
        for k in range(3 * p, 3 * p + 3):
            before, after = filler(30000 + 2 * k, rng.randint(0, 4)), filler(30001 + 2 * k, rng.randint(0, 4))
            rows.append((k, "\n".join(x for x in (before, "\n".join(lines), after) if x)))
            want[k] = "\n".join(x for x in ((before, after) if k % 3 else (before, "\n".join(lines), after)) if x)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == want


def test_line_dedup_goes_by_chunks(spark, monkeypatch):
    """Without boundaries, no passage of several lines is found."""
    rows = [(k, f"{filler(40000 + 2 * k, 1)}\n{PASSAGE}\n{filler(40001 + 2 * k, 1)}") for k in range(4)]
    assert [r.n_removed for r in line_dedup.dedup_lines(docs_of(spark, rows)).orderBy("doc_id").collect()] == [0, 5, 5, 5]
    assert sum(r.n_removed for r in line_dedup.dedup_lines(docs_of(spark, rows), min_words=10**6).collect()) == 0


def test_line_dedup_counts_words_of_scripts_without_spaces(spark):
    passage = "\n".join("".join(chr(0x4E00 + (37 * i + j) % 20000) for j in range(12)) for i in range(6))
    rows = [(k, f"{filler(7000 + k, 2)}\n{passage}\n{filler(7100 + k, 1)}") for k in range(4)]
    assert [r.n_removed for r in line_dedup.dedup_lines(docs_of(spark, rows)).orderBy("doc_id").collect()] == [0, 6, 6, 6]


# -- decontamination --------------------------------------------------------------------------------------------------


def brute_decontam(rows, items, window=10):
    out = []
    for i, t in rows:
        w = words_of((t or "").encode())
        hit, found = set(), set()
        for item, text in items:
            q = words_of((text or "").encode())
            for p in range(max(1, len(q) - window + 1) if q else 0):
                part = q[p : p + window]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(15)] + ["É", "x"]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((30, 12, 10, 9, 3, 0, 25))] + [(50, None), (51, "v1 " * 14), (None, "v1 v2")]
    rows = []
    for k in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        if k % 3 == 0:
            src = items[k % 7][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = src[k % 5 :][: 6 + k % 20]
        rows.append((k, (", " if k % 2 else " ").join(words).upper() if k % 4 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, "v1 " * 40), (102, "v1 " * 40)]
    got = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute_decontam(rows, [i for i in items if i[0] is not None])


def test_decontamination_longest_match_and_edges(spark):
    item = " ".join(f"m{i}" for i in range(20))
    doc = "pre " + " ".join(f"m{i}" for i in range(3, 18)) + " post"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = decontam.decontaminate(docs_of(spark, [(1, doc)]), bench).first()
    assert (r.longest_match, r.longest_item, r.longest_start, r.n_hit) == (15, 7, 1, 15)
    none = bench.limit(0)
    assert decontam.decontaminate(docs_of(spark, [(1, doc)]), none).first().contaminated is False
    assert decontam.decontaminate(docs_of(spark, []), bench).count() == 0
    extra = spark.createDataFrame([(1, doc, "k"), (2, "fine", "k"), (3, None, "k")], "doc_id long, text string, spans string")
    assert [r.doc_id for r in decontam.clean_texts(extra, bench, ["doc_id", "text", "spans"]).orderBy("doc_id").collect()] == [2, 3]


def test_decontamination_in_passes_drops_the_same_texts(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(12)]
    rows = [(d, " ".join([f"d{d}a", *(items[d % 12][1].split()[5:17] if d % 3 == 0 else []), f"d{d}b"])) for d in range(40)] + [(99, None), (3, "plain text"), (3, "plain text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = [sorted((r.doc_id, r.text or "") for r in decontam.clean_texts(docs_of(spark, rows), bench, ["doc_id", "text"], 10, size).collect()) for size in (1 << 20, 700)]
    assert kept[0] == kept[1] == sorted((d, t or "") for d, t in rows if d % 3 or t in (None, "plain text"))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        seq = rng.integers(0, 3, n)
        assert decontam.suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def test_line_dedup_gives_back_the_shuffles_of_its_chunks(spark):
    passage = "\n".join(f"a line of the passage that recurs number {i} with more words" for i in range(5))
    since = spark._jsc.sc().newShuffleId()
    out = line_dedup.dedup_lines(docs_of(spark, [(1, f"own one\n{passage}"), (2, f"own two\n{passage}")]))
    assert shuffles_left(spark, since, spark._jsc.sc().newShuffleId()) == 0
    assert [(r.doc_id, r.n_removed) for r in out.orderBy("doc_id").collect()] == [(1, 0), (2, 5)]
