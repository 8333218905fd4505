"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

1. From each line that isn't blank a run goes on until it has two such lines and `MIN_WORDS` words. A rolling hash is taken of
   the line hashes of each run, as a window slides over the lines. A line is a boundary, from which a chunk (its run)
   begins, where its hash is the least of those of the runs within some `PASSAGE_WORDS` words on end. So boundaries depend on nearby lines
   only: text that is inserted earlier doesn't shift them, and any passage of several lines with `PASSAGE_WORDS` words has a
   chunk within it. A line of `LONG_WORDS` words or more is a chunk by itself, too.
2. Fingerprints of chunks (hash, lines) are counted over all documents; each that occurs twice or more has a first
   occurrence, by doc_id.
3. The texts of later occurrences are compared byte by byte with the first one's. Where they are equal, the match is extended line
   by line, also by bytes, into the `PASSAGE_WORDS` words before and after the chunk, which reach from any chunk of a repeated passage
   to its next one and to its edges. What matches is removed but for blank lines at the ends, so the first occurrence of every line stays.

Fingerprints are pre-aggregated before their shuffle, occurrences meet their first one in a join that adaptive
execution can split, and lists are only ever gathered within one document, so a passage in a third of all documents
makes no hot task. Whole texts travel once, by row. Rows are told apart by doc_id and a 64-bit hash of all columns.

Words end at any white space; in lines with many letters beyond ASCII, `UNSPACED_CHARS` characters of scripts without spaces
count as a word.

A null text stays null and has no lines; an empty one has one empty line. Fully equal rows are one document: what
happens to one happens to all. Columns other than doc_id and text come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

MIN_WORDS = 16
PASSAGE_WORDS = 24
LONG_WORDS = 50
#: Lines that are looked at first; if they aren't enough, as many as there may be words.
NEAR_LINES = 4
#: Thai, Lao, Burmese, Khmer, kana, ideographs.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
UNSPACED_CHARS = 2


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Words of a line; without a regular expression where single spaces separate them and few letters are beyond ASCII."""
    size, bytes_ = F.length(line), F.octet_length(line)
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\r\x0b\x0c":
        odd |= F.contains(line, F.lit(blank))
    trimmed = F.trim(line)
    single = F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)
    plain, mixed = (F.regexp_count(line, F.lit(p)) for p in (r"\S+", rf"[{UNSPACED}]{{1,{UNSPACED_CHARS}}}|[^\s{UNSPACED}]+"))
    return F.when((bytes_ - size) * 4 > size, mixed).when(odd, plain).otherwise(single)


def _reach(full: Column, k: Column, words: int, least: int) -> Column:
    """The number of the first line from the k-th on, by which they are `least` and have so many words; null if none is."""
    w = [F.get(full, k + i)["w"] for i in range(NEAR_LINES)]
    out, total = F, w[0]
    for i in range(1, NEAR_LINES):
        total = total + w[i]
        if i + 1 >= least:
            out = out.when(total >= words, k + i)
    zero = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("seen"))
    step = lambda a, x: F.when(a["words"] >= words, a).otherwise(F.struct((a["words"] + x["w"]).alias("words"), (a["seen"] + 1).alias("seen")))
    # a line that isn't blank has a word, so as many lines as words are enough
    return out.otherwise(F.aggregate(F.slice(full, k + 1, words), zero, step, lambda a: F.when((a["words"] >= words) & (a["seen"] > 0), k + a["seen"])))


def _chunks(text: Column, min_words: int, passage_words: int, long_words: int) -> Column:
    """Chunks of a text: array of (hash, start, n, at, full); at: lines that aren't blank before it, full: those in it."""

    def of(lines: Column, full: Column) -> Column:
        hashes, size = F.transform(lines, lambda x: F.xxhash64(x)), F.size(full)

        def run(hashes: Column, x: Column, k: Column) -> Column:
            end = _reach(full, k, min_words, 2)
            return let(end, lambda end: F.when(end.isNotNull(), let(F.get(full, end)["i"] - x["i"] + 1, lambda n: F.struct(
                F.xxhash64(F.slice(hashes, x["i"] + 1, n)).alias("hash"), k.alias("k"), x["i"].alias("start"), n.alias("n"), end.alias("end"),
            ))))

        def least(runs: Column, k: Column) -> Column:
            """The run with the least hash of those that end by the line where the passage from here on has its words."""
            within = lambda some, last: F.array_min(F.filter(some, lambda r: r["end"] <= last))["k"]
            few = F.slice(runs, k + 1, NEAR_LINES)
            return let(F.coalesce(_reach(full, k, passage_words, 2), size - 1), lambda last: F.when(F.coalesce(F.get(runs, k + NEAR_LINES - 1)["end"], size) > last, within(few, last)).otherwise(within(F.slice(runs, k + 1, passage_words), last)))

        # runs that the text's end cuts off are null, and stand at the end
        runs = let(hashes, lambda h: F.filter(F.transform(full, lambda x, k: run(h, x, k)), lambda r: r.isNotNull()))
        begin = let(runs, lambda r: let(F.array_distinct(F.transform(r, lambda x, k: least(r, k))), lambda chosen: F.transform(chosen, lambda k: let(F.get(r, k), lambda x: F.struct(
            x["hash"].alias("hash"), x["start"].alias("start"), x["n"].alias("n"), k.alias("at"), (x["end"] - k + 1).alias("full"),
        )))))
        one = F.lit(1)
        alone = F.transform(F.filter(F.transform(full, lambda x, k: F.struct(x["i"].alias("i"), x["w"].alias("w"), k.alias("k"))), lambda x: x["w"] >= long_words), lambda x: F.struct(
            F.xxhash64(F.array(F.xxhash64(F.get(lines, x["i"])))).alias("hash"), x["i"].alias("start"), one.alias("n"), x["k"].alias("at"), one.alias("full"),
        ))
        return F.concat(begin, alone)

    return let(_lines(text), lambda lines: let(_full(lines), lambda full: of(lines, full)))


def _full(lines: Column) -> Column:
    """The lines that aren't blank: array of (i, w), number and words."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), _words(x).alias("w"))), lambda x: x["w"] > 0)


def _around(lines: Column, m: Column, words: int) -> Column:
    """Each mark with the lines before its chunk, nearest first, and those after it, until they have so many words."""
    none = F.array().cast("array<string>")

    def of(full: Column) -> Column:
        def reach(near: Column) -> Column:
            """The last of these lines that is needed, or null."""
            zero = F.struct(F.lit(0).alias("words"), F.lit(None).cast("int").alias("i"))
            step = lambda a, x: F.when(a["words"] >= words, a).otherwise(F.struct((a["words"] + x["w"]).alias("words"), x["i"].alias("i")))
            some = F.aggregate(F.slice(near, 1, NEAR_LINES), zero, step)
            return let(some, lambda a: F.when(a["words"] >= words, a).otherwise(F.aggregate(near, zero, step)))["i"]

        def one(x: Column) -> Column:
            end = x["start"] + x["n"]
            before = reach(F.reverse(F.slice(full, F.greatest(x["at"] - words + 1, F.lit(1)), F.least(x["at"], F.lit(words)))))
            after = reach(F.slice(full, x["at"] + x["full"] + 1, words))
            return F.struct(
                x.alias("m"),
                let(before, lambda b: F.when(b.isNotNull(), F.reverse(F.slice(lines, b + 1, x["start"] - b))).otherwise(none)).alias("before"),
                let(after, lambda b: F.when(b.isNotNull(), F.slice(lines, end + 1, b - end + 1)).otherwise(none)).alias("after"),
            )

        return F.transform(m, one)

    return let(_full(lines), of)


def _equal(one: Column, other: Column) -> Column:
    """How many first lines of two lists are equal, up to the last one that isn't blank."""
    same = F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = let(F.array_position(same, False), lambda p: F.when(p == 0, F.size(same)).otherwise(p - 1).cast("int"))
    full = F.transform(F.slice(one, 1, n), lambda x, i: F.when(F.length(F.trim(x)) > 0, i + 1).otherwise(0))
    return F.coalesce(F.array_max(full), F.lit(0))


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """The named columns of every row (doc_id and text among them), text without repeated passages, and n_lines, n_removed (lines)."""
    inner = {c: f"_in_{c}" for c in columns}  # the caller's names can't meet those used here
    inner |= {"doc_id": "doc_id", "text": "text"}
    plain = pick(docs, *columns).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).toDF(*(inner[c] for c in columns))
    key = F.xxhash64(*(inner[c] for c in columns))
    chunks = plain.where("text is not null").select(F.col("doc_id"), key.alias("row_key"), F.explode(_chunks(F.col("text"), min_words, passage_words, long_words)).alias("s")).select("doc_id", "row_key", "s.*")
    first = F.min(F.struct("doc_id", "row_key", "start")).alias("first")
    repeated = chunks.groupBy("hash", "n").agg(first, F.count(F.lit(1)).alias("times")).where("times > 1").select("hash", "n", "first")
    is_first = F.struct("doc_id", "row_key", "start").eqNullSafe(F.col("first")).alias("is_first")
    found = chunks.join(repeated, ["hash", "n"]).select("doc_id", "row_key", F.struct("start", "n", "hash", "at", "full", is_first).alias("s"))
    marks = cut(found.groupBy("doc_id", "row_key").agg(F.collect_set("s").alias("marks")).withColumnsRenamed({"doc_id": "mark_id", "row_key": "mark_key"}))

    of_row = lambda id_, key_: (key == F.col(key_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    placed = plain.join(marks, of_row("mark_id", "mark_key")).select("mark_id", "mark_key", F.explode(let(_lines(F.col("text")), lambda lines: F.transform(_around(lines, F.col("marks"), passage_words), lambda x: F.struct(
        x["m"].alias("m"), F.array_join(F.slice(lines, x["m"]["start"] + 1, x["m"]["n"]), "\n").alias("bytes"), x["before"].alias("before"), x["after"].alias("after"),
    )))).alias("x")).select("mark_id", "mark_key", "x.m.*", "x.bytes", "x.before", "x.after")
    firsts = placed.where("is_first").groupBy("hash", "n").agg(F.min(F.struct("bytes", "before", "after")).alias("of"))
    same = placed.where("not is_first").join(firsts, ["hash", "n"]).where(F.col("bytes") == F.col("of.bytes"))
    ranges = same.select(F.col("mark_id").alias("gone_id"), F.col("mark_key").alias("gone_key"), "start", "n", _equal(F.col("before"), F.col("of.before")).alias("back"), _equal(F.col("after"), F.col("of.after")).alias("ahead"))
    gone = ranges.groupBy("gone_id", "gone_key").agg(F.collect_set(F.struct((F.col("start") - F.col("back")).alias("start"), (F.col("start") + F.col("n") + F.col("ahead")).alias("end"))).alias("gone"))

    joined = plain.join(gone, of_row("gone_id", "gone_key"), "left")
    lines = _lines(F.col("text"))
    kept = let(F.sort_array("gone"), lambda g: F.filter(lines, lambda x, i: ~F.exists(g, lambda r: (i >= r["start"]) & (i < r["end"]))))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(kept)
    out = joined.select(*inner.values(), kept.alias("_kept"), F.size(F.coalesce(lines, F.array())).alias("_lines"))
    text = F.array_join("_kept", "\n")
    return out.select(*((text if c == "text" else F.col(inner[c])).alias(c) for c in columns), F.col("_lines").alias("n_lines"), (F.col("_lines") - F.size(F.coalesce("_kept", F.array()))).alias("n_removed"))
