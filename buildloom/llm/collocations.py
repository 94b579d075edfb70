"""Phrase collocation mining by pivot partitioning.

Texts are split at punctuation and line ends into pieces, pieces into words; a word's key is a 64-bit hash of its language
and letters, so languages never meet. Words are ordered by frequency (a sketch of fixed size, ties by key). An n-gram's
pivot is its rarest word, the first one if it repeats. For each word of a piece, the fragment goes to that word: what stands
around it as far as an n-gram can reach, without what is rarer than it, for such n-grams have other pivots, and cut at words
that are too rare for any phrase. So each occurrence of an n-gram is in the fragment of exactly one word, and all of an
n-gram's fragments go to the same pivot, where they are counted: an n-gram is looked at only if the shorter ones of its
pivot within it are frequent. Fragments of one pivot travel in bundles. A pivot that may have very many is split, and what
its parts count is added up.

Frequent n-grams are few against the corpus. Scores, and phrases that longer ones stand for, come from joins among them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, ship, small
from .text import buffers, mix, pieces, words

#: Words of a phrase at most; a fragment reaches one less to each side of its pivot.
LONGEST = 4
REACH = LONGEST - 1
#: Counters of the frequency sketch: its size doesn't grow with the documents.
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Steps of the sketch in each doubling of a frequency.
STEPS = 4
#: A pivot's fragments are split once they may be more than this many, and more than this part of a task's share of all.
SPLIT = 1 << 15
SHARE = 8
#: Fragments of a bundle, of a task's sort, and that are counted at once.
BUNDLE = 2048
HELD = 500_000
COUNTED = 500_000
#: Distinct words that a task adds up before it passes them on.
TALLY = 300_000
#: Top phrases are first ranked within this many parts of a language.
RANK_PARTS = 64
U = np.uint64
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _BREAKS.copy()
_BETWEEN[[0x20, 0x09]] = True


def keys(data: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that offs delimits: each word's key, row, piece (ascending), first byte and end."""
    row, h, start, end = words(data, offs, space=_BETWEEN)
    key = mix(h ^ lang[row]) if len(h) else h
    at = np.cumsum(_BREAKS[data])[start] if len(start) else start
    new = np.zeros(len(start), np.int64)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    return key, row, np.cumsum(new), start, end


def _plain(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"))


def word_counts(docs: DataFrame) -> DataFrame:
    """key, lang, word (lower-cased), n: each distinct word of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, U), np.zeros(0, np.int64)
        named: list[tuple[str, bytes]] = []

        def out() -> pa.RecordBatch:
            langs, texts = zip(*named)
            raw = pa.array([t.lower() for t in texts], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(langs, pa.string()), raw, pa.array(counts)], names=["key", "lang", "word", "n"])

        for b in batches:
            whole, offs = buffers(b.column("text"))
            lang, lang_key = b.column("lang"), b.column("lang_key").to_numpy().view(U)
            for i, j in pieces(offs):
                data = whole[offs[i] : offs[j]]
                key, row, _, start, end = keys(data, offs[i : j + 1] - offs[i], lang_key[i:j])
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                there = known[at] == key if len(known) else np.zeros(len(key), bool)
                counts[at[there]] += n[there]
                first, raw = first[~there], data.tobytes()
                new = [(lang[i + r].as_py(), raw[s:e]) for r, s, e in zip(row[first].tolist(), start[first].tolist(), end[first].tolist())]
                if new:
                    known, counts = np.concatenate([known, key[~there]]), np.concatenate([counts, n[~there]])
                    order = np.argsort(known)
                    named += new
                    known, counts, named = known[order], counts[order], [named[x] for x in order.tolist()]
                if len(known) > TALLY:
                    yield out()
                    known, counts, named = np.zeros(0, U), np.zeros(0, np.int64), []
        if len(known):
            yield out()

    found = docs.mapInArrow(run, "key long, lang string, word string, n long")
    return found.groupBy("key").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"))


def sketch(frequent: DataFrame) -> np.ndarray:
    """For each counter that keys are hashed to: 0, or 1 + STEPS times the binary logarithm of the largest frequency there."""
    step = 1 << (SKETCH_BITS - SKETCH_BLOCKS.bit_length() + 1)
    slot = F.shiftrightunsigned(F.col("key"), 64 - SKETCH_BITS)
    level = (1 + F.floor(F.log2("n") * STEPS)).cast("int")
    slots = frequent.groupBy(slot.alias("slot")).agg(F.max(level).alias("level")).withColumn("block", F.expr(f"slot div {step}"))

    def block(table: pa.Table) -> pa.Table:
        some = np.zeros(step, np.uint8)
        some[table.column("slot").to_numpy() % step] = table.column("level").to_numpy()
        return pa.table({"block": table.column("block").slice(0, 1), "levels": pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())})

    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in slots.groupBy("block").applyInArrow(block, "block long, levels binary").collect():
        levels[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return levels


def fragments(docs: DataFrame, levels: np.ndarray, n_words: int) -> DataFrame:
    """pivot, part, split, shapes, around: bundles of one pivot's fragments. A shape is 4 times the words before the pivot
    plus those after it; around holds these words' keys. split is into how many parts a pivot goes."""
    spread = docs.sparkSession.sparkContext.broadcast(levels)
    most = max(SPLIT, n_words // (SHARE * parts(docs.sparkSession)))
    names = ["pivot", "part", "split", "shapes", "around"]

    def cut_out(key: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        level = spread.value[(key >> U(64 - SKETCH_BITS)).astype(np.int64)]
        n = len(key)
        order = (level.astype(U) << U(56)) | (key >> U(8))
        piece = np.where(level > 0, piece, -1 - np.arange(n))
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        go_left, go_right = np.ones(n, bool), np.ones(n, bool)
        for d in range(1, REACH + 1):
            if n <= d:
                break
            near = piece[d:] == piece[:-d]
            go_left[:d], go_right[n - d :] = False, False
            go_left[d:] &= near & (order[:-d] > order[d:])
            go_right[: n - d] &= near & (order[d:] >= order[:-d])
            left += go_left
            right += go_right
        at = np.flatnonzero(left + right)
        left, right = left[at], right[at]
        size = left + right
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        where = np.repeat(at - left, size) + nth + (nth >= np.repeat(left, size))
        return key[at], (left * 4 + right).astype(np.uint8), level[at], key[where]

    def bundles(held: list[tuple[np.ndarray, ...]], salt: int) -> Iterator[pa.RecordBatch]:
        pivot, shape, level, around = (np.concatenate(x) for x in zip(*held))
        size = (shape >> 2).astype(np.int64) + (shape & 3)
        begin = np.cumsum(size) - size
        order = np.argsort(pivot, kind="stable")
        pivot, shape, level, size, begin = pivot[order], shape[order], level[order], size[order], begin[order]
        till = np.cumsum(size)
        around = around[np.repeat(begin - (till - size), size) + np.arange(len(around))]
        new = np.ones(len(pivot), bool)
        new[1:] = pivot[1:] != pivot[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(pivot)) - np.repeat(first, np.diff(np.append(first, len(pivot))))
        starts = np.flatnonzero(place % BUNDLE == 0)
        split = np.maximum(1, 2.0 ** (level[starts] / STEPS) // most).astype(np.int64)
        part = (mix(pivot[starts] + U(salt) * U(0x9E3779B97F4A7C15) + (place[starts] // BUNDLE).astype(U)) >> U(1)).astype(np.int64) % split
        bounds = np.append(starts, len(pivot))
        ends = np.append(0, till)[bounds] * 8
        for i in range(0, len(starts), 50_000):
            j = min(i + 50_000, len(starts))
            lists = []
            for offsets, values in ((bounds[i : j + 1], shape), (ends[i : j + 1], around.view(np.uint8))):
                own = np.ascontiguousarray(values[offsets[0] : offsets[-1]])
                lists.append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(own)]))
            cols = [pa.array(pivot[starts[i:j]].view(np.int64)), pa.array(part[i:j].astype(np.int32)), pa.array(split[i:j].astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, salt = [], 0, TaskContext.get().partitionId() << 20
        for b in batches:
            whole, offs = buffers(b.column("text"))
            lang_key = b.column("lang_key").to_numpy().view(U)
            for i, j in pieces(offs):
                key, _, piece, _, _ = keys(whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lang_key[i:j])
                held.append(cut_out(key, piece))
                n += len(held[-1][0])
                if n >= HELD:
                    yield from bundles(held, salt)
                    held, n, salt = [], 0, salt + 1
        if n:
            yield from bundles(held, salt)

    return docs.mapInArrow(run, "pivot long, part int, split int, shapes binary, around binary")


def count_chunk(pivot: np.ndarray, shape: np.ndarray, around: np.ndarray, partial: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of fragments, as rows of keys, and their counts: all of a pivot that is only partly here, else those that
    are frequent. Growing from the pivot, only fragments whose shorter n-grams are frequent are looked at."""
    left, right = (shape >> 2).astype(np.int64), (shape & 3).astype(np.int64)
    begin = np.cumsum(left + right) - left - right
    alive = {(0, 0): np.ones(len(pivot), bool)}
    for n in range(2, LONGEST + 1):
        for i in range(n):
            j = n - 1 - i
            go = (left >= i) & (right >= j)
            if i:
                go &= alive[i - 1, j]
            if j:
                go &= alive[i, j - 1]
            at = np.flatnonzero(go)
            first = begin[at] + left[at]
            gram = np.empty((len(at), n), U)
            for k in range(i):
                gram[:, k] = around[first - i + k]
            gram[:, i] = pivot[at]
            for k in range(j):
                gram[:, i + 1 + k] = around[first + k]
            h = np.full(len(at), U(i))
            for k in range(n):
                h = mix(h + gram[:, k] * U(2 * k + 3))
            _, one, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            good = (count >= least) | partial[at[one]]
            go[at] = good[which]
            alive[i, j] = go
            if good.any():
                yield gram[one[good]], count[good]


def count_grams(rows: DataFrame, least: int) -> DataFrame:
    """words (keys), n of n-grams that occur `least` times or more, from bundles of fragments."""

    def settle(held: list[pa.RecordBatch], open_first: int | None, open_last: int | None) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8)
        size = pa.compute.binary_length(table.column("shapes")).to_numpy()
        pivot = table.column("pivot").to_numpy().view(U)
        partial = table.column("split").to_numpy() > 1
        for x in (open_first, open_last):
            if x is not None:
                partial = partial | (pivot == U(x))
        for gram, count in count_chunk(np.repeat(pivot, size), flat("shapes"), flat("around").view(U), np.repeat(partial, size), least):
            n = gram.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gram) + 1, dtype=np.int32) * n), pa.array(gram.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(count.astype(np.int64))], names=["words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, opened = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += pa.compute.sum(pa.compute.binary_length(b.column("shapes"))).as_py()
            if n < COUNTED:
                continue
            # Whole pivots are counted, the last one waits for the next rows; one that fills all of this is counted in parts.
            table = pa.Table.from_batches(held).combine_chunks()
            pivot = table.column("pivot").to_numpy().view(U)
            last = int(np.flatnonzero(pivot != pivot[-1])[-1]) + 1 if (pivot != pivot[-1]).any() else 0
            if last:
                yield from settle(table.slice(0, last).to_batches(), opened, None)
                held, opened = table.slice(last).to_batches(), opened if opened == int(pivot[-1]) else None
            else:
                yield from settle(held, opened, int(pivot[-1]))
                held, opened = [], int(pivot[-1])
            n = sum(pa.compute.sum(pa.compute.binary_length(x.column("shapes"))).as_py() for x in held)
        if held:
            yield from settle(held, opened, None)

    dealt = rows.repartition(parts(rows.sparkSession), "pivot", "part").sortWithinPartitions("pivot", "part")
    counted = dealt.select("pivot", "split", "shapes", "around").mapInArrow(run, "words array<long>, n long")
    return counted.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _exact(n: Column) -> Column:
    """Counts as decimals, whose products don't overflow."""
    return n.cast("decimal(19,0)")


def score(grams: DataFrame, frequent: DataFrame) -> DataFrame:
    """words, a, l, r, score of each n-gram: floor(2000000 a / (l + r)) at the cut where that is least, the first of equal ones."""
    known = cut(grams.select("words", "n").union(frequent.select(F.array("key"), "n")), "frequent")
    rows = known.count()
    cuts = grams.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(words, 1, k)")).withColumn("rest", F.expr("slice(words, k + 1, size(words) - k)"))
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(small(known.select(F.col("words").alias(part), F.col("n").alias(n)), rows), part)
    value = F.expr("cast((2000000BD * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0)) as long)")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("words", "a").agg(best).select("words", "a", "best.l", "best.r", "best.score")


def standing(scored: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Without those that lie within a longer one of nearly their frequency: den f(longer) >= num a."""
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    within = scored.where(F.size("words") > 2).select("a", F.explode(inner).alias("words")).groupBy("words").agg(F.max("a").alias("longer"))
    kept = scored.join(within, "words", "left")
    return kept.where(F.col("longer").isNull() | (_exact(F.col("longer")) * den < _exact(F.col("a")) * num)).drop("longer")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `top` phrases of 2 to 4 words that occur `least` times or
    more, by score and a descending, then by phrase; n counts the language's words.

    Null text is empty, null lang is `und`. Every row counts, repeated ones too. A text without a frequent phrase gives
    nothing, an empty table an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    plain = _plain(docs, text_col, lang_col)
    counted = cut(word_counts(plain), "words")
    frequent = counted.where(F.col("n") >= least)
    n_words = counted.agg(F.sum("n")).first()[0] or 0
    rows = fragments(plain.where("text is not null"), sketch(frequent), n_words)
    grams = cut(count_grams(rows, least), "grams")
    kept = standing(cut(score(grams, frequent), "scored"))
    each = kept.select("*", F.posexplode("words").alias("i", "key"))
    # Only words of phrases are looked up, each language's words in one place each.
    spelled = each.join(small(frequent.select("key", "lang", "word"), frequent.count()), "key").groupBy("words", "a", "l", "r", "score")
    spelled = spelled.agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    phrases = spelled.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score", F.pmod(F.xxhash64("words"), F.lit(RANK_PARTS)).alias("bucket"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sizes = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    return ranked.join(small(sizes, sizes.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
