"""Passages that documents share, by sparse suffix arrays.

Of the suffixes of all documents (sequences of words), those are retained that begin at positions which their content
selects: the minimum of a hash of the next GRAM words in any window of WINDOW positions. A passage of MATCH words or more
holds such a position near its beginning, the same in each document, with REACH of its words from there on. The retained
suffixes are sorted by a hash of their first REACH words, then by a hash of their context, all words that a range of MATCH
words around the position can hold. Neighbours of different documents whose context agrees are linked, and these share
every such range. Of each context only two documents (or all suffixes, if only one has it) go on to meet the other contexts
of their key: directly if they are few, otherwise by hashes of every range of MATCH words that the position was selected
for, of which neighbours are linked again. So documents that share MATCH words always meet, however many others share a
part of them. Linked documents are compared word for word and the match is extended to both sides. Sorts are by ranges of
(hash, document), so copies in very many documents spread over tasks; a key that is cut between tasks or pieces goes on
from each of its parts, as if their contexts differed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, ship
from .ngram_join import keyed
from .text import _M, _powers, buffers, mix, pieces, shingles, words

MATCH = 50
REACH = 28
GRAM = 6
WINDOW = MATCH - REACH + 1
#: So many suffixes of a key with different contexts are compared each with each; a piece of a key has at most HELD rows.
FEW = 4
HELD = 500_000
#: Documents that meet at more distances than this are compared by the passages that they have, not at each distance.
SHIFTS = 32
U = np.uint64


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each w neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out, have = best(out[:-have], out[have:]), have * 2
    more = w - have
    return best(out[: len(out) - more], out[more:]) if more else out


def selected(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Ascending positions whose next GRAM words have the least hash in a window within one document."""
    r, g = shingles(row, h, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = _slide(g, WINDOW, np.minimum)
    whole = (r[:n] >= 0) & (row[:n] == r[WINDOW - 1 :])
    least = np.where(whole, least, U(0))
    edge = np.zeros(WINDOW - 1, U)
    most = _slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum)  # the largest window minimum over each position
    return np.flatnonzero((most == g) & (r >= 0))


def _hash_range(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * down[a] ^ ((b - a).astype(U) * U(_M)))


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums, down


def suffixes(docs: DataFrame) -> DataFrame:
    """key (first REACH words), context (the first MATCH words and WINDOW - 1 before, or what there are), rid, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy()
            data, offs = buffers(b.column("text"))
            for i, j in pieces(offs):
                row, h, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=False)
                at = selected(row, h)
                n = np.bincount(row, minlength=j - i)
                end = np.cumsum(n)[row[at]] if len(at) else at
                fits = at + REACH <= end
                at, end = at[fits], end[fits]
                begin = end - n[row[at]]
                sums, down = _sums(h)
                left = np.maximum(at - WINDOW + 1, begin)
                context = mix(_hash_range(sums, down, left, np.minimum(at + MATCH, end)) + (at - left).astype(U) * U(_M))
                cols = [_hash_range(sums, down, at, at + REACH).view(np.int64), context.view(np.int64), rid[i:j][row[at]], (at - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "context", "rid", "pos"])

    return docs.select("rid", "text").mapInArrow(run, "key long, context long, rid long, pos int")


def ranges(docs: DataFrame) -> DataFrame:
    """key, rid, pos: hash, document and first word of each MATCH words that one of the positions `at` was selected for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy()
            lists, data, offs = b.column("at"), *buffers(b.column("text"))
            for i, j in pieces(offs):
                row, h, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=False)
                n = np.bincount(row, minlength=j - i)
                end = np.cumsum(n)
                mine = lists.slice(i, j - i)
                of = np.repeat(np.arange(j - i), mine.value_lengths().to_numpy())
                at = (end - n)[of] + mine.flatten().to_numpy()
                g = shingles(row, h, GRAM)[1]
                least = _slide(g, WINDOW, np.minimum)
                for k in range(0, len(at), 50_000):
                    p, o = at[k : k + 50_000, None], of[k : k + 50_000, None]
                    start = p - np.arange(WINDOW)
                    fits = (start >= (end - n)[o]) & (start + MATCH <= end[o])
                    fits &= least[np.where(fits, start, 0)] == g[p]
                    start = np.unique(start[fits])
                    sums, down = _sums(h)
                    cols = [_hash_range(sums, down, start, start + MATCH).view(np.int64), rid[i:j][row[start]], (start - (end - n)[row[start]]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rid", "pos"])

    return docs.select("rid", "text", "at").mapInArrow(run, "key long, rid long, pos int")


def _neighbours(key: np.ndarray, doc: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and, for each, the next row of another document with the same key in this order, or else the last one before."""
    k, d = key[order], doc[order]
    n = len(k)
    change = np.ones(n, bool)
    change[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    after = np.append(starts[1:], n)[run]
    before = starts[run] - 1
    safe_after, safe_before = np.minimum(after, n - 1), np.maximum(before, 0)
    forth = (after < n) & (k[safe_after] == k)
    back = ~forth & (before >= 0) & (k[safe_before] == k)
    mine = np.flatnonzero(forth | back)
    other = np.where(forth, safe_after, safe_before)[mine]
    return order[mine], order[other]


def _pairs(rid: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    swap = rid[x] > rid[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    all_of = np.stack([rid[x], rid[y], pos[x].astype(np.int64) - pos[y]], 1)
    all_of = np.unique(all_of, axis=0) if len(all_of) else all_of
    cols = [pa.array(all_of[:, 0]), pa.array(all_of[:, 1]), pa.array(all_of[:, 2].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(all_of), pa.int64()), pa.nulls(len(all_of), pa.int32())], names=["a", "b", "shift", "key", "pos"])


def _settle(cols: list[np.ndarray], first_open: bool, last_open: bool) -> Iterator[pa.RecordBatch]:
    """Of sorted rows the pairs, and the rows that must meet others of their key elsewhere; the first and last key may go on there."""
    key, context, rid, pos = cols
    n = len(key)
    if not n:
        return
    new_key = np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= context[1:] != context[:-1]
    k, c = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    x, y = _neighbours(c, rid, np.arange(n))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n) - 1
    # Two documents stand for a context, or all its rows if they are of one document.
    stands = (rid[starts] == rid[ends])[c]
    stands[starts] = stands[ends] = True
    begins = np.flatnonzero(new_key)
    more = (np.bincount(k[starts]) > 1) & (np.minimum.reduceat(rid, begins) != np.maximum.reduceat(rid, begins))
    few = np.bincount(k, stands) <= FEW
    goes_on = np.zeros(len(begins), bool)
    goes_on[0] |= first_open
    goes_on[-1] |= last_open
    at = np.flatnonzero(stands & (more & few & ~goes_on)[k])
    xs, ys = [x], [y]
    for j in range(1, FEW):
        u, v = at[:-j], at[j:]
        met = (k[u] == k[v]) & (rid[u] != rid[v])
        xs.append(u[met])
        ys.append(v[met])
    yield _pairs(rid, pos, np.concatenate(xs), np.concatenate(ys))
    at = np.flatnonzero(stands & (goes_on | more & ~few)[k])
    yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(key[at]), pa.array(pos[at])], names=["a", "b", "shift", "key", "pos"])


def _linked(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """A partition's sorted rows, key by key; a key of more than `most` rows in pieces."""
    held: list[np.ndarray] | None = None
    first_open = True
    for b in batches:
        cols = [b.column(n).to_numpy() for n in ("key", "context", "rid", "pos")]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([u, v]) for u, v in zip(held, cols)]
        cutoff = int(np.searchsorted(cols[0], cols[0][-1]))
        if cutoff == 0 and len(cols[0]) > most:
            yield from _settle(cols, True, True)
            held, first_open = None, True
            continue
        if cutoff:
            yield from _settle([c[:cutoff] for c in cols], first_open, False)
            first_open = False
        held = [c[cutoff:] for c in cols]
    if held is not None:
        yield from _settle(held, first_open, True)


def neighbours(docs: DataFrame) -> DataFrame:
    """a, b, shift: linked documents, a < b, and how many words further on the match is in a."""
    n_parts, schema = parts(docs.sparkSession), "a long, b long, shift int, key long, pos int"

    def linked(rows: DataFrame, label: str) -> DataFrame:
        order = ["key", "context", "rid", "pos"]
        return cut(rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _linked(batches), schema), label)

    def last(rows: pa.Table) -> pa.Table:
        key, rid, pos = (rows.column(n).to_numpy() for n in ("key", "a", "pos"))
        return pa.Table.from_batches([_pairs(rid, pos, *_neighbours(key, rid, np.lexsort((pos, rid))))])

    found = linked(suffixes(docs), "neighbours")
    asked = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.collect_set("pos").alias("at"))
    again = linked(ranges(docs.join(asked.hint("merge"), "rid")).withColumn("context", F.lit(0).cast("long")), "ranges")
    # Ranges that are cut between tasks or pieces: a few rows for each cut.
    across = again.where("b is null").groupBy("key").applyInArrow(last, schema)
    return found.where("b is not null").union(again.where("b is not null")).union(across).select("a", "b", "shift")


def _aligned(u: np.ndarray, v: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """start in u, words, start in v of the maximal matches of MATCH words or more where u is `shift` words behind v."""
    lo, hi = max(0, shift), min(len(u), len(v) + shift)
    if hi - lo < MATCH:
        return []
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = u[lo:hi] == v[lo - shift : hi - shift]
    turn = np.diff(same)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = end - begin >= MATCH
    return [(lo + p, q - p, lo + p - shift) for p, q in zip(begin[long].tolist(), end[long].tolist())]


def _extent(u: np.ndarray, v: np.ndarray) -> int:
    """How many words u and v have in common from their beginning."""
    at, step, most = 0, MATCH, min(len(u), len(v))
    while at < most:
        other = np.flatnonzero(u[at : at + step][: most - at] != v[at : at + step][: most - at])
        if len(other):
            return at + int(other[0])
        at, step = at + step, 2 * step
    return most


def _covering(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """start in u, words, start in v of matches that cover every word of u that is in a passage of MATCH words which v has
    too, from left to right: each as far as it goes, the next from the last shared passage that begins no later than its end."""
    if min(len(u), len(v)) < MATCH:
        return []
    grams = []
    for h in (u, v):
        sums, down = _sums(h)
        start = np.arange(len(h) - MATCH + 1)
        grams.append(_hash_range(sums, down, start, start + MATCH))
    theirs, first = np.unique(grams[1], return_index=True)
    at = np.minimum(np.searchsorted(theirs, grams[0]), len(theirs) - 1)
    shared = np.flatnonzero(theirs[at] == grams[0])
    out, i = [], 0
    while i < len(shared):
        p = int(shared[i])
        q = int(first[at[p]])
        n = _extent(u[p:], v[q:])
        if n >= MATCH:
            out.append((p, n, q))
        i = max(i + 1, int(np.searchsorted(shared, p + n, "right")) - 1)
    return out


def compared(u: np.ndarray, v: np.ndarray, shifts: list[int]) -> list[tuple[int, int, int]]:
    """start in u, words, start in v of matches of two documents' words. Documents that meet at more than SHIFTS distances
    repeat themselves, and share a passage in as many ways as they have words: of these, what covers each side."""
    if len(shifts) <= SHIFTS:
        return [m for s in shifts for m in _aligned(u, v, s)]
    return list(dict.fromkeys(_covering(u, v) + [(p, n, q) for q, n, p in _covering(v, u)]))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, other_doc_id, other_start_word, row, other_row: passages of MATCH words or more that two
    documents share, found in the sparse suffix array; each is listed from both sides. row tells rows of one id apart.

    Words are compared exactly, white space isn't. Null, empty and shorter texts share nothing. Rows that repeat an id, or
    have none, are documents of their own; a passage that only repeats within one row isn't listed. Of documents that share
    a passage every one is listed with some other that shares it, not with all; no word of it is left out. Passages are
    listed as far as they go, but of documents that repeat one passage many times only what covers each side. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    plain = keyed(docs, id_col, text_col)
    shifts = cut(neighbours(plain).groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")), "shifts")
    need = cut(shifts.select(F.col("a").alias("rid")).union(shifts.select(F.col("b").alias("rid"))).distinct(), "need")
    texts = cut(plain.join(need.hint("merge"), "rid", "left_semi").select("rid", "doc_id", "text"), "texts")
    met = shifts
    for side in "ab":
        met = met.join(texts.select(F.col("rid").alias(side), F.col("doc_id").alias(f"id{side}"), F.col("text").alias(f"t{side}")), side)
    names = ["doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "row", "other_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                x, y = (_word_lists(part.column(t)) for t in ("ta", "tb"))
                out: list[tuple[int | None, ...]] = []
                for u, v, ra, rb, ia, ib, ss in zip(x, y, *(part.column(c).to_pylist() for c in ("a", "b", "ida", "idb", "shifts"))):
                    for p, n, q in compared(u, v, ss):
                        out += [(ia, p, n, ib, q, ra, rb), (ib, q, n, ia, p, rb, ra)]
                cols = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return met.select("a", "b", "ida", "idb", "shifts", "ta", "tb").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def covered(found: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words: of matches, each row's longest stretches of words that others have too, in passages of
    MATCH words or more. What stretches cover doesn't depend on which documents were compared. Rows that repeat an id, or
    have none, each have stretches of their own."""
    ends = found.groupBy("row", "doc_id", "start_word").agg(F.max(F.col("start_word") + F.col("n_words")).alias("end"))
    order = Window.partitionBy("row").orderBy("start_word")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", F.coalesce(F.col("start_word") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("row", "doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end").alias("end"))
    return runs.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"))


def _word_lists(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    data, offs = buffers(column)
    for i, j in pieces(offs):
        row, h, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=False)
        out += np.split(h, np.cumsum(np.bincount(row, minlength=j - i))[:-1])
    return out
