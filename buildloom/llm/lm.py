"""Stupid-backoff scores of documents from n-gram counts over the whole corpus, each document left out of its own counts.

The vocabulary is open: words and n-grams are known by hashes, so every word counts as itself and no table of words is needed. Documents are exploded to n-grams in blocks of bounded size; a block's distinct n-grams, single words too, are
dealt to ranges of hashes, whose tables add up the counts of all blocks and answer each block with the totals of what it
asked for: a join of count tables with exploded n-grams in which a frequent n-gram costs one entry for each block, not one
for each occurrence. There are as many ranges as keep each within bounds, and a block and a range exchange a row only if they
share an n-gram, so rows never outnumber the blocks' distinct n-grams. Scores are then summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .text import _MIX, buffers, mix, pieces, words

ORDER = 3
BACKOFF = 0.4
#: Bounds: words of a block, n-grams of a hash partition.
BLOCK_WORDS = 2_000_000
PARTITION_GRAMS = 3_000_000
#: Bits of an n-gram's hash: of 10^12 different ones, one in 70,000 would share its hash and count with another.
HASH_BITS = 56
#: The hash of all words outside a closed vocabulary.
UNKNOWN = 0
NO_ID = -(2**63)
U = np.uint64


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = buffers(column)
    for i, j in pieces(offs):
        row, h, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, row, h


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h, n: how often each word (by hash) occurs, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settle():
            nonlocal keys, counts, held, size
            k, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
            both, inv = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(inv, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys, held, size = both, [], 0

        for b in batches:
            for _, _, _, h in _word_hashes(b.column(0)):
                held.append(h)
                size += len(h)
                if size > 4_000_000:
                    settle()
                    if len(keys) > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])
                        keys, counts = keys[:0], counts[:0]
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, most: int, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the words that occur at least so often that no more than `most` do."""
    counts = cut(word_counts(docs, text_col), "words")
    bucket = F.floor(F.log2("n") * 16).cast("int")
    by = sorted(((r["b"], r["k"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # 16 rows an octave
    kept, least = 0, None
    for b, k in by:
        if kept + k > most:
            break
        kept, least = kept + k, b
    if least is None:
        return np.zeros(0, U)
    return np.sort(counts.where(bucket >= least).select("h").toArrow().column("h").to_numpy().view(U))  # at most `most` rows


def _pack(x: np.ndarray) -> bytes:
    """The number of values; then all first bytes, all second ones, ..., each packed by itself behind its size (0: all zero)."""
    codec = pa.Codec("zstd", compression_level=3)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    packed = [codec.compress(p.tobytes(), asbytes=True) if p.any() else b"" for p in planes]
    return b"".join([len(x).to_bytes(8, "little"), *(y for p in packed for y in (len(p).to_bytes(8, "little"), p))])


def _unpack(b: bytes, kind: str) -> np.ndarray:
    codec, n, at = pa.Codec("zstd"), int.from_bytes(b[:8], "little"), 8
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for i in range(out.shape[1]):
        size = int.from_bytes(b[at : at + 8], "little")
        if size:
            out[:, i] = np.frombuffer(codec.decompress(b[at + 8 : at + 8 + size], n), np.uint8)
        at += 8 + size
    return out.view(kind).reshape(-1)


def blocks(docs: DataFrame, known: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, n (words), docs (ids), sizes (words of each), vocab (hashes of the block's distinct words, frequent ones first),
    ids (places of the words in it), packed; documents in the order of their task."""
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, block = None if sent is None else sent.value, TaskContext.get().partitionId() << 32
        who, sizes, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            vocab, ids, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            packed = [_pack(x) for x in (np.concatenate(who), np.concatenate(sizes), vocab[order], place[ids])]
            cols = [pa.array([block]), pa.array([len(ids)]), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(cols, names=["block", "n", "docs", "sizes", "vocab", "ids"])

        for b in batches:
            doc = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, j, r, h in _word_hashes(b.column(1)):
                if known is not None:
                    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    h = np.where(known[at] == h, h, U(UNKNOWN)) if len(known) else np.full(len(h), UNKNOWN, U)
                who.append(doc[i:j].astype("<i8"))
                sizes.append(np.bincount(r, minlength=j - i).astype("<i4"))
                held.append(h)
                size += len(h)
                if size >= BLOCK_WORDS:
                    yield row()
                    who, sizes, held, size, block = [], [], [], 0, block + 1
        if who:
            yield row()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "block long, n long, docs binary, sizes binary, vocab binary, ids binary")


def _grams(vocab: np.ndarray, ids: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions at which m words of one document end; the hashes of these n-grams, distinct and ascending, and how often
    each occurs; and for each position its n-gram's place among these."""
    short = U(64 - HASH_BITS)
    if m == 1:
        k, place = np.unique(vocab >> short, return_inverse=True)
        return np.arange(len(ids)), k, np.bincount(place[ids], minlength=len(k)), place[ids]
    at = np.arange(m - 1, len(ids))
    at = at[doc[at] == doc[at - (m - 1)]]
    key = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for j in range(m):
            key += (vocab * _MIX[j])[ids[at - j]]
    k, place, count = np.unique(mix(key) >> short, return_inverse=True, return_counts=True)
    return at, k, count, place


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int | None = None, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """doc_id, n_words, log_score (sum of the words' natural logarithms), mean_log_score (null without words) for each row.

    A word's score is its ORDER-gram's count over its context's, or BACKOFF times the score with a context shorter by a word
    if the count is 0; the last is the word's share of all words, with a count of BACKOFF for one seen nowhere else. The
    first words of a document have shorter contexts. Counts are those of all other documents. Null texts have no words;
    repeated rows count as documents each; an empty table gives an empty result; other columns are ignored.

    With most_words, the vocabulary is closed: only as many of the most frequent words are told apart, others are one word.
    """
    spark = docs.sparkSession
    ship(spark)
    known = None if most_words is None else vocabulary(docs, most_words, text_col)
    table = cut(blocks(docs, known, id_col, text_col), "blocks")
    total = table.agg(F.sum("n")).first()[0] or 0
    part_bits = int(np.ceil(np.log2(max(8, 2 * total // partition_grams))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                vocab, ids, sizes = _unpack(row["vocab"], "<u8"), _unpack(row["ids"], "<u4"), _unpack(row["sizes"], "<i4")
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for m in range(1, ORDER + 1):
                    _, key, count, _ = _grams(vocab, ids, doc, m)
                    part = key >> U(HASH_BITS - part_bits)
                    ends = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(key) else part
                    for i, j in zip(ends.tolist(), [*ends[1:].tolist(), len(key)]):
                        cols = [[int(part[i])], [row["block"]], [m], [_pack(np.diff(key[i:j], prepend=U(0)))], [_pack(count[i:j].astype("<u4"))]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "block", "m", "keys", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        out = []
        for m in range(1, ORDER + 1):
            rows = asked.filter(pa.compute.equal(asked.column("m"), m)).select(["part", "block", "keys", "counts"]).to_pylist()
            keys = [np.cumsum(_unpack(r["keys"], "<u8"), dtype=U) for r in rows]
            if keys:
                k, inv = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(inv, np.concatenate([_unpack(r["counts"], "<u4") for r in rows]), len(k)).astype("<i8")
                at = 0
                for r, x in zip(rows, keys):
                    got = sums[inv[at : at + len(x)]]
                    at += len(x)
                    wide = got.max() >= 1 << 32
                    out.append({"block": r["block"], "m": m, "part": r["part"], "wide": bool(wide), "totals": _pack(got if wide else got.astype("<u4"))})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("m", pa.int32()), ("part", pa.int64()), ("wide", pa.bool_()), ("totals", pa.binary())]))

    def tell(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        got: list[list[dict]] = [[] for _ in range(ORDER + 1)]
        for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
            got[r["m"]].append(r)
        for row in block.to_pylist():
            vocab, ids, sizes, who = _unpack(row["vocab"], "<u8"), _unpack(row["ids"], "<u4"), _unpack(row["sizes"], "<i4"), _unpack(row["docs"], "<i8")
            doc = np.repeat(np.arange(len(sizes)), sizes)
            # For each order and position: the count of the n-gram that ends there in other documents; -1: none ends there.
            others = np.full((ORDER + 1, len(ids)), -1, np.int64)
            for m in range(1, ORDER + 1):
                at, _, _, place = _grams(vocab, ids, doc, m)
                if not len(at):
                    continue
                totals = np.concatenate([_unpack(r["totals"], "<i8" if r["wide"] else "<u4").astype(np.int64) for r in got[m]])
                _, run, own = np.unique(doc[at] << 32 | place, return_inverse=True, return_counts=True)
                others[m, at] = totals[place] - own[run]
            rest = np.maximum(total - sizes, 1)[doc]
            s = np.where(others[1] > 0, others[1], BACKOFF) / rest
            for m in range(2, ORDER + 1):
                n, before = others[m], np.concatenate([[0], others[m - 1][:-1]])
                hit = n > 0
                s = np.where(hit, n / np.maximum(before, 1), np.where(n == 0, BACKOFF * s, s))
            sums = np.bincount(doc, np.log(s), len(sizes)) if len(ids) else np.zeros(len(sizes))
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            out.append(pa.table({"doc_id": pa.array(who, mask=who == NO_ID), "n_words": pa.array(sizes.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": mean}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64()))})

    asked = table.mapInArrow(ask, "part long, block long, m int, keys binary, counts binary")
    told = asked.groupBy("part").applyInArrow(answer, "block long, m int, part long, wide boolean, totals binary")
    blocks_by = table.withColumnRenamed("block", "of").groupBy("of")
    return blocks_by.cogroup(told.groupBy("block")).applyInArrow(tell, "doc_id long, n_words long, log_score double, mean_log_score double")
