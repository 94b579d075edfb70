"""Harmonic packing of token sequences into fixed capacities.

Lengths are partitioned into reciprocal-capacity classes: class k holds pieces of capacity / k tokens, and each of its bins
takes k pieces, so a bin is known by counting alone. Reciprocals that are whole numbers of tokens waste nothing; of a
capacity that is a power of two these are its halves, so a document is cut into as many full pieces as it has and the
halves that make up the rest, longest first. A piece's number within its class is its place in its task plus the pieces of
the tasks before, by prefix sums over a table of one row for each task and class. Tasks encode and number their pieces
independently; no text or token moves. The pieces that fill no bin of a class are grouped by the binary digits of their
number, so their sequences have powers of two as lengths as well: nothing is padded at all.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, small
from .text import buffers, pieces

#: Chunks that a worker remembers before it starts anew; longer ones are not remembered.
CACHE_CHUNKS = 700_000
CACHE_BYTES = 64
#: Bytes of text that are encoded at once (a longer document makes a larger piece of its own).
AT_ONCE = 8_000_000
#: ASCII characters by kind: 1 letters, 2 digits, 3 other printable ones, 4 line ends and tabs, 5 space; 0 is anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(0x21, 0x7F)]] = [1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(0x21, 0x7F)]
_KIND[9:14], _KIND[32] = 4, 5
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Token ids of many texts by the tokenizers library, each distinct chunk once.

    Texts are cut where a byte-level tokenizer with the usual pattern never joins what is before with what is after, as far
    as ASCII characters on both sides can tell: before white space that follows something else, at a space (or alone
    standing other white space) before something else, and between letters, digits and other characters unless an apostrophe
    comes before. A text that holds an added token, and each text of any other tokenizer, stays whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, added = spec.get("pre_tokenizer") or {}, spec["added_tokens"]
        self.cuts = not spec.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.added = [t["content"].encode() for t in added]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First bytes of chunks, those of texts that aren't empty among them."""
        first = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            kind = _KIND[data]
            solid, white, space = (kind > 0) & (kind < 4), kind >= 4, kind == 5
            at = first[: len(data)]
            at[1:] |= white[1:] & solid[:-1]
            before_solid = np.append(solid[1:], False)
            before_solid[offs[1:][offs[1:] > 0] - 1] = False  # the next text's first byte tells nothing
            at |= space & before_solid
            at[2:] |= solid[2:] & (kind[1:-1] == 4) & solid[:-2]
            at[1:] |= solid[1:] & solid[:-1] & (kind[1:] != kind[:-1]) & (data[:-1] != 0x27)
            raw = data.tobytes()
            for mark in self.added:
                found = raw.find(mark)
                while found >= 0:
                    row = int(np.searchsorted(offs, found, "right")) - 1
                    first[offs[row] : offs[row + 1]] = False
                    found = raw.find(mark, int(offs[row + 1]))
        first[offs[:-1]] = True
        return np.flatnonzero(first[: len(data)])

    def lookup(self, distinct: list[bytes]) -> list[bytes]:
        """The packed ids of each chunk."""
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known, held = self.known, {}
        new = [c for c in distinct if c not in known]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for c, e in zip(some, self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in some], add_special_tokens=False)):
                (known if len(c) <= CACHE_BYTES else held)[c] = np.array(e.ids, self.kind).tobytes()
        return [known[c] if c in known else held[c] for c in distinct] if held else [known[c] for c in distinct]

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and the texts' offsets in them."""
        start = self.starts(data, offs)
        bounds = np.append(start, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        packed = self.lookup(chunks.dictionary.to_pylist())
        packed.append(np.array([end_id], self.kind).tobytes())
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // flat.itemsize
        # The chunks of all texts in order, each text's end after its last one.
        index = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.searchsorted(start, offs[1:])
        index = np.insert(index, ends, len(packed) - 1)
        count = size[index]
        till = np.cumsum(count)
        begin = (np.cumsum(size) - size)[index]
        ids = flat[np.repeat(begin - (till - count), count) + np.arange(int(till[-1]) if len(till) else 0)].astype("<u4")
        return ids, np.concatenate([[0], till[ends + np.arange(len(ends))]])


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def split(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the pieces of sequences: full ones, then the powers of two that make up the rest; in order."""
    full, rest = lengths // capacity, lengths % capacity
    row = np.repeat(np.arange(len(lengths)), full)
    rows, begins = [row], [(np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)) * capacity]
    sizes = [np.full(len(row), capacity)]
    for b in range(capacity.bit_length() - 2, -1, -1):
        some = np.flatnonzero(rest >> b & 1)
        rows.append(some)
        begins.append((full * capacity + (rest >> (b + 1) << (b + 1)))[some])
        sizes.append(np.full(len(some), 1 << b))
    row, begin, size = (np.concatenate(x) for x in (rows, begins, sizes))
    order = np.lexsort((begin, row))
    return row[order], begin[order], size[order]


def cut_up(docs: DataFrame, path: str, end_id: int, capacity: int, ids: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part (the task), class (the binary logarithm of pieces in a bin), place
    (in the task's class) of each piece, and its ids as little-endian 32-bit integers if asked for."""
    top = capacity.bit_length() - 1
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "place"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(top + 1, np.int64)
        for batch in batches:
            whole, offs = buffers(batch.column("text"))
            for i, j in pieces(offs, AT_ONCE):
                flat, at = encoder.encode(whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
                total = np.diff(at)
                row, begin, size = split(total, capacity)
                kind = top - np.log2(size).astype(np.int64)
                place = np.empty(len(kind), np.int64)
                for c in range(top + 1):
                    mine = np.flatnonzero(kind == c)
                    place[mine] = seen[c] + np.arange(len(mine))
                    seen[c] += len(mine)
                raw = memoryview(flat.tobytes())
                spans = [raw[a:b] for a, b in zip((4 * (at[row] + begin)).tolist(), (4 * (at[row] + begin + size)).tolist())]
                cols = [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), pa.array(begin), pa.array(size), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(total[row]), pa.array(np.full(len(row), part, np.int64)), pa.array(kind.astype(np.int32)), pa.array(place)]
                if ids:
                    cols.append(pa.array([s.tobytes() for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, class int, place long" + ", ids binary" * ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids=True its
    ids. capacity is a power of two. Sequences are numbered from 0 without a gap, full ones of a class before its rest;
    every sequence has capacity tokens or a power of two below.

    Null text is empty, so just end_id. Rows are independent, rows of one id (or none) are documents of their own; an empty
    table gives an empty result; other columns are ignored. Which documents meet in a sequence depends on the tasks.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ship(docs.sparkSession)
    made = cut(cut_up(docs, path, end_id, capacity, ids, id_col, text_col), "pieces")
    held = cut(made.groupBy("part", "class").agg(F.count("*").alias("n")), "held")
    # A row for each task and class, and then for each class, goes through these windows.
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = held.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bins = F.expr("shiftright(n, class) + bit_count(n & (shiftleft(1L, class) - 1))")
    lower = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = held.groupBy("class").agg(F.sum("n").alias("n")).select("class", "n", F.coalesce(F.sum(bins).over(lower), F.lit(0)).alias("base"))
    bases = tasks.join(F.broadcast(classes), "class")
    placed = made.join(small(bases, held.count()), ["part", "class"]).withColumn("nth", F.col("before") + F.col("place"))
    # Beyond the full bins: q of m pieces are before this one. Its group is the highest binary digit of m that q lacks.
    placed = placed.withColumn("full", F.expr("shiftright(n, class)")).withColumn("m", F.expr("n & (shiftleft(1L, class) - 1)")).withColumn("q", F.expr("nth - shiftleft(full, class)"))
    digit = placed.withColumn("digit", F.expr("length(bin(q ^ m))"))  # one more than its number
    in_rest = F.expr("q >= 0")
    sequence = F.when(in_rest, F.expr("base + full + bit_count(shiftright(m, digit))")).otherwise(F.expr("base + shiftright(nth, class)"))
    inside = F.when(in_rest, F.expr("q - shiftleft(shiftright(m, digit), digit)")).otherwise(F.expr("nth & (shiftleft(1L, class) - 1)"))
    return digit.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), (inside * F.col("length")).alias("offset"), *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian 32-bit integers) and the pieces (offset, length, doc_id, start) of each
    sequence, from pack(..., ids=True). At most capacity pieces meet in a row."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    rows = packed.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("held", lambda x: x.dropFields("ids")).alias("pieces"))
