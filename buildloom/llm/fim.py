"""Fill-in-middle transformation by rank and select on packed boundary bits.

A batch of texts is one string of bytes. One bit for each byte says whether a unit (a word with the white space before it,
or white space at the end of a text) ends there, another whether a character begins there. Both bitvectors are packed into
64-bit words with a directory of bits before each block of BLOCK words. A text's units are the popcount between its ends,
the byte where its k-th unit ends is select(rank(begin) + k), and a range's characters are a difference of two ranks: a few
array operations for all texts of a batch, whatever their lengths, and no text is split into a list of units.

Form and cuts are drawn from a hash of the seed and doc_id, so reruns and lost tasks give the same output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .text import _IS_SPACE, buffers, pieces

#: What stands before prefix, suffix and middle in an output.
MARKS = ("<P>", "<S>", "<M>")
#: 64-bit words of a directory's block.
BLOCK = 8


class Bits:
    """A packed bitvector that knows how many bits are set before each position, and where the k-th set bit is."""

    def __init__(self, bits: np.ndarray):
        n_blocks = len(bits) // (64 * BLOCK) + 1
        packed = np.zeros(n_blocks * BLOCK * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        count = np.bitwise_count(self.words).astype(np.int64).reshape(n_blocks, BLOCK)
        self.inside = np.cumsum(count, axis=1) - count  # set bits before each word of a block
        self.blocks = np.concatenate([[0], np.cumsum(count.sum(axis=1))])  # set bits before each block, and all

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before positions."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.blocks[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th set bits, from 1; each k must exist."""
        block = np.searchsorted(self.blocks, k, "left") - 1
        rest = k - self.blocks[block]
        word = (self.inside[block] < rest[:, None]).sum(axis=1) - 1
        rest = rest - self.inside[block, word]
        bits = np.unpackbits(self.words[block * BLOCK + word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * BLOCK + word) * 64 + (np.cumsum(bits, axis=1) < rest[:, None]).sum(axis=1)


def boundaries(data: np.ndarray, offs: np.ndarray) -> tuple[Bits, Bits]:
    """Of texts that offs delimits: the bytes that end a unit, and those that begin a character."""
    solid = ~_IS_SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = solid[:-1] & ~solid[1:]
    ends[offs[1:][offs[1:] > offs[:-1]] - 1] = True
    return Bits(ends), Bits((data & 0xC0) != 0x80)


def cuts(data: np.ndarray, offs: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: units, the bytes where prefix and middle end, and the characters of both."""
    ends, chars = boundaries(data, offs)
    base = ends.rank(offs[:-1])
    n = ends.rank(offs[1:]) - base
    first, last = (f(draws[0] % (n + 1), draws[1] % (n + 1)) for f in (np.minimum, np.maximum))
    at = []
    for k in (first, last):
        cut = offs[:-1].copy()
        some = k > 0
        cut[some] = ends.select((base + k)[some]) + 1
        at.append(cut)
    a, b, c = (chars.rank(x) for x in (offs[:-1], *at))
    return n, *at, b - a, c - b


def _hash(seed: int, doc_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    `percent` of the texts are cut at two drawn unit boundaries, `spm_percent` of these get the suffix first. Null text is
    empty. Texts that are empty or contain a mark stay plain, so an output can always be taken apart. Rows are independent:
    rows of one id get the same draws (a null id those of an empty one), an empty table gives an empty result, other columns
    are ignored. No text moves between tasks.
    """
    ship(docs.sparkSession)
    text, doc_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    draws = [F.conv(F.substring(F.col("hash"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = F.col("text").eqNullSafe("") | (draws[2] % 100 >= percent)
    for m in marks:
        plain = plain | F.contains(F.col("text"), F.lit(m))
    drawn = docs.select(doc_id.alias("doc_id"), text.alias("text"), _hash(seed, doc_id).alias("hash"))
    form = F.when(plain, "plain").when(draws[3] % 100 < spm_percent, "spm").otherwise("psm")
    asked = drawn.select("doc_id", "text", form.alias("form"), draws[0].alias("h1"), draws[1].alias("h2"))
    p, s, m = (x.encode() for x in marks)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offs = buffers(batch.column("text"))
            forms = np.asarray(batch.column("form").to_pylist(), object)
            for i, j in pieces(offs):
                o = offs[i : j + 1] - offs[i]
                data = whole[offs[i] : offs[j]]
                n, first, last, in_prefix, in_middle = cuts(data, o, [batch.column(h).to_numpy()[i:j] for h in ("h1", "h2")])
                raw, out = data.tobytes(), []
                for f, a, b, c, d in zip(forms[i:j], o[:-1].tolist(), first.tolist(), last.tolist(), o[1:].tolist()):
                    if f == "plain":
                        out.append(raw[a:d])
                    elif f == "psm":
                        out.append(b"".join([p, raw[a:b], s, raw[c:d], m, raw[b:c]]))
                    else:
                        out.append(b"".join([s, raw[c:d], p, raw[a:b], m, raw[b:c]]))
                is_plain = forms[i:j] == "plain"
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(n), batch.column("form").slice(i, j - i), *[pa.array(x, mask=is_plain) for x in (in_prefix, in_middle)], pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return asked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text of each row of transform(), from its output and form alone: a text in pieces holds each mark once."""
    p, s, m = marks
    out, head = made["output"], F.substring_index(made["output"], m, 1)
    middle = F.substring_index(out, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(made["form"] == "plain", out).when(made["form"] == "psm", psm).otherwise(spm)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(made), 256).alias("restored_sha256"))
