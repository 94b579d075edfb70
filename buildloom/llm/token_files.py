"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped or read by ranges.

Documents are dealt by ranges of doc_id, encoded and appended to one file triple for each partition in the shared
folder: NAME.bin (ids, 16 bits if the vocabulary allows, else 32), NAME.idx (64-bit offsets of documents in ids, and the
end) and NAME.doc (64-bit doc_ids; the least integer for null). A manifest row names the triple that the task's
successful attempt wrote, so repeated attempts don't matter, and prefix sums over the manifest give each partition's
first id in the whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import cut, fresh, parts, ship
from .packing import AT_ONCE, Encoder
from .text import buffers, pieces

CACHE_WORDS = 400_000
CACHE_CHARS = 64
NO_ID = -(2**63)
#: Bytes of text that go to one file; ids that are read back at once (a longer document is read whole).
FILE_BYTES = 256_000_000
READ_IDS = 8_000_000
#: How the tokenizer splits lower-cased text; and characters whose normal form and lower case are plain.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7E\u00A1-\u024F]*")
_LOADED: dict[str, tuple] = {}
#: The chain of a tokenizer whose texts may be cut at spaces and whose parts _PARTS gives.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def may_be_cut(path: str) -> bool:
    """Whether a tokenizer file has that chain, and added tokens that only pieces with <| can hold. Texts of any other go
    through the library whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    marks = all("<|" in t["content"] and " " not in t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    return marks and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}


def _encoder(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = (t, {} if may_be_cut(path) else None, {}, "uint16" if t.get_vocab_size() <= 1 << 16 else "uint32")
    return _LOADED[path]


def _alphabet() -> list[str]:
    """The character that the model's vocabulary has for each byte."""
    return [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]


def _encode_new(tok, known: dict[str, bytes], kind: str, pieces: list[str]) -> list[bytes]:
    """Packed ids of new pieces. In a piece of characters that are their own normal form (below U+0250, without white space
    or marks of special tokens), lower-casing and splitting are done here and the library's model encodes each distinct
    part; all other pieces go through the library's whole chain."""
    model, split, byte = tok.model.tokenize, _PARTS.findall, _alphabet()
    out: list[bytes | None] = []
    for w in pieces:
        if _PLAIN.fullmatch(w) and "<|" not in w:
            parts = split(w.lower())
            for p in parts:
                if p not in known:
                    seen = p if p.isascii() else "".join([byte[b] for b in p.encode()])
                    known[p] = np.array([t.id for t in model(seen)], kind).tobytes()
            out.append(b"".join([known[p] for p in parts]))
        else:
            out.append(None)
    rest = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(rest, tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
        out[i] = np.array(e.ids, kind).tobytes()
    return out


class Words(Encoder):
    """Token ids of many texts, each distinct piece between spaces (or line feeds) once: a tokenizer with the known chain never
    joins what a white space parts. Texts of any other go through the library whole."""

    def __init__(self, path: str):
        self.library, cache, self.parts, kind = _encoder(path)
        self.cuts, self.known, self.kind = cache is not None, {}, "<u2" if kind == "uint16" else "<u4"

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        first = np.zeros(len(data) + 1, bool)
        if self.cuts:
            first[: len(data)] = (data == 0x20) | (data == 0x0A)
        first[offs[:-1]] = True
        return np.flatnonzero(first[: len(data)])

    def lookup(self, distinct: list[bytes]) -> list[bytes]:
        if not self.cuts:
            return super().lookup(distinct)
        for held in (self.known, self.parts):
            if len(held) > CACHE_WORDS:
                held.clear()
        known, held = self.known, {}
        new = [c for c in distinct if c not in known]
        pieces = [(c[1:] if c[0] in b" \n" else c).decode("utf-8", "replace") for c in new]
        for c, ids in zip(new, _encode_new(self.library, self.parts, self.kind, pieces)):
            (known if len(c) <= CACHE_CHARS else held)[c] = ids
        return [known[c] if c in known else held[c] for c in distinct] if held else [known[c] for c in distinct]


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of each text."""
    words = _words(path)
    data, offs = buffers(pa.array(texts, pa.string()))
    ids, at = words.encode(data, offs, 0)
    return [ids[a : b - 1].astype(words.kind).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending doc_id order (null first; rows of one doc_id by text checksum); returns the
    manifest: part, name, kind, n_docs, n_tokens, base (the ids in all parts before). Null text is empty, so just end_id;
    repeated rows are written each; an empty table gives an empty manifest."""
    spark = docs.sparkSession
    ship(spark)
    out = out or fresh(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        *_, kind = _encoder(path)
        part = TaskContext.get().partitionId()
        files, root = _open(out)
        files.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids_of, offsets, last = [], [np.zeros(1, np.int64)], 0
        words = _words(path)
        with files.open_output_stream(f"{root}/{name}.bin") as f:
            for batch in batches:
                ids_of.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                whole, offs = buffers(batch.column(1))
                for i, j in pieces(offs, AT_ONCE):
                    ids, at = words.encode(whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
                    f.write(ids.astype(words.kind).tobytes())
                    offsets.append(last + at[1:])
                    last += int(at[-1])
        if not ids_of:
            return
        for suffix, arrays in (("idx", offsets), ("doc", ids_of)):
            with files.open_output_stream(f"{root}/{name}.{suffix}") as f:
                f.write(np.concatenate(arrays).astype("<i8").tobytes())
        row = [part, f"{out}/{name}", kind, sum(map(len, ids_of)), last]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "name", "kind", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(parts(spark), -(-size // FILE_BYTES)), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    manifest = cut(dealt.mapInArrow(run, "part long, name string, kind string, n_docs long, n_tokens long"), "manifest")
    # One row for each file goes through this window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.coalesce(1).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_back(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of ids as 32-bit integers)."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = _open(row["name"])
                mapped, kind = type(files).__name__ == "LocalFileSystem", np.dtype(row["kind"])

                def array(suffix: str) -> np.ndarray:
                    with files.open_input_file(f"{at}.{suffix}") as f:
                        return np.frombuffer(f.read(), "<i8")

                offs, docs = array("idx"), array("doc")
                ids = np.memmap(f"{at}.bin", kind.newbyteorder("<"), "r") if mapped else files.open_input_file(f"{at}.bin")
                i = 0
                while i < len(docs):
                    j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + READ_IDS, "right")) - 1), i + 5000, len(docs))
                    o = offs[i : j + 1]
                    # Where files can't be mapped, only the range of these documents is read.
                    some = ids[o[0] : o[-1]] if mapped else np.frombuffer(ids.read_at(int(o[-1] - o[0]) * kind.itemsize, int(o[0]) * kind.itemsize), kind.newbyteorder("<"))
                    sums = [zlib.crc32(some[a:b].astype("<u4")) for a, b in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist())]
                    who = docs[i:j]
                    cols = [pa.array(who, mask=who == NO_ID), pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    spread = manifest.repartition(parts(manifest.sparkSession), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
