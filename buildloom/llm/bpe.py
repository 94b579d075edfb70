"""Byte-level BPE encoding and decoding by speculation and verification.

Speculate: each new word is cut greedily into the longest known tokens. Verify: a sequence of tokens is the word's BPE
encoding exactly if no merge crosses the boundary of any two neighbours, and that is tested for all pairs of all new
words at once with array operations. Only words in which a pair fails are merged step by step. Words repeat, so their
encodings are kept in a bounded cache for each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: How byte-level BPE splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 300_000
#: Longer words are not remembered.
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(spec: dict) -> None:
    """Raise unless a tokenizer file is what is worked out here: byte-level BPE with its own pattern, and nothing before it."""
    model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(o) for o in options):
        raise ValueError("only a plain BPE model is supported")
    if spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec["decoder"]["type"] != "ByteLevel":
        raise ValueError("only byte-level texts cut by the usual pattern are supported")
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that stand as they are are supported")


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(spec)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in t)
        for t, i in added.items():
            self.token_bytes[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = size
        self.byte_id = [0] * 256
        for i, t in enumerate(self.token_bytes):
            if len(t) == 1 and i not in added.values():
                self.byte_id[t[0]] = i
        # How and when each token comes about; -1: a single byte. A token that no merge makes can't be speculated on.
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        first = np.unique(made, return_index=True)
        self.rank[first[0]] = first[1]
        self.left[first[0]], self.right[first[0]] = left[first[1]], right[first[1]]
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        self.merge = {}
        for r, (k, m) in enumerate(zip(key.tolist(), made.tolist())):
            self.merge.setdefault(k, (r, m))
        usable = set(made.tolist()) | set(self.byte_id)
        self.longest = {self.token_bytes[i]: i for i in usable}
        self.reach = max(map(len, self.longest))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.marks = {t[0] for t in added}
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; a number above all ranks if there is none."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.key_rank[at], np.iinfo(np.int64).max - 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: no merge crosses their boundary.

        Time runs backwards: x is the token that ends at the boundary, y the one that begins there, each with the rank at
        which it is taken up in a larger one. The later of the two is undone in each step. They would have merged if
        their pair's rank comes before either is taken up; of equal ranks the leftmost goes first.
        """
        never = np.iinfo(np.int64).max
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_up, y_up = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            r = self.pair_rank(x, y)
            crossed = (r < np.iinfo(np.int64).max - 1) & (r < x_up) & (r <= y_up)
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, x_up, y_up, rx, ry = (v[go] for v in (live, x, y, x_up, y_up, rx, ry))
            undo = rx > ry
            x_up, y_up = np.where(undo, rx, x_up), np.where(undo, y_up, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def greedy(self, word: bytes) -> list[int]:
        longest, reach, out, i, n = self.longest, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach)
            while (t := longest.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, with a heap over a linked list."""
        tok = [self.byte_id[b] for b in word]
        n, size, merge = len(tok), self.size, self.merge
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := merge.get(tok[i] * size + tok[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i] if tok[i] == a else n
            if j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = made, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := merge.get(made * size + tok[k]):
                    heapq.heappush(heap, (m[0], i, made, tok[k], m[1]))
            if (h := prv[i]) >= 0 and (m := merge.get(tok[h] * size + made)):
                heapq.heappush(heap, (m[0], h, tok[h], made, m[1]))
        return [t for t in tok if t >= 0]

    def encode_words(self, new: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        raw = [w.encode() for w in new]
        guess = [self.greedy(w) for w in raw]
        count = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(count.sum()))
        end = np.cumsum(count)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[end[:-1] - 1] = False
        at = np.flatnonzero(inner)
        failed = at[~self.compatible(flat[at], flat[at + 1])]
        data = flat.astype("<u4").tobytes()
        out = [data[4 * (e - c) : 4 * e] for e, c in zip(end.tolist(), count.tolist())]
        for i in np.unique(np.searchsorted(end, failed, "right")).tolist():
            out[i] = np.array(self.exact(raw[i]), "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cache, split = self.cache, self.words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        cut: list[list[str]] = []
        marks = self.special
        for t in texts:
            if marks is not None and any(c in t for c in self.marks) and marks.search(t):
                cut.append([w for p in marks.split(t) if p for w in ([p] if p in self.added else split(p))])
            else:
                cut.append(split(t))
        cache.update(self.added)
        new = list({w for ws in cut for w in ws} - cache.keys())
        held: dict[str, bytes] = {}
        if new:
            for w, ids in zip(new, self.encode_words(new)):
                (cache if len(w) <= CACHE_CHARS else held)[w] = ids
        if held:
            return [b"".join([cache.get(w) or held[w] for w in ws]) for ws in cut]
        get = cache.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def decode(self, ids: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def runs(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in lists of about `most` characters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids themselves.

    Null text is empty: no ids. Rows are independent of each other; repeated rows give repeated results, an empty table
    an empty one; other columns are ignored. The vocabulary is read from path on each executor.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for texts in runs([t or "" for t in batch.column(1).to_pylist()]):
                got = bpe.encode_batch(texts)
                cols = [
                    batch.column(0).slice(at, len(texts)).cast(pa.int64()),
                    pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in got], pa.string()),
                ]
                if ids:
                    cols.append(pa.array(got, pa.binary()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
