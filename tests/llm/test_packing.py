import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from buildloom.llm import packing

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n, seed):
    r = random.Random(seed)
    letters = ["A", "é", "a", "b", " ", " ", "  ", "\n", "\t", " \n", "ı", "漢", "😀", "'s", "0", "12", "<|endoftext|>", "\x1c", "\x85", "　", " ", "́", "the", "ing", ",", "."]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, "the " * 300, " \n\n  a", "   ", "x  ", "x \ny", "x\n \ny", ""]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    rows = texts(2500, 1)
    raw = [t.encode() for t in rows]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, at = packing.Encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), offs, 7)
    library = Tokenizer.from_file(path)
    for i, e in enumerate(library.encode_batch(rows, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == [*e.ids, 7], rows[i]


def whole(rows, got, capacity, end_id=0):
    """What holds for any packing: each id in one piece, no gap in a sequence, nothing to pad."""
    library = Tokenizer.from_file(BYTE)
    want, spans, held = Counter(), defaultdict(list), defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        held[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert sorted(spans) == list(range(len(spans)))
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        want[i, len(ids)] += 1
        raw = np.array(ids, "<u4").tobytes()
        mine = held[i, len(ids)]
        at = 0
        while at < len(ids):  # of repeated rows any one's piece will do
            start, n, crc = next(p for p in mine if p[0] == at and p[2] == zlib.crc32(raw[4 * p[0] : 4 * (p[0] + p[1])]))
            mine.remove((start, n, crc))
            at += n
    assert not any(held.values())
    assert Counter(r["length"] for r in got)[capacity] == sum(n // capacity * c for (_, n), c in want.items())


def test_packing_is_whole(make, odd):
    rows = odd + list(enumerate(texts(400, 2), 1000))
    whole(rows, packing.pack(make(rows).repartition(5), BYTE).collect(), 1024)
    assert packing.pack(make(odd).limit(0), BYTE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 13])
def test_few_rows_and_small_capacities(make, n):
    rows = [(i, "the cat " * (i * 5 % 17)) for i in range(n)]
    for capacity in (1, 8, 64):
        whole(rows, packing.pack(make(rows), BYTE, 3, capacity).collect(), capacity, 3)
    with pytest.raises(ValueError):
        packing.pack(make(rows), BYTE, capacity=1000)


def test_sequences_hold_the_ids(make, odd):
    packed = packing.pack(make(odd), BYTE, ids=True)
    rows = packing.sequences(packed).collect()
    library = Tokenizer.from_file(BYTE)
    assert sum(r["n_tokens"] for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd)
    for r in rows:
        assert len(r["ids"]) == 4 * r["n_tokens"] and sum(p["length"] for p in r["pieces"]) == r["n_tokens"]
    by = {(p["doc_id"], p["start"], p["length"]): bytes(r["ids"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])] for r in rows for p in r["pieces"]}
    assert all(by[r["doc_id"], r["start"], r["length"]] for r in packed.collect())
