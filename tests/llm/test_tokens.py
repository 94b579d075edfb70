import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from buildloom.llm import bpe, token_files

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def fuzz():
    r = random.Random(1)
    letters = "AÉǅİĿŁȺaab bcé\n\t  ı漢字😀's0123<|endoftext|>\x1c\x85 ́ſtheing,.!ß"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "the " * 300, "<|endoftext|>x<|endoftext|>", " \n\n  a", "<|startoftext|> <|"]


def test_codec_equals_the_library(fuzz):
    ours, theirs = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    got = ours.encode_batch(fuzz)
    for t, g, e in zip(fuzz, got, theirs.encode_batch(fuzz, add_special_tokens=False)):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, t
        assert ours.decode(g) == theirs.decode(e.ids, skip_special_tokens=False)


def test_verification_agrees_with_merging():
    """Pairs that the array test passes are those that merging leaves as they are."""
    b = bpe.Bpe(BYTE)
    r = np.random.default_rng(4)
    x, y = r.integers(0, 50_000, (2, 4000))
    good = b.compatible(x, y)
    assert 0 < good.sum() < len(good)
    for i, j, g in zip(x.tolist(), y.tolist(), good.tolist()):
        assert (b.exact(b.token_bytes[i] + b.token_bytes[j]) == [i, j]) == g


def test_codec_query(make, odd):
    got = bpe.encode(make(odd), BYTE, ids=True).collect()
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), raw))
    key = lambda x: (str(x[0]), x[2])
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=key) == sorted(want, key=key)
    assert bpe.encode(make(odd).limit(0), BYTE).count() == 0


def test_word_encoder_equals_the_library(fuzz):
    t = Tokenizer.from_file(WORD)
    for g, e in zip(token_files.encode_texts(WORD, fuzz), t.encode_batch(fuzz, add_special_tokens=False)):
        assert np.frombuffer(g, "uint16").tolist() == e.ids


def test_files_round_trip(make, odd):
    rows = odd + [(i, f"text number {i} " * (i % 7)) for i in range(100, 400)]
    manifest = token_files.write(make(rows), WORD, 2)
    got = token_files.read_back(manifest).collect()
    t = Tokenizer.from_file(WORD)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    at, want = 0, []
    for i, text in ordered:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_files.read_back(token_files.write(make(odd).limit(0), WORD, 2)).count() == 0


def test_other_tokenizer_files(tmp_path, fuzz):
    """A file with another chain isn't taken for one that is known: the codec refuses it, token files go through the library."""
    with pytest.raises(ValueError):
        bpe.Bpe(WORD)
    assert token_files.may_be_cut(WORD) and not token_files.may_be_cut(BYTE)
    spec = json.loads(open(WORD, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a b"}, "content": "c"})
    other = str(tmp_path / "other.json")
    open(other, "w", encoding="utf-8").write(json.dumps(spec))
    t = Tokenizer.from_file(other)
    for g, e in zip(token_files.encode_texts(other, fuzz), t.encode_batch(fuzz, add_special_tokens=False)):
        assert np.frombuffer(g, "uint16").tolist() == e.ids


def test_files_by_size_and_by_ranges(make, odd, monkeypatch):
    """Small bounds: more files than shuffle partitions, and reading in many ranges, mapped and not."""
    import pyarrow.fs

    rows = odd + [(i, f"text number {i} " * (i % 7)) for i in range(100, 400)]
    want = sorted(map(tuple, token_files.read_back(token_files.write(make(rows), WORD, 2)).collect()), key=lambda x: x[1])
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    manifest = token_files.write(make(rows), WORD, 2)
    assert manifest.count() > 4
    assert sorted(map(tuple, token_files.read_back(manifest).collect()), key=lambda x: x[1]) == want

    class Remote:
        def __init__(self, at):
            self.files, self.at = pyarrow.fs.LocalFileSystem(), at

        def open_input_file(self, path):
            return self.files.open_input_file(path)

    monkeypatch.setattr(token_files, "_open", lambda uri: (Remote(uri), uri.removeprefix("file://")))
    assert sorted(map(tuple, token_files.read_back(manifest).collect()), key=lambda x: x[1]) == want
