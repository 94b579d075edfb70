import hashlib
import random
import re

import numpy as np

from buildloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    t = text or ""
    w = UNIT.findall(t)
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    prefix, middle, suffix = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= 50:
        return doc_id, len(w), "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(w), form, len(prefix), len(middle), sha(out), sha(t)


def test_rank_and_select():
    r = np.random.default_rng(5)
    for n, share in ((0, 0.5), (1, 1.0), (63, 0.3), (64, 1.0), (512, 0.01), (513, 0.9), (70_000, 0.2), (70_000, 0.0005)):
        bits = r.random(n) < share
        b, at = fim.Bits(bits), np.arange(n + 1)
        assert (b.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (b.select(np.arange(1, bits.sum() + 1)) == np.flatnonzero(bits)).all()


def test_fim_equals_a_plain_version(make, odd):
    r = random.Random(3)
    pieces = ["a", "é", "漢字", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "<P", "<", "S>", "<M>", "<S>", ">", "word"]
    rows = odd + [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for i in range(100, 1500)] + [(i, "<P" * (i % 3) + " <S" * (i % 5) + " M>") for i in range(1500, 1600)]
    got = sorted(map(tuple, fim.digest(make(rows)).collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fim_outputs_and_options(make, odd):
    made = fim.transform(make(odd), seed=1, percent=100, spm_percent=0, marks=("[[p]]", "[[s]]", "[[m]]"))
    rows = made.withColumn("restored", fim.restore(made, ("[[p]]", "[[s]]", "[[m]]"))).collect()
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t in odd)
    assert {r["form"] for r in rows} == {"plain", "psm"} and all(r["output"].startswith("[[p]]") for r in rows if r["form"] == "psm")
    assert fim.transform(make(odd).limit(0)).count() == 0
