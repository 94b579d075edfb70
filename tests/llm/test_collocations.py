import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from buildloom.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cands = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        hidden = set()
        for g, a in cands.items():
            for m in range(2, len(g)):
                hidden |= {s for i in range(len(g) - m + 1) if 100 * a >= 80 * cands[s := g[i : i + m]]}
        rows = []
        for g in cands.keys() - hidden:
            s, _, l, r = min((2000000 * c[g] // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            rows.append((-s, -c[g], " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def prose(n, seed, vocabulary=40):
    r = random.Random(seed)
    names = [f"W{i}" if i % 3 else f"é{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    marks = [" ", " ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "\x85", "! ", " ", " "]
    return [("".join(x for w in r.choices(names, weights, k=r.randint(0, 60)) for x in (w, r.choice(marks))), r.choice(["en", "fr", "de", None, "und"])) for _ in range(n)]


def check(make, rows, least, top=2000):
    docs = make([(i, t, l) for i, (t, l) in enumerate(rows)])
    got = collocations.collocations(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_equals_a_plain_version(make):
    check(make, prose(300, 1) + [("a b a b a b a b a", "en"), ("x x x x x x x x x x", "en"), ("X x. X x", "en")], 4)


def test_top_and_ties(make):
    check(make, prose(200, 2), 3, 7)


def test_split_pivots_and_chunks(make, monkeypatch):
    """Pivots in many parts, bundles of few fragments, counting in small chunks: what parts count is added up."""
    rows = prose(150, 3) + [("hot pair " * 400, "en")] * 3
    monkeypatch.setattr(collocations, "SPLIT", 8)
    monkeypatch.setattr(collocations, "BUNDLE", 4)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "COUNTED", 50)
    monkeypatch.setattr(collocations, "TALLY", 10)
    check(make, rows, 4)
    monkeypatch.setattr(collocations, "SPLIT", 1 << 15)
    check(make, rows, 4)


def test_odd_rows(make, odd):
    check(make, [(t, "en" if i is None or i % 2 else None) for i, t in odd] * 2, 2)
    assert collocations.collocations(make(odd).limit(0)).count() == 0
    assert collocations.collocations(make([(1, None), (2, ""), (3, " .,\t")]), 1).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    """2000000 a passes 64 bits, and so does den f against num a."""
    big = 6_000_000_000_000_007
    grams = spark.createDataFrame([([1, 2], big), ([1, 2, 3], big // 5 * 4 + 1), ([2, 3], 40)], "words array<long>, n long")
    frequent = spark.createDataFrame([(1, big + 3), (2, big + 9), (3, big)], "key long, n long")
    scored = collocations.score(grams, frequent)
    got = {tuple(r["words"]): (r["score"], r["l"], r["r"]) for r in scored.collect()}
    n = {(1,): big + 3, (2,): big + 9, (3,): big, (1, 2): big, (2, 3): 40}
    for g in ((1, 2), (1, 2, 3), (2, 3)):
        a = dict(zip([(1, 2), (1, 2, 3), (2, 3)], [big, big // 5 * 4 + 1, 40]))[g]
        s, _, l, r = min((2000000 * a // (n[g[:k]] + n[g[k:]]), k, n[g[:k]], n[g[k:]]) for k in range(1, len(g)))
        assert got[g] == (s, l, r)
    inner = [tuple(r["words"]) for r in collocations.standing(scored).collect()]
    assert ((1, 2) in inner) == (100 * (big // 5 * 4 + 1) < 80 * big) and (2, 3) not in inner


@pytest.mark.parametrize("seed", range(3))
def test_each_occurrence_has_one_pivot(spark, seed):
    """The n-grams of all fragments are those of the text, whatever the order of words."""
    r = np.random.default_rng(seed)
    text = " ".join(f"w{x}" for x in r.integers(0, 6, 200))
    docs = collocations._plain(spark.createDataFrame([(text, "en")], "text string, lang string"), "text", "lang")
    levels = r.integers(20, 23, 1 << collocations.SKETCH_BITS).astype(np.uint8)
    counted = collocations.count_grams(collocations.fragments(docs, levels, 200), 1).collect()
    w = text.split()
    assert sum(x["n"] for x in counted) == sum(len(w) - m + 1 for m in (2, 3, 4))
    assert Counter(x["n"] for x in counted) == Counter(Counter(tuple(w[i : i + m]) for m in (2, 3, 4) for i in range(len(w) - m + 1)).values())
