import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest

from buildloom.llm import connected, ngram_join, suffix_dedup, text


def corpus(seed=1, n=260):
    """Originals, near copies at many distances and chains of them, shared passages, short texts."""
    r = random.Random(seed)
    w = lambda m, v=600: [f"w{r.randint(0, v)}" for _ in range(m)]
    passage, line = w(70), w(12)
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and out:
            base = list(r.choice(out)[1].split())
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
                if base:
                    base[r.randrange(len(base))] = f"z{r.randint(0, 99999)}"
            out.append((i, " ".join(base)))
        elif kind < 0.6:
            t = w(r.randint(60, 200))
            at = r.randrange(len(t))
            out.append((i, " ".join(t[:at] + passage + t[at:])))
        elif kind < 0.7:
            out.append((i, " ".join(line * r.randint(1, 6))))
        elif kind < 0.85:
            out.append((i, " ".join(w(r.randint(1, 9), 4))))
        else:
            out.append((i, " ".join(w(r.randint(20, 300)))))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("k, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_join_equals_brute_force(make, k, num, den, seed):
    docs = corpus(seed)
    want = brute.near_groups(dict(docs), k, num, den)
    got = ngram_join.groups(make(docs), k, num, den).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(brute.shingles(t, k)) for i, t in docs}


def test_last_pass_alone_is_exact(make):
    """Without the rounds before it, the exact pass finds all groups."""
    docs = corpus(3, 150)
    got = ngram_join.groups(make(docs), 4, 85, 100, rounds=0).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.near_groups(dict(docs), 4, 85, 100)


def test_join_odd(make, odd):
    got = [(r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_join.groups(make(odd), 4, 85, 100).collect()]
    assert len(got) == len(odd)
    by = {}
    for i, c, n in got:
        by.setdefault(i, []).append((c, n))
    assert by[1][0][0] == by[2][0][0] == by[8][0][0] == 1
    assert sorted(by[None], key=str) == sorted([(1, by[1][0][1]), (None, 1)], key=str)  # the copy of 1, and the short text
    assert by[3] == [(3, 0)] and by[4] == [(4, 0)] and by[5] == [(5, 0)]
    assert by[6][0][0] == 6 and {c for c, _ in by[7]} == {6} and by[11][0][0] == by[12][0][0] == 11 and by[13][0][0] == 13 and by[14][0][0] in (13, 14)
    assert ngram_join.groups(make(odd).limit(0), 4, 85, 100).count() == 0


def test_keep_one(make):
    docs = corpus(4, 120)
    want = brute.near_groups(dict(docs), 5, 80, 100)
    kept = ngram_join.keep_one(make(docs))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}
    assert kept.columns == make(docs).columns


def test_keep_one_odd(make, odd):
    """Rows that share an id or have none go only if their own text is a copy; a group's one row stays, whatever its id."""
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(make(odd)).collect()), key=str)
    gone = [2, 7, 7, 8, 12]
    want = [(i, t) for i, t in odd if i not in gone and (i, t) not in [(None, odd[0][1]), (14, "A B C")]]
    assert kept == sorted(want, key=str) and (None, "alone text here") in kept and (14, "another text of the same id") in kept
    rows = [(None, "p q r s t u"), (None, "P Q R S T U"), (None, "quite another text"), (5, "five words are in here"), (5, "five words are in here"), (5, "no copy of any row")]
    kept = [r["text"].lower() for r in ngram_join.keep_one(make(rows)).collect()]
    assert sorted(kept) == sorted({t.lower() for _, t in rows})


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)]
    u = brute.Union({x for e in edges for x in e})
    for a, b in edges:
        u.link(a, b)
    got = {x["node"]: x["root"] for x in connected.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}
    assert connected.components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_repeats(docs, got):
    want = brute.repeats(dict(docs), suffix_dedup.MATCH)
    held = {i: brute.words(t, lower=False) for i, t in docs}
    covered = {}
    for m in got:
        assert m["n_words"] >= suffix_dedup.MATCH and m["doc_id"] != m["other_doc_id"]
        a, b = m["start_word"], m["other_start_word"]
        assert held[m["doc_id"]][a : a + m["n_words"]] == held[m["other_doc_id"]][b : b + m["n_words"]]
        covered.setdefault(m["doc_id"], set()).update(range(a, a + m["n_words"]))
    assert covered.keys() == want.keys()
    missed = sum(len(want[i] - covered[i]) for i in want)
    assert missed == 0
    assert not any(covered[i] - want[i] for i in want)


def test_passages(make):
    docs = corpus(5)
    check_repeats(docs, suffix_dedup.matches(make(docs)).collect())


def test_passages_whole(make):
    """No word of what documents share is left out, where one shares different stretches with different others."""
    for seed in (6, 7):
        docs = corpus(seed, 400)
        assert not missed(docs, suffix_dedup.matches(make(docs)).collect())


def test_passages_of_every_length(make):
    """A passage of 49 words isn't listed, one of 50 is, wherever it stands."""
    r = random.Random(2)
    docs = []
    for n in range(45, 70):
        p = [f"p{n}_{r.randint(0, 999)}" for _ in range(n)]
        for side in range(2):
            head, tail = ([f"h{n}{side}{x}{r.randint(0, 9999)}" for x in range(r.choice([0, 3, 40]))] for _ in range(2))
            docs.append((2 * n + side, " ".join(head + p + tail)))
    got = suffix_dedup.matches(make(docs)).collect()
    assert {m["doc_id"] for m in got} == {2 * n + s for n in range(50, 70) for s in range(2)}
    check_repeats(docs, got)


def missed(docs, got):
    want, covered = brute.repeats(dict(docs), suffix_dedup.MATCH), {}
    for m in got:
        covered.setdefault(m["doc_id"], set()).update(range(m["start_word"], m["start_word"] + m["n_words"]))
    return {i: x - covered.get(i, set()) for i, x in want.items() if x - covered.get(i, set())}


def test_passages_around_frequent_lines(make):
    """Two documents share a passage that holds a line which many other documents hold alone."""
    r = random.Random(8)
    w = lambda m: [f"u{r.randint(0, 10**9)}" for _ in range(m)]
    docs = []
    for n in range(8):
        line, head, tail = w(48), w(2), w(1 + n % 2)
        docs += [" ".join(w(40) + x + w(60)) for x in [head + line + tail] * 2 + [line] * 120]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = suffix_dedup.matches(make(docs)).collect()
    check_repeats(docs, got)
    assert not missed(docs, got)


def test_passages_of_a_hot_key(make):
    """Documents far apart share what follows a line that nearly all documents hold, so its key is cut between tasks and pieces."""
    r = random.Random(9)
    w = lambda m: [f"u{r.randint(0, 10**9)}" for _ in range(m)]
    hashes = lambda line: text.words(*text.buffers(pa.array([" ".join(line)])), lower=False)[1]
    line: list[str] = []
    while not line or np.argmin(text.shingles(np.zeros(28, int), hashes(line)[:28], suffix_dedup.GRAM)[1]):
        line = w(49)  # one whose first position is selected
    shared = w(12)
    docs = [(i, " ".join(line + ([shared[i % 300]] if i % 300 < 12 else w(1)) + w(1))) for i in range(600)]
    got = suffix_dedup.matches(make(docs)).collect()
    check_repeats(docs, got)
    assert not missed(docs, got)


@pytest.mark.parametrize("most", [3, 1000])
def test_cut_keys_go_on(most):
    """Wherever a key is cut, each of its contexts is handed on from each part."""
    n = 40
    rows = {"key": [7] * n, "context": [i // 10 for i in range(n)], "rid": list(range(n)), "pos": [5] * n}
    batches = [b.cast(pa.schema([("key", pa.int64()), ("context", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32())])) for b in pa.Table.from_pydict(rows).to_batches(2)]
    out = pa.Table.from_batches(suffix_dedup._linked(iter(batches), most)).to_pylist()
    gone_on = {x["a"] for x in out if x["b"] is None}
    assert {i // 10 for i in gone_on} == {0, 1, 2, 3} and {x["key"] for x in out if x["b"] is None} == {7}
    linked = {i for x in out if x["b"] is not None for i in (x["a"], x["b"])}
    assert linked | gone_on == set(range(n))


def test_passages_odd(make, odd):
    got = {(m["doc_id"], m["other_doc_id"]) for m in suffix_dedup.matches(make(odd)).collect()}
    ids = {a for a, _ in got}
    assert {1, 2, 6, 7, 8} <= ids and not ids & {3, 4, 5, 9, 10, 11, 12, 13, 14}
    assert suffix_dedup.matches(make(odd).limit(0)).count() == 0


def test_stretches(make, odd):
    """Every document's shared words, whole and once."""
    docs = corpus(8) + [(9000 + i, t) for i, (_, t) in enumerate(odd)]
    want = brute.repeats(dict(docs), suffix_dedup.MATCH)
    got = suffix_dedup.covered(suffix_dedup.matches(make(docs))).collect()
    held = {}
    for r in got:
        new = set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert not new & held.setdefault(r["doc_id"], set()) and r["start_word"] - 1 not in held[r["doc_id"]]
        held[r["doc_id"]] |= new
    assert held == {i: w for i, w in want.items() if w}


def test_hot_shingles_are_split(make, monkeypatch):
    """Small bounds: every shared shingle is split into parts and blocks, and the groups stay the same."""
    monkeypatch.setattr(ngram_join, "PART_BITS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    docs = corpus(9, 160)
    got = ngram_join.groups(make(docs), 4, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.near_groups(dict(docs), 4, 85, 100)


def test_stretches_by_row(make):
    """Rows without an id, or of one id, have stretches of their own."""
    base = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(base[:60] + ["x"] * 5)), (None, " ".join(base[10:120])), (1, " ".join(base[:70])), (1, " ".join(["y"] * 3 + base[60:120])), (1, " ".join(base[:70])), (2, "z " * 40)]
    want = brute.repeats(dict(enumerate(t for _, t in rows)), suffix_dedup.MATCH)
    runs = []
    for i, (doc_id, _) in enumerate(rows):
        at = sorted(want.get(i, ()))
        starts = [w for w in at if w - 1 not in at]
        runs += [(doc_id, w, next(e for e in range(w, 200) if e not in at) - w) for w in starts]
    got = suffix_dedup.covered(suffix_dedup.matches(make(rows))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, runs)) and len(runs) > 4


def test_repeating_texts_take_linear_time(make):
    """Texts that repeat a word, a phrase or a paragraph meet at very many distances: their stretches are found all the same."""
    r = random.Random(9)
    phrase, paragraph = " ".join(f"p{i}" for i in range(7)), " ".join(f"q{r.randint(0, 400)}" for _ in range(90))
    rows = [(1, "x " * 160_000), (2, "x " * 320_000), (3, "y " + "x " * 55 + "z"), (4, (phrase + " ") * 9000), (5, "a " + (phrase + " ") * 30 + "b"), (6, (paragraph + " ") * 300), (7, paragraph + " end"), (8, "c " + (paragraph + " c ") * 40)]
    began = time.time()
    got = suffix_dedup.matches(make(rows)).collect()
    assert time.time() - began < 60 and len(got) < 20_000
    want = [(1, 0, 160_000), (2, 0, 320_000), (3, 1, 55), (4, 0, 63_000), (5, 1, 210), (6, 0, 27_000), (7, 0, 90), *[(8, 1 + 91 * i, 90) for i in range(40)]]
    assert sorted(map(tuple, suffix_dedup.covered(suffix_dedup.matches(make(rows))).collect())) == want


def test_covering_equals_each_distance():
    """What is listed of repeating texts covers the words that comparing at each distance covers."""
    r = np.random.default_rng(2)
    for k in range(60):
        u, v = (np.concatenate([np.tile(r.integers(0, 3, r.integers(1, 60)), r.integers(1, 5)) for _ in range(4)]).astype(np.uint64) for _ in range(2))
        if k % 3 == 0:
            v = np.concatenate([v, u[5:90], v[:20]])
        every = {(p + i, q + i) for s in range(-len(v), len(u)) for p, n, q in suffix_dedup._aligned(u, v, s) for i in range(n)}
        some = suffix_dedup.compared(u, v, list(range(-len(v), len(u))))
        assert all(n >= suffix_dedup.MATCH and (u[p : p + n] == v[q : q + n]).all() for p, n, q in some)
        assert {p for p, _ in every} == {p + i for p, n, _ in some for i in range(n)} and {q for _, q in every} == {q + i for _, n, q in some for i in range(n)}
