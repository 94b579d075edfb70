import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from buildloom.llm import ann, langid, lm
from buildloom.llm.common import read


def test_language_accuracy(spark, sf_dir):
    docs = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    got = {r["doc_id"]: r for r in langid.digest(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(got) == len(rows) and right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 0.01 * len(rows)


def test_language_odd(make, odd):
    r = random.Random(3)
    say = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(80))
    rows = [(1000 + i, say(["ka", "to", "mi", "ra"]), "xx") for i in range(40)] + [(2000 + i, say(["schn", "erk", "ulf", "gam"]), "yy") for i in range(40)]
    rows += [(i, t, None) for i, t in odd] + [(3000, "1234 !!! 99", "yy"), (3001, " ".join("qzjxwvq" for _ in range(60)), None), (3002, say(["schn", "ulf"]), None)]
    docs = make(rows)
    got = langid.digest(docs).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == by[3000]["lang_pred"] == "und" and by[3]["score"] == 0.0
    assert by[3002]["lang_pred"] == "yy" and by[2003]["lang_pred"] == "yy" and by[1003]["lang_pred"] == "xx"
    assert by[3001]["rejected"] and not by[3002]["rejected"]
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {3, 4, 5, 3000, 3001}
    assert langid.digest(docs.limit(0)).count() == 0 and langid.keep_known(docs.limit(0)).count() == 0
    unlabelled = make([(1, "some text", None)])
    assert [tuple(x)[2:4] for x in langid.digest(unlabelled).collect()] == [("und", 0.0)]


def test_models_sum_to_one():
    """What a Kneser-Ney model gives to all symbols after a context is one, up to the share of unknown symbols."""
    r = random.Random(1)
    texts = ["".join(r.choice("abcde") for _ in range(6)) for _ in range(400)]
    m = langid.merge([("x", langid.fit(texts), (0.0, 0.0, 0.0))])
    total = 0.0
    for c in "abcde":
        lp, _ = m.log_probs(["ab" + c])
        total += math.exp(-lp[2, 0])
    lp, _ = m.log_probs(["ab"])
    total += math.exp(-lp[2, 0])
    assert 0.9 < total <= 1.0001


def test_models_equal_plain_kneser_ney():
    """Every symbol's probability under each of two languages is that of the definition."""
    r = random.Random(8)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))
    texts = {"x": [say("aabcde", 30) for _ in range(12)], "y": [say("defgöß", 30) for _ in range(12)]}
    models = langid.merge([(lang, langid.fit(t), (0.0, 0.0, 0.0)) for lang, t in texts.items()])
    asked = [say("abcdefgöz", 6) for _ in range(10)] + ["", "12 - 3", "A"]
    lp, row = models.log_probs(asked)
    for i, lang in enumerate(models.langs):
        p = brute.kneser_ney(texts[lang], langid.ORDER, langid.SYMBOLS)
        want = [[-math.log(p(s, (["\x01"] * 3 + list(w))[: n + 3])) for w in brute.re.findall(r"[^\W\d_]+", t.lower()) for n, s in enumerate([*w, "\x02"])] for t in asked]
        assert np.allclose(lp[:, i], [x for t in want for x in t], rtol=1e-4)
    assert np.bincount(row, minlength=len(asked)).tolist() == [len(t) for t in want]


def test_sample_is_spread():
    """Long texts don't make up a sample, and all of its characters are used."""
    texts = ["a" * 100_000, "b" * 50, *["c" * 400] * 10]
    got = langid.bounded(texts, 5000)
    assert got[1:] == texts[1:] and 900 <= len(got[0]) <= 1000 and langid.bounded(texts[1:], 5000) == texts[1:]


def test_without_labels(make):
    kept = langid.keep_known(make([(1, "some text", None), (2, None, None), (3, "12 !", None), (None, "other", None)]))
    assert sorted(r["text"] for r in kept.collect()) == ["other", "some text"]


def lm_brute(docs, most):
    held = {i: brute.words(t) for i, t in docs}
    c = Counter(w for x in held.values() for w in x)
    octave = lambda n: math.floor(math.log2(n) * 16)
    by = Counter(map(octave, c.values()))
    kept, least = 0, None
    for b in sorted(by, reverse=True):
        if kept + by[b] > most:
            break
        kept, least = kept + by[b], b
    known = {w for w, n in c.items() if least is not None and octave(n) >= least}
    held = {i: [w if w in known else None for w in x] for i, x in held.items()}
    grams = lambda x, m: Counter(tuple(x[j : j + m]) for j in range(len(x) - m + 1))
    table = [None] + [sum((grams(x, m) for x in held.values()), Counter()) for m in (1, 2, 3)]
    total = sum(table[1].values())
    out = {}
    for i, x in held.items():
        own = [None] + [grams(x, m) for m in (1, 2, 3)]
        n = lambda k: table[len(k)][k] - own[len(k)][k]
        s = 0.0
        for j in range(len(x)):
            f = 1.0
            for m in range(min(3, j + 1), 0, -1):
                k = tuple(x[j - m + 1 : j + 1])
                if m == 1:
                    s += math.log(f * (n(k) or lm.BACKOFF) / max(total - len(x), 1))
                elif n(k):
                    s += math.log(f * n(k) / n(k[:-1]))
                    break
                else:
                    f *= lm.BACKOFF
        out[i] = (len(x), s)
    return out


@pytest.mark.parametrize("most", [20, 10_000])
def test_backoff_scores(make, most):
    r = random.Random(6)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 120)))) for i in range(80)] + [(900, None), (901, ""), (902, "W1 w2 W1 w2 w1")]
    got = {x["doc_id"]: x for x in lm.score(make(docs), most_words=most, partition_grams=500).collect()}
    want = lm_brute(docs, most)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s, abs=1e-8)
        assert (got[i]["mean_log_score"] is None) == (n == 0)


def test_backoff_tells_all_words_apart(make):
    """More distinct words than 16 bits can number, all rare: none is merged with another."""
    docs = [(i, " ".join(f"r{i // 2}_{j}" for j in range(900)) + f" only{i} the the") for i in range(160)]
    got = {x["doc_id"]: x["log_score"] for x in lm.score(make(docs)).collect()}
    for i, (_, s) in lm_brute(docs, 10**9).items():
        assert got[i] == pytest.approx(s, abs=1e-6)


def test_backoff_odd(make, odd):
    got = lm.score(make(odd)).collect()
    assert len(got) == len(odd) and all(math.isfinite(r["log_score"]) for r in got)
    assert lm.score(make(odd).limit(0)).count() == 0


def exact_nearest(ids, x, k, every):
    out = {}
    for i in np.unique(ids[ids % every == 0]):
        q = x[np.flatnonzero(ids == i)[0]]
        s = x @ q
        s[ids == i] = -np.inf
        o = np.lexsort((ids, -s))[:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in o if np.isfinite(s[j])]
    return out


def test_nearest_recall(spark):
    table = read(spark, "/root/testdata/sf0.01", "embeddings")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = exact_nearest(ids, x, 20, 20)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        for _, v, s in found:
            assert s == pytest.approx(float(x[ids == v][0] @ x[ids == i][0]), abs=1e-12)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[i]})
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_odd(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist(), "x") for i in range(1, 60)]
    same = [0.5] * 6
    rows += [(100 + i, same, "x") for i in range(300)] + [(40, None, "x"), (80, [0.0] * 6, "x"), (None, same, "x"), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (520, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], "x"), (540, [1.0] * 5, "x"), (20, rows[19][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = {}
    for x in ann.search(table).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert {20, 100, 120} <= got.keys() and not got.keys() & {80, 500, 520, 540, None}
    copies = [v for _, v, _ in sorted(got[120])]
    assert copies[len(set(copies) & set(range(1, 60))) :] == [100 + i for i in range(300) if i != 20][: 20 - len(set(copies) & set(range(1, 60)))]
    above = sorted(i for i, e, _ in rows[:59] if i != 20 and sum(e) * 0.5 > 1.5)
    assert set(copies) & set(range(1, 60)) == set(above) and len(above) < 20
    few = spark.createDataFrame(rows[:5] + [(60, [1.0] * 6, "x")], "vec_id long, embedding array<double>, cell string")
    assert [x["rank"] for x in ann.search(few).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert ann.search(table.limit(0)).count() == 0


def test_nearest_among_mostly_invalid(spark):
    """Neither the sample nor the length is taken from vectors that take no part."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).tolist()) for i in range(100_000, 100_100)]
    bad = spark.range(0, 40_000, 1, 2).selectExpr("id AS vec_id", "CASE WHEN id % 3 = 0 THEN array() WHEN id % 3 = 1 THEN null ELSE array(0D, 0D, 0D) END AS embedding")
    table = bad.withColumn("embedding", bad["embedding"].cast("array<double>")).union(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(table).groupBy("query_id").count().collect()
    assert {x["query_id"]: x["count"] for x in got} == {i: 20 for i, _ in rows if i % 20 == 0}


def test_the_sample_is_of_the_whole_table(spark):
    table = spark.range(0, 200_000, 1, 8).selectExpr("id AS vec_id", "array(1D, id) AS vec")
    ids = [r["vec_id"] for r in ann.sample(table, 200_000).select("vec_id").collect()]
    assert len(set(ids)) == ann.SAMPLE
    share = np.bincount(np.array(ids) // 25_000, minlength=8) / len(ids)
    assert (abs(share - 1 / 8) < 0.01).all()


def test_recall_on_many_clustered_vectors(spark):
    """100,000 vectors in clusters, of which later rows have their own: all are learned from and found."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(400, 16)) * 2
    x = np.concatenate([centres[i // 250] + r.normal(size=16) * 0.4 for i in range(100_000)]).reshape(-1, 16)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 16), pa.int32()), pa.array(x.ravel()))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(100_000), "embedding": flat})).repartition(8)
    got = {}
    for row in ann.search(table, every=500).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    want = exact_nearest(np.arange(100_000), x, 20, 500)
    hits = sum(len(got[i] & {v for v, _ in want[i]}) for i in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("kind", ["small", "large", "groups"])
def test_recall_on_other_values(spark, kind):
    """Values that single precision can't hold, and groups of vectors so alike that they share their codes."""
    r = np.random.default_rng(6)
    n = 6000
    x = {"small": lambda: 1e-25 * r.normal(size=(n, 16)), "large": lambda: 1e25 * r.normal(size=(n, 16)), "groups": lambda: np.repeat(r.normal(size=(10, 16)), n // 10, 0) + 1e-12 * r.normal(size=(n, 16))}[kind]()
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 16), pa.int32()), pa.array(x.ravel()))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": flat}))
    got = {}
    for row in ann.search(table, every=100).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    want = exact_nearest(np.arange(n), x, 20, 100)
    assert got.keys() == want.keys() and sum(len(got[i] & {v for v, _ in want[i]}) for i in want) >= 0.9 * 20 * len(want)


def test_many_languages(make):
    """Two hundred languages: models are smaller each, and every language is told from the others."""
    r = random.Random(12)
    words = {f"l{i:03d}": ["".join(chr(0x4E00 + 40 * i + r.randint(0, 25)) for _ in range(r.randint(2, 5))) for _ in range(30)] for i in range(200)}
    rows = [(20 * i + j, " ".join(r.choices(w, k=40)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(12)]
    got = langid.digest(make(rows)).collect()
    lang = {i: l for i, _, l in rows}
    held = [x for x in got if x["held_out"]]
    assert len(got) == len(rows) and sum(x["lang_pred"] == lang[x["doc_id"]] for x in held) >= 0.97 * len(held) > 300


@pytest.mark.parametrize("cells", [0, 1000])
def test_sorted_tables_look_up_like_a_matrix(cells, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_CELLS", cells)
    r = np.random.default_rng(4)
    parts = [(np.unique(r.integers(0, 60, 25).astype(np.uint64)), None) for _ in range(5)]
    parts = [(k, r.random(len(k)).astype(np.float32)) for k, _ in parts]
    dense = np.full((60, 5), 7, np.float32)
    for i, (k, v) in enumerate(parts):
        dense[k.astype(int), i] = v
    wanted = r.integers(0, 60, 200).astype(np.uint64)
    assert (langid.Table.of(parts).look(wanted, 5, 7.0) == dense[wanted.astype(int)]).all()
