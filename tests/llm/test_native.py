import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute
from pyspark.sql import functions as F

from buildloom.llm import exact_dedup, langid, mixing, ngram_join, sharding


def test_exact_dedup_odd(make, odd):
    got = exact_dedup.groups(make(odd)).collect()
    assert len(got) == len(odd)
    groups = defaultdict(list)
    for i, t in odd:
        groups[hashlib.sha256(brute.normal(t).encode()).hexdigest()].append(i)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    assert by.keys() == groups.keys()
    for sha, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in by[sha])
        assert {r["keep_id"] for r in by[sha]} == {least} and {r["group_size"] for r in by[sha]} == {len(ids)}
        kept = [r["doc_id"] for r in by[sha] if r["kept"]]
        assert kept == [least]


def test_exact_dedup_with_colliding_hashes(make, odd):
    """A hash that nearly all chunks share: identifiers are told apart by content."""
    weak = exact_dedup.groups(make(odd), identify=lambda c: F.pmod(F.length(c), F.lit(3)).cast("long"))
    strong = exact_dedup.groups(make(odd))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    key = lambda df: Counter(tuple(r) for r in df.select(cols).collect())
    assert key(weak) == key(strong)


def test_exact_dedup_rows(make, odd):
    docs = make(odd)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({brute.normal(t) for _, t in odd})
    assert exact_dedup.groups(make([(1, "a")]).limit(0)).count() == 0


def test_chunks_join_to_the_text(spark, make, odd):
    rows = make(odd).select(exact_dedup.normalised(F.col("text")).alias("n")).select("n", exact_dedup.chunks(F.col("n")).alias("c")).collect()
    assert all("".join(r["c"]) == r["n"] and all(len(c) <= 2048 for c in r["c"]) for r in rows)


def draw(key, name, weight):
    bits = int(hashlib.md5(f"{name}|{key}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight


def descend(key, tree):
    def best(nodes, path):
        return min(nodes, key=lambda n: (draw(key, f"{path}/{n}", nodes[n]) if len(nodes) > 1 else 0))

    path, left = "", tree
    for level in ("region", "rack"):
        nodes = {}
        for s in left:
            nodes[getattr(s, level)] = nodes.get(getattr(s, level), 0) + s.weight
        pick = best(nodes, path)
        left, path = [s for s in left if getattr(s, level) == pick], f"{path}/{pick}"
    return int(best({str(s.number): s.weight for s in left}, path))


def test_sharding(spark, make, odd):
    tree = sharding.even_tree()
    rows = odd + [(i, f"t{i}") for i in range(100, 1500)]
    got = sharding.digest(make(rows), tree).collect()
    assert len(got) == len(rows)
    bigger = sharding.grown(tree)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == descend(key, tree) and r["grown_shard"] == descend(key, bigger)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 16 and max(sizes.values()) < 2.2 * min(sizes.values())
    assert sharding.digest(make(rows).limit(0), tree).count() == 0


def test_weights_move_only_within_their_subtrees(spark):
    tree = sharding.even_tree()
    heavier = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else s.weight) for s in tree]
    df = spark.range(4000).withColumn("a", sharding.shard_of(F.col("id"), tree)).withColumn("b", sharding.shard_of(F.col("id"), heavier))
    region = {s.number: s.region for s in tree}
    moved = df.where("a <> b").collect()
    assert moved and all(region[r["b"]] == region[5] for r in moved)
    share = df.where("b = 5").count() / 4000
    assert abs(share - 3 / 18) < 0.03


def test_mixing(spark, make, odd):
    rows = [(*d, "en", s) for d, s in zip(odd, ["b", "a", None, "é", "a", "b", "a", "a", "b", None, "c", "c", "d", "d", "e", "e", "f", "f"])]
    rows += [(1000 + i, " ".join(["w"] * (i % 40)), "en", "abcdefgh"[i % 8] if i % 3 else "a") for i in range(900)]
    got = {(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.digest(make(rows)).collect()}
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(brute.words(t))
    targets = brute.water_fill(sizes)
    assert mixing.digest(make(rows)).count() == len(rows)
    taken, want = 0, 0
    for i, t, _, s in rows:
        if i is None or i < 1000 and i in (7, 14):
            continue
        n = len(brute.words(t))
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        assert (i, n, sizes[s], targets[s], n * copies) in {(a, b, c, d if abs(d - targets[s]) > 1e-6 else targets[s], e) for a, b, c, d, e in got if a == i}
    mixed = mixing.mix(make(rows))
    assert mixed.columns == make(rows).columns
    total = sum(len(brute.words(r["text"])) for r in mixed.select("text").collect())
    assert abs(total - sum(targets.values())) < 0.25 * sum(targets.values())
    again = Counter(r["doc_id"] for r in mixing.mix(make(rows)).collect())
    assert again == Counter(r["doc_id"] for r in mixed.collect())
    assert mixing.digest(make(rows).limit(0)).count() == 0 and mixing.mix(make(rows).limit(0)).count() == 0
    assert mixing.mix(make([(1, None), (2, "")])).count() == 0


def test_a_source_takes_what_its_target_is(make):
    rows = [(i, f"w{i} " * (1 + i % 9), "en", ("a", "b", None, "d")[i * i % 7 % 4]) for i in range(3000)]
    taken, target = Counter(), {}
    of = {r[0]: r[3] for r in rows}
    for r in mixing.digest(make(rows)).collect():
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) < 0.08 * t for s, t in target.items())


def test_own_columns_keep_their_values(make, odd):
    """Columns of documents named like anything that operators make come out as they went in."""
    names = ["__size", "__copies", "__copy", "__source", "__rate", "source_size", "__row", "__sha", "__id", "__stay_sha", "sha", "stay_id", "stay_sha", "__rid", "gone", "__gone", "component_id", "norm", "RID_"]
    docs = make(odd).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    for made in (mixing.mix(docs), exact_dedup.deduplicate(docs), ngram_join.keep_one(docs), langid.keep_known(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and rows
        assert all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" and r["target"] == "x" for r in rows for n in names)
