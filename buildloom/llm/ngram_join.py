"""N-gram Jaccard self-join by multiple-global-order filtering, and its connected groups.

A document's set holds the distinct shingles of its lower-cased words. Sets that are equal form a class; one document
stands for it. For sets of a Jaccard similarity of num / den or more and any total order of all shingles, the first
n - ceil(n * num / den) + 1 shingles (the prefix) of the two share one. Each order here puts shingles of few documents
first, by a count sketch over all documents, and shuffles those of a like frequency by a hash of its own. Under the first
order, documents that share a prefix shingle become candidates; under every order, what the two prefixes share bounds the
overlap from above, and only pairs that no order rules out are verified on their texts. Shingles are known by 64-bit hashes.

The groups need no list of all pairs. Rounds of single comparisons (a document against the first one, or a neighbour, that
shares a prefix shingle) link most of a group at once. The last pass then compares all candidates whose documents are not
yet in one component, so no link between components is lost. A shingle that is in many prefixes is split: in the rounds its
documents meet their first one by a join and are otherwise dealt anew to parts of bounded size, in the last pass they form
blocks, and blocks meet two by two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, parts, release, ship, small, unused, written
from .connected import components
from .text import buffers, mix, pieces, shingle_sets, words

#: Orders that pairs are checked under besides the first, which finds them.
MORE_ORDERS = 2
#: A shingle's documents are split into parts once they may be more than 2^PART_BITS and a 2^PART_BITS-th of all documents.
PART_BITS = 10
#: Documents of a block in the last pass.
BLOCK = 512
#: Rounds end after one that links less than 1 / FEW of what the best round linked: the last pass finds the rest.
FEW = 20
#: Counters of the frequency sketch (a power of 2): its size doesn't grow with the documents.
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Null ids come after all others.
LAST = 9223372036854775807
_SEEDS = np.array([0x1F3D5B79A2C4E681, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B], np.uint64)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = buffers(column)
    for i, j in pieces(offs):
        row, h, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, *shingle_sets(row, h, k, j - i)


def survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: rid, doc_id, n, d1, d2 (set size and 128-bit digest of the set) for each row; and, for each
    counter that shingles are hashed to, the binary logarithm of how many documents' shingles fall on it."""
    width = 1 << SKETCH_BITS
    step = width // SKETCH_BLOCKS
    schema = "rid long, doc_id long, n long, d1 long, d2 long, block int, some int, counts binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def none(m: int, *kinds: pa.DataType) -> list[pa.Array]:
        return [pa.nulls(m, t) for t in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width, np.int32)
        for b in batches:
            for i, j, row, s in _sets(b.column("text"), k):
                m = j - i
                total += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width).astype(np.int32)
                n = np.bincount(row, minlength=m).astype(np.int64)
                ends = np.cumsum(n)
                acc = np.zeros(len(s) + 1, np.uint64)
                digests = []
                for seed in _SEEDS[2:4]:
                    np.cumsum(mix(s ^ seed), out=acc[1:])
                    digests.append(pa.array((acc[ends] - acc[ends - n]).view(np.int64)))
                cols = [b.column("rid").slice(i, m), b.column("doc_id").slice(i, m), pa.array(n), *digests, *none(m, pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if total.any():
            some = TaskContext.get().partitionId() % 16
            packed = [zlib.compress(total[i : i + step].astype("<i8").tobytes(), 1) for i in range(0, width, step)]
            cols = [*none(SKETCH_BLOCKS, *[pa.int64()] * 5), pa.array(np.arange(SKETCH_BLOCKS), pa.int32()), pa.array(np.full(SKETCH_BLOCKS, some), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), "<i8")
        packed = zlib.compress(total.tobytes(), 1)
        return pa.table({"block": table.column("block").slice(0, 1), "some": table.column("some").slice(0, 1), "counts": pa.array([packed], pa.binary())})

    both = cut(docs.mapInArrow(run, schema), "survey")
    part = "block int, some int, counts binary"
    sums = both.where("block is not null").select("block", "some", "counts").groupBy("block", "some").applyInArrow(add, part).groupBy("block").applyInArrow(add, part)
    total = np.zeros(width, np.int64)
    for r in sums.collect():  # SKETCH_BLOCKS rows
        total[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return both.where("block is null").select("rid", "doc_id", "n", "d1", "d2"), np.ceil(np.log2(total + 1)).astype(np.uint8)


def _prefixes(row: np.ndarray, s: np.ndarray, m: int, levels: np.ndarray, order: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, and of each row's prefix under an order the length and, for all rows, the ascending order keys."""
    n = np.bincount(row, minlength=m).astype(np.int64)
    key = (levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (mix(s ^ _SEEDS[order]) >> np.uint64(7))
    key = key[np.lexsort((key, row))].astype(np.int64)
    most = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
    place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
    return n, most, key[place < np.repeat(most, n)]


def postings(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray, n_docs: int) -> DataFrame:
    """key, rid, n, i, split: each prefix shingle under the first order, with its place in the prefix, and into how many
    parts its documents are split: 1 unless its counter shows that they may be too many. A counter shows no fewer documents
    than there are, and a shingle that many documents hold stands out from the counters' mean load at any size."""
    spread = docs.sparkSession.sparkContext.broadcast(levels)
    base = max(PART_BITS, int(np.ceil(np.log2(n_docs + 1))) - PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy()
            for i, j, row, s in _sets(b.column("text"), k):
                n, most, key = _prefixes(row, s, j - i, spread.value, 0, num, den)
                place = np.arange(len(key)) - np.repeat(np.cumsum(most) - most, most)
                split = 1 << np.maximum((key >> 57) - base, 0)  # a key begins with its counter's level
                cols = [key, np.repeat(rid[i:j], most), np.repeat(n, most).astype(np.int32), place.astype(np.int32), split.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "rid", "n", "i", "split"])

    return docs.select("rid", "text").mapInArrow(run, "key long, rid long, n int, i int, split int")


def candidates(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """rid, n, text, and the prefixes p1, ... under the further orders."""
    spread = docs.sparkSession.sparkContext.broadcast(levels)
    names = [f"p{i + 1}" for i in range(MORE_ORDERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, s in _sets(b.column("text"), k):
                lists = []
                for order in range(1, MORE_ORDERS + 1):
                    n, most, key = _prefixes(row, s, j - i, spread.value, order, num, den)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), pa.array(key)))
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(i, j - i), pa.array(n, pa.int32()), b.column("text").slice(i, j - i), *lists], names=["rid", "n", "text", *names])

    return docs.select("rid", "text").mapInArrow(run, "rid long, n int, text string, " + ", ".join(f"{p} array<long>" for p in names))


def _similar(inter: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    """Whether an overlap of `inter` makes sets of na and nb shingles similar enough."""
    return inter * (num + den) >= (na + nb) * num


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All lists' values, and the row that each belongs to."""
    lists = column.combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _not_ruled_out(x: pa.Table, y: pa.Table, num: int, den: int) -> np.ndarray:
    """Under every further order: what two prefixes share up to where both are known, and the smaller rest, bound the overlap."""
    na, nb = x.column("n").to_numpy().astype(np.int64), y.column("n").to_numpy().astype(np.int64)
    good = np.ones(len(na), bool)
    for i in range(MORE_ORDERS):
        (p, of_p), (q, of_q) = _flat(x.column(f"p{i + 1}")), _flat(y.column(f"p{i + 1}"))
        ends = [v[np.cumsum(np.bincount(of, minlength=len(na))) - 1] for v, of in ((p, of_p), (q, of_q))]  # prefixes ascend and aren't empty
        least = np.minimum(*ends)
        known = [np.bincount(of[v <= least[of]], minlength=len(na)) for v, of in ((p, of_p), (q, of_q))]
        both, of = np.concatenate([p, q]), np.concatenate([of_p, of_q])
        order = np.lexsort((both, of))
        both, of = both[order], of[order]
        common = np.bincount(of[1:][(both[1:] == both[:-1]) & (of[1:] == of[:-1])], minlength=len(na))
        bound = common + np.minimum(na - known[0], nb - known[1])
        good &= (common > 0) & (bound * (num + den) >= (na + nb) * num)
    return good


def _side_by_side(pairs: DataFrame, n_pairs: int, cands: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) that pass test(rows of a, rows of b); of the candidates only those in pairs move, to meet there."""
    sides = pairs.select("a", "b", F.posexplode(F.array("a", "b")).alias("side", "rid"))
    met = cands.select("rid", *columns).join(small(sides, 2 * n_pairs), "rid").select("a", "b", "side", *columns)
    met = met.repartition(parts(pairs.sparkSession), "a", "b").sortWithinPartitions("a", "b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            part = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            whole = part.num_rows // 2 * 2
            held = part.slice(whole) if whole < part.num_rows else None
            for at in range(0, whole, 512):
                some = part.slice(at, min(512, whole - at)).combine_chunks()
                first, last = (some.take(pa.array(np.arange(i, some.num_rows, 2))) for i in (0, 1))
                keep = pa.array(test(first, last), pa.bool_())
                yield pa.RecordBatch.from_arrays([first.column(c).combine_chunks().filter(keep) for c in ("a", "b")], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, cands: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of row ids whose sets are similar: checked on prefixes under every further order, then on whole texts."""
    names = [f"p{i + 1}" for i in range(MORE_ORDERS)]

    def by_prefixes(x: pa.Table, y: pa.Table) -> np.ndarray:
        return _not_ruled_out(x, y, num, den)

    def by_texts(x: pa.Table, y: pa.Table) -> list[bool]:
        sides = ([v for i, j, row, s in _sets(t.column("text"), k) for v in np.split(s, np.cumsum(np.bincount(row, minlength=j - i))[:-1])] for t in (x, y))
        return [len(np.intersect1d(u, v, assume_unique=True)) * (num + den) >= (len(u) + len(v)) * num for u, v in zip(*sides)]

    asked = cut(pairs.select("a", "b"), "pairs")
    left = cut(_side_by_side(asked, asked.count(), cands, ["n", *names], by_prefixes), "pairs")
    out = cut(_side_by_side(left, left.count(), cands, ["text"], by_texts), "links")
    drop(asked, left)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, text: rid is the doc_id where all are there and differ; otherwise rows are numbered and written."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return plain.withColumn("rid", F.col("doc_id"))
    return cut(plain.withColumn("rid", F.monotonically_increasing_id()), "keyed")


def groups(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Null texts and texts without words have no shingles and are linked with nothing; a text of fewer than k words is one
    shingle. Rows of equal sets are linked, repeated rows too. Null doc_ids don't name a group unless all of it are null.
    An empty table gives an empty result; other columns are ignored.
    """
    found = _grouped(keyed(docs, id_col, text_col), k, num, den, rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(plain: DataFrame, k: int, num: int, den: int, rounds: int = 3) -> DataFrame:
    """rid, doc_id, n, component_id and keep (the rid of a row of the group with that id; null, like component_id, if n is 0)."""
    ship(plain.sparkSession)
    signed, levels = survey(plain, k)
    first = F.min_by("rid", F.coalesce(F.col("doc_id"), F.lit(LAST)))
    classes = cut(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"), first.alias("keep")), "classes")
    links = class_links(classes, plain, k, num, den, levels, rounds)
    rooted = classes.join(components(links).withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min_by("keep", F.coalesce(F.col("first"), F.lit(LAST))).alias("keep"))
    known = rooted.drop("keep").join(named, "root").select("d1", "d2", "n", "component_id", "keep")
    return signed.select("rid", "doc_id", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left").select("rid", "doc_id", "n", "component_id", "keep")


def class_links(classes: DataFrame, plain: DataFrame, k: int, num: int, den: int, levels: np.ndarray, rounds: int) -> DataFrame:
    """Links (a, b) between classes, by the rids of their representatives, that connect all that links connect."""
    parts_of = lambda turn: F.when(F.col("split") > 1, F.pmod(F.xxhash64("rid", F.lit(turn)), F.col("split"))).otherwise(F.lit(0)).cast("int")

    def met_often(rows: DataFrame, turn: int) -> DataFrame:
        """Of postings those whose key is in two or more; a key that is split may stay without need."""
        often = (F.count(F.lit(1)).over(Window.partitionBy("key", "part")) > 1) | (F.col("split") > 1)
        return rows.withColumn("part", parts_of(turn)).withColumn("often", often).where("often").drop("often", "part")

    posted = met_often(postings(plain, k, num, den, levels, classes.count()), -1)
    # Only shingles that the prefixes of two classes share, and the documents that have any.
    shared = cut(met_often(posted.join(classes.select("rid"), "rid", "left_semi"), -2), "shared")
    need = cut(shared.select("rid").distinct(), "need")
    cands = cut(candidates(plain.join(need.hint("merge"), "rid", "left_semi"), k, num, den, levels), "cands")
    root, most_new = None, 0
    least, most = F.least("n", "n2"), F.greatest("n", "n2")
    fits = (least * den >= most * num) & _similar(F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")), F.col("n"), F.col("n2"), num, den)
    for turn in range(rounds):
        here = (shared.withColumn("root", F.col("rid")) if root is None else _with_root(shared, root)).withColumn("part", parts_of(turn))
        met = _met_first(here) if turn == 0 else _met_neighbour(here, turn)
        pairs = met.where((F.col("root") != F.col("root2")) & fits).groupBy("rid", "rid2").agg(F.count(F.lit(1)).alias("times"))
        best = pairs.groupBy("rid").agg(F.max_by("rid2", F.struct("times", -F.col("rid2"))).alias("rid2"))
        found = verify(best.select(F.greatest("rid", "rid2").alias("a"), F.least("rid", "rid2").alias("b")).distinct(), cands, k, num, den)
        links, before = found if root is None else root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), root
        since = written()
        root = cut(components(links), "roots")
        release(since, root)
        new = found.count()
        drop(found, *([] if before is None else [before]))
        most_new = max(new, most_new)
        if new * FEW < most_new:
            break
    # What is left: all candidates between different components.
    if root is None:
        root = docs_alone(classes)
    here = _with_root(shared, root)
    mixed = here.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("docs")).where("r0 <> r1").select("key", "docs")
    return root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verify(_blocks_met(here.join(mixed, "key"), fits), cands, k, num, den))


def _met_first(here: DataFrame) -> DataFrame:
    """Each row beside the first one (by rid) of its key. Those of split keys, which are few, are joined to them, so that the
    rows of such a key need not be in one task."""
    of_split = here.where("split > 1").groupBy("key").agg(F.min(F.struct("rid", "n", "i", "root")).alias("f"))
    of_split = of_split.select(F.col("key").alias("first_key"), *(F.col(f"f.{c}").alias(f"{c}2") for c in ("rid", "n", "i", "root")))
    many = here.where("split > 1").join(small(of_split, of_split.count()), F.col("key") == F.col("first_key"))
    order = Window.partitionBy("key").orderBy("rid")
    few = here.where("split = 1").select("rid", "n", "i", "root", *(F.first(c).over(order).alias(f"{c}2") for c in ("rid", "n", "i", "root")))
    return few.union(many.select(*few.columns))


def _met_neighbour(here: DataFrame, turn: int) -> DataFrame:
    """Each row beside the one before it in its part of a key, in an order that each turn shuffles anew."""
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("rid", F.lit(turn)))
    return here.select("rid", "n", "i", "root", *(F.lag(c).over(order).alias(f"{c}2") for c in ("rid", "n", "i", "root")))


def _blocks_met(here: DataFrame, fits: Column) -> DataFrame:
    """Pairs (a, b) of rows of one key (of `docs` rows each) that fit and aren't in one component. A key's rows are dealt to
    blocks of about BLOCK; each two blocks of it meet in a group of their own, so no group grows with its key."""
    blocks = F.ceil(F.col("docs") / BLOCK).cast("int")
    dealt = here.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(F.col("rid"), F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cut(dealt.select("key", F.least("mine", "with").alias("lo"), F.greatest("mine", "with").alias("hi"), "mine", "rid", "n", "i", "root"), "blocks")
    other = dealt.select("key", "lo", "hi", *(F.col(c).alias(f"{c}2") for c in ("mine", "rid", "n", "i", "root")))
    once = (F.col("lo") == F.col("hi")) | (F.col("mine") != F.col("mine2"))  # rows of one block meet where it meets itself
    met = dealt.join(other, ["key", "lo", "hi"]).where((F.col("rid") > F.col("rid2")) & (F.col("root") != F.col("root2")) & once & fits)
    return met.select(F.col("rid").alias("a"), F.col("rid2").alias("b")).distinct()


def docs_alone(classes: DataFrame) -> DataFrame:
    """node, root of no component at all."""
    return classes.select(F.col("rid").alias("node"), F.col("rid").alias("root")).limit(0)


def _with_root(shared: DataFrame, root: DataFrame) -> DataFrame:
    return shared.join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those that another row of their group stands for: of each group the
    row with the smallest id stays (one of them, if several have it; one of all, if none has an id). Rows are told apart by
    themselves, not by their ids: rows that share an id, or have none, go only with their own group. Rows without words are in
    no group and stay."""
    mine, lost = unused(docs, "rid"), unused(docs, "gone")
    held, rid = docs, F.col(id_col).cast("long")
    if not docs.groupBy(id_col).count().where(F.col("count") > 1).isEmpty() or not docs.where(F.col(id_col).isNull()).isEmpty():
        held, rid = cut(docs.withColumn(mine, F.monotonically_increasing_id()), "numbered"), F.col(mine)
    plain = held.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    since = written()
    gone = cut(_grouped(plain, k, num, den).where("rid <> keep").select(F.col("rid").alias(lost)), "gone")
    release(since, gone)
    return held.join(small(gone, gone.count()), rid == F.col(lost), "left_anti").select(*docs.columns)
