"""Sharding by a hierarchical weighted hash tree (DataFrame operations only).

A tree has regions, racks in them and shards in these; a node's weight is the sum of its shards'. A document descends:
at each level every child draws -ln(u) / weight, u being a hash of the document and the child's name, and the least
draw wins, so children are chosen in proportion to weight. A child's draw changes only with its own weight: when
weights change, documents move only into or out of the subtrees whose weights change. A shard that is added as a region
of its own changes no other node's weight and so only takes documents in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task should hold.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(regions: int = 4, racks: int = 2, shards: int = 2) -> list[Shard]:
    """Equal shards, numbered from 0."""
    return [Shard(f"g{i // (racks * shards)}", f"r{i // shards % racks}", i) for i in range(regions * racks * shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree and one more shard, in a region of its own: it takes documents from all shards, and none move otherwise."""
    n = max(s.number for s in tree) + 1
    return [*tree, Shard(f"g+{n}", "r0", n, weight)]


def first_bits(x: Column, digits: int) -> Column:
    """The number that the first hexadecimal digits of an MD5 make."""
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("long")


def _children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """Names and weights (above 0) of the children of each inner node, by its path."""
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        if s.weight > 0:
            at = ""
            for name in (s.region, s.rack, str(s.number)):
                kids = out.setdefault(at, {})
                kids[name] = kids.get(name, 0.0) + s.weight
                at += f"/{name}"
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key; a null key counts as a key of its own. Equal draws go to the child named first."""
    nodes = _children(tree)
    if not nodes:
        raise ValueError("a tree needs a shard of positive weight")
    child = lambda i, n, w: F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(w).alias("weight"))
    of = F.create_map(*[x for path, kids in nodes.items() for x in (F.lit(path), F.array(*[child(i, n, w) for i, (n, w) in enumerate(kids.items())]))])
    named = F.coalesce(key.cast("string"), F.lit("null"))

    def down(path: Column) -> Column:
        """The path of the child of the least draw. The path is an element of an array, so it is worked out once."""

        def draw(p: Column, c: Column) -> Column:
            u = (first_bits(F.concat(p, F.lit("/"), c["name"], F.lit("|"), named), 13).cast("double") + 0.5) / float(1 << 52)
            return F.struct((-F.ln(u) / c["weight"]).alias("d"), c["i"].alias("i"), c["name"].alias("name"))

        won = lambda p: F.array_min(F.transform(F.element_at(of, p), lambda c: draw(p, c)))["name"]
        return F.transform(F.array(path), lambda p: F.concat(p, F.lit("/"), won(p)))[0]

    return F.substring_index(down(down(down(F.lit("")))), "/", -1).cast("int")


def assign(docs: DataFrame, tree: list[Shard], key_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """docs with the shard of each row: no shuffle, and texts don't move."""
    return docs.withColumn(shard_col, shard_of(F.col(key_col), tree))


def with_slots(rows: DataFrame, n_shards: int, shard_col: str = "shard", key_col: str = "doc_id", tie_col: str = "text_crc32", slot_col: str = "slot") -> DataFrame:
    """Gapless places 0, 1, ... in each shard. A shard is numbered in hash buckets of about SLOT_ROWS rows, each from the
    sum of the counts of those before it, so no task holds a whole shard. The bucket goes by key and tie_col, so rows of one
    key (or none) with different texts spread over buckets. Rows that repeat both get places next to each other."""
    total = rows.count()
    buckets = max(8, total // (n_shards * SLOT_ROWS) + 1)
    mark = F.concat(F.lit("slot|"), F.coalesce(F.col(key_col).cast("string"), F.lit("null")), F.lit("|"), F.col(tie_col).cast("string"))
    rows = rows.withColumn("__bucket", F.pmod(first_bits(mark, 8), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(shard_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(shard_col, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy(shard_col, "__bucket").orderBy(F.col(key_col).asc_nulls_first(), F.col(tie_col)))
    out = rows.withColumn("__place", place).join(bases, [shard_col, "__bucket"])
    return out.withColumn(slot_col, (F.col("__base") + F.col("__place") - 1).cast("long")).drop("__base", "__place", "__bucket")


def write_shards(docs: DataFrame, path: str, tree: list[Shard], key_col: str = "doc_id") -> None:
    """One folder for each shard; a large shard is written by several tasks."""
    assign(docs, tree, key_col).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes and 1; null text: 1), text_crc32, law, shard, slot, grown_shard.

    Rows that repeat an id go to its shard, each with a slot of its own; null ids count as one key. An empty table gives an
    empty result; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(rows, tree).withColumn("grown_shard", shard_of(F.col("doc_id"), grown(tree)))
    return with_slots(rows, len(tree)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
