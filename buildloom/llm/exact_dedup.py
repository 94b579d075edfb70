"""Exact deduplication by content-defined chunk recipes (DataFrame operations only).

A document's white-space-normalised text is cut into chunks at places that its content decides. Distinct chunks get
verified identifiers: the 64-bit hash of a chunk identifies it once a pass over all distinct chunks has shown that no
two of them share a hash; the chunks of a hash that two do share are told apart by an ordinal. Documents are then
equal exactly if their ordered identifier lists are, so only these short lists move between executors, never long
texts; each distinct chunk moves once for each task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, cut, release, unused, written

#: A chunk is 512 to 2048 characters and ends after a space that follows a vowel or non-ASCII letter and one of d n r s t.
CHUNK = r"(?s).{512,2048}?(?<=[aeiou\x{80}-\x{10FFFF}][dnrst][ ])|.{1,2048}"
LAST = 9223372036854775807


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space (ends aren't trimmed)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each input row: __rid, doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group of empty texts. The row with the smallest doc_id of a group stays; of rows that
    repeat this doc_id, one stays. Null doc_ids come after all others; a group of only these has a null keep_id. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    recipes = cut(
        base.select("doc_id", "norm", chunks(F.col("norm")).alias("chunks")).select(
            F.monotonically_increasing_id().alias("__rid"),
            "doc_id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform("chunks", lambda c: identify(c)).alias("recipe"),
        ),
        "recipes",
    )
    # Each distinct chunk once (combined before it moves), then the hashes that two distinct chunks share.
    distinct = base.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(identify(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = cut(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        recipes = recipes.withColumn("marks", F.array().cast("array<int>"))
    else:
        recipes = _told_apart(recipes, docs, id_col, text_col, identify)
    same = (
        recipes.groupBy("recipe", "marks")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"), F.min_by("__rid", F.coalesce(F.col("doc_id"), F.lit(LAST))).alias("keep_rid"))
        .where("group_size > 1")
    )
    out = recipes.join(same, ["recipe", "marks"], "left")
    return out.select(
        "__rid",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep_rid").isNull() | (F.col("keep_rid") == F.col("__rid"))).alias("kept"),
        "text_sha256",
    )


def _told_apart(recipes: DataFrame, docs: DataFrame, id_col: str, text_col: str, identify: Callable[[Column], Column]) -> DataFrame:
    """The exact way for hashes that distinct chunks share: the ordinal of each chunk among those of its hash, as a second list."""
    rows = cut(
        docs.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
        .select("__rid", "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks")),
        "chunked",
    )
    each = rows.select("__rid", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", identify(F.col("chunk")))
    ordinal = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    named = each.select("h", "chunk").distinct().withColumn("mark", ordinal)
    marks = each.join(named, ["h", "chunk"]).groupBy("__rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]).alias("marks"))
    listed = rows.select("__rid", "doc_id", "text_sha256", F.transform("chunks", lambda c: identify(c)).alias("recipe"))
    return cut(listed.join(marks, "__rid", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>"))), "marked")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; the texts move once, to meet the decision on their row."""
    since = written()
    found = cut(groups(docs, id_col, text_col), "groups")
    release(since, found)
    own, who, stays = unused(docs, "sha"), unused(docs, "stay_id"), unused(docs, "stay_sha")
    stay = found.where("kept").select(F.col("doc_id").alias(who), F.col("text_sha256").alias(stays))
    out = docs.withColumn(own, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    out = out.join(stay, F.col(id_col).eqNullSafe(F.col(who)) & (F.col(own) == F.col(stays)), "left_semi")
    twice = found.groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not twice.isEmpty():
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)
