"""Mixing sources to target weights.

Tokens are summed by source, targets follow from the weights, and a source's repetition rate is target / tokens. Each
document is emitted floor(rate) times and once more with probability rate - floor(rate), decided by a hash of seed and
doc_id: a rerun, or a task that runs again, decides the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def targets(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, source_col: str = "source") -> DataFrame:
    """One row for each source: __source, source_size, target.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. They share `share` times the
    size of all by weight; a target stops at `most` times its source's size, and the excess goes to the others by weight
    until none is above. Only sums over sources come to the driver, once for each round of resharing.
    """
    sizes = docs.select(F.col(source_col).alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").cast("long").alias("source_size"))
    # One row for each source goes through this window, not one for each document.
    rank = (F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    table = cut(sizes.select("__source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # the level rises until no further source reaches its cap
        x = table.agg(F.count(F.when(F.col("cap") <= F.col("weight") * level, 1)).alias("n"), F.sum(F.when(F.col("cap") <= F.col("weight") * level, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(F.col("cap") > F.col("weight") * level, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if x["n"] == capped or not x["open"]:
            break
        capped, level = x["n"], (total - x["full"]) / x["open"]
    return table.select("__source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """docs with __size, source_size, target and __copies: how often the mix takes the document (0 or more).

    Null text: size 0. Null sources are one source. Repeated rows are decided alike. An empty table gives an empty result.
    """
    table = cut(targets(docs, n_words(F.col(text_col)), source_col=source_col, **how), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    held = docs.drop("source_size", "target", "__size", "__copies").withColumn("__size", n_words(F.col(text_col)))
    joined = held.join(small(table, table.count()), held[source_col].eqNullSafe(table["__source"]), "left").withColumn("__rate", rate)
    more = (uniform(F.col(id_col), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return joined.withColumn("__copies", F.floor("__rate") + more).drop("__source", "__rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mixed documents, each repeated as planned, with the columns of docs."""
    whole = docs.select(F.struct("*").alias("__row"))  # so that no column of docs shares a name with the plan's
    planned = plan(whole, f"__row.{id_col}", f"__row.{text_col}", f"__row.{source_col}", seed, **how).where("__copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs.select("doc_id", "text", "source")).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))
