"""Pairing, identity and numbering over ordered event logs, with windows keyed by process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_ALL = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def fd_sessions(log: DataFrame, keys: tuple[str, ...] = ("pid", "fd")) -> DataFrame:
    """Each opening for writing with the close that ends it, the newest opening of a descriptor first (a stack).

    log: the keys, seq, and d (1: opened for writing, -1: closed). A close without an opening is ignored; an opening that
    none closes has a null close_seq.
    """
    by = Window.partitionBy(*keys).orderBy("seq")
    x = log.select(*keys, "seq", "d").withColumn("s", F.sum("d").over(by.rowsBetween(*_ALL)))
    x = x.withColumn("lo", F.least(F.lit(0), F.min("s").over(by.rowsBetween(*_ALL)))).withColumn("lo_before", F.coalesce(F.least(F.lit(0), F.min("s").over(by.rowsBetween(*_BEFORE))), F.lit(0)))
    x = x.where(~((F.col("d") == -1) & (F.col("s") < F.col("lo_before"))))
    x = x.withColumn("level", F.when(F.col("d") == 1, F.col("s") - F.col("lo")).otherwise(F.col("s") - F.col("lo") + 1))
    at = Window.partitionBy(*keys, "level").orderBy("seq")
    x = x.withColumn("next", F.lead("seq").over(at)).withColumn("next_d", F.lead("d").over(at))
    return x.where("d = 1").select(*keys, F.col("seq").alias("open_seq"), F.when(F.col("next_d") == -1, F.col("next")).alias("close_seq"))


def syscall_pairs(log: DataFrame, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Each exit stop with the entry stop just before it in its process. log: the keys, seq, op (entry or exit)."""
    by = Window.partitionBy(*keys).orderBy("seq")
    x = log.where(F.col("op").isin("entry", "exit")).withColumn("op0", F.lag("op").over(by)).withColumn("seq0", F.lag("seq").over(by))
    return x.where("op = 'exit' and op0 = 'entry'").select(*keys, F.col("seq0").alias("entry_seq"), F.col("seq").alias("exit_seq"))


def file_identity(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct (abspath, hash), null hashes alike, numbered from 0 in the order they are first seen (in each build)."""
    first = log.groupBy(*keys, "abspath", "hash").agg(F.min("seq").alias("first_seq"))
    return first.select(*keys, "abspath", "hash", (F.row_number().over(Window.partitionBy(*keys).orderBy("first_seq")) - 1).cast("long").alias("node_no"))


def running_processes(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """seq and the number of live processes after it. log: the keys, seq, delta (1: began, -1: exited)."""
    by = Window.partitionBy(*keys).orderBy("seq").rowsBetween(*_ALL)
    return log.select(*keys, "seq", (F.lit(1) + F.sum("delta").over(by)).cast("long").alias("running"))


def incarnation(exited: Column, keys: tuple[str, ...], order: str = "seq") -> Column:
    """How often the process id was given up before a row: ids are reused after exit."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_BEFORE)
    return F.coalesce(F.sum(exited.cast("long")).over(by), F.lit(0))


def latest(value: Column, keys: tuple[str, ...], order: str = "seq") -> Column:
    """The newest non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*_ALL))


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with `number`: their place from 0 in the order of `order` among the rows of one key, without a gap.

    Rows are dealt to tasks by ranges of key and order and sorted there, so a key's rows lie next to each other and their
    places in the task number them; a key's rows in the tasks before are added. No task holds a key, however many rows it has,
    and rows move once. Rows that are alike in key and order are numbered in any order.
    """
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "dealt")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(*_BEFORE)
    counts = dealt.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    bases = counts.select(*(F.col(k).alias(f"key {k}") for k in keys), F.col("part").alias("key part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    bases = stored(bases, "bases")  # as a table its size is known: a small one is sent to the rows
    match = F.col("part") == F.col("key part")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"key {k}"))
    return dealt.join(bases, match).select(*rows.columns, (F.col("place") + F.col("base")).alias("number"))
