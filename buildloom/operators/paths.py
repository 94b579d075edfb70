"""Paths as system calls name them, made absolute: folders that descriptors stood for, and symbolic links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: So many links may be followed for one path; one that needs more is a loop.
MOST_LINKS = 40


def named_paths(calls: DataFrame, root: str = "/") -> DataFrame:
    """build_id, pid, seq, path of each call that names a path: joined to the folder that it is relative to.

    calls: build_id, pid, seq, op (open, close, chdir or use), fd (what an open gives or a close ends), dirfd (null: the working
    folder) and path. A relative path begins in the folder that its process opened last on dirfd, or changed to last (root
    before that); that folder's own path may be relative to others. A path is null where dirfd isn't open. `.`, `..` and links
    are left as they are (see resolved_links).

    The folder is found as of the call, by a window over each descriptor; chains of folders are put together by pointer
    jumping: each round joins every path with what its folder has so far, so a chain of n takes log n rounds.
    """
    who = ["build_id", "pid"]
    relative = ~F.startswith("path", F.lit("/"))
    asks = calls.where("path is not null")
    # A call asks for a descriptor before it opens one: 0 before 1.
    marks = calls.where("op in ('open', 'close')").select(*who, F.col("fd").alias("on"), "seq", F.lit(1).alias("turn"), F.when(F.col("op") == "open", F.col("seq")).otherwise(F.lit(-1)).alias("base"))
    marks = marks.unionByName(calls.where("op = 'chdir'").select(*who, F.lit(None).cast("int").alias("on"), "seq", F.lit(1).alias("turn"), F.col("seq").alias("base")))
    asked = asks.where(relative).select(*who, F.col("dirfd").cast("int").alias("on"), "seq", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("base"))
    by = Window.partitionBy(*who, "on").orderBy("seq", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(marks.withColumn("on", F.col("on").cast("int"))).withColumn("base", F.last("base", ignorenulls=True).over(by)).where("turn = 0")
    bases = found.select(*who, "seq", F.coalesce("base", F.when(F.col("on").isNull(), F.lit(0)).otherwise(F.lit(-1))).cast("long").alias("base"), (F.col("on").isNull() & F.col("base").isNull()).alias("at_root"))
    paths = asks.select(*who, "seq", "path").join(bases, [*who, "seq"], "left")
    whole = F.when(F.col("at_root"), F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))).when(F.col("base") == -1, F.lit(None)).otherwise(F.col("path"))
    state = stored(paths.select(*who, "seq", whole.alias("path"), F.when(~F.coalesce("at_root", F.lit(False)) & (F.col("base") >= 0), F.col("base")).alias("base")), "paths")
    while not state.where("base is not null").isEmpty():
        folder = state.select(*who, F.col("seq").alias("base"), F.col("path").alias("above"), F.col("base").alias("further"))
        joined = state.join(folder, [*who, "base"], "left")
        path = F.when(F.col("base").isNull(), F.col("path")).otherwise(F.concat(F.col("above"), F.lit("/"), F.col("path")))
        state = stored(joined.select(*who, "seq", path.alias("path"), F.when(F.col("path").isNotNull() & F.col("above").isNotNull(), F.col("further")).alias("base")), "paths")
    return state.drop("base")


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def _path(steps: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def resolved_links(paths: DataFrame, links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """build_id, path, resolved of each distinct (build_id, path), all absolute: without `.`, `..` and links.

    links: build_id, link (an absolute path without links or dots), target (absolute, or relative to the link's folder). As a
    file system does, from left to right: the first part of a path that is a link gives way to its target, and `..` goes up
    from what is before it once that is no link. A path that goes through more than `most` links is a loop; it is null.
    Each round takes one such step for all paths that aren't done, by a join of their beginnings with the links.
    """
    todo = stored(paths.select("build_id", "path").where("path is not null").distinct().withColumn("steps", _steps(F.col("path"))).withColumn("n", F.lit(0)), "links")
    known = links.select("build_id", F.col("link").alias("head"), "target")
    done = []
    while not todo.isEmpty():
        up = F.array_position("steps", "..").cast("int")  # 0: none
        clear = F.when(up > 0, up - 1).otherwise(F.size("steps"))
        heads = todo.select("build_id", "path", F.posexplode(F.transform(F.sequence(F.lit(1), clear), lambda i: F.when(i <= clear, _path(F.slice("steps", 1, i))))).alias("at", "head"))
        first = heads.where("head is not null").join(known, ["build_id", "head"]).groupBy("build_id", "path").agg(F.min(F.struct("at", "head", "target")).alias("link"))
        met = todo.join(first, ["build_id", "path"], "left")
        folder = F.when(F.startswith("link.target", F.lit("/")), F.array().cast("array<string>")).otherwise(F.slice("steps", F.lit(1), F.col("link.at")))
        rest = F.slice("steps", F.col("link.at") + 2, F.size("steps"))
        followed = F.concat(folder, _steps(F.col("link.target")), rest)
        raised = F.concat(F.slice("steps", F.lit(1), F.greatest(up - 2, F.lit(0))), F.slice("steps", up + 1, F.size("steps")))
        linked = F.col("link").isNotNull()
        after = met.select("build_id", "path", F.when(linked, followed).when(up > 0, raised).otherwise(F.col("steps")).alias("steps"), (F.col("n") + linked.cast("int")).alias("n"), (linked | (up > 0)).alias("more"))
        after = stored(after, "links")
        done.append(after.where(~F.col("more") | (F.col("n") > most)))
        todo = after.where(F.col("more") & (F.col("n") <= most)).drop("more")
    if not done:
        return paths.select("build_id", "path").where(F.lit(False)).withColumn("resolved", F.lit(None).cast("string"))
    every = reduce(DataFrame.unionByName, done)
    return every.select("build_id", "path", F.when(F.col("n") <= most, _path(F.col("steps"))).alias("resolved"))
