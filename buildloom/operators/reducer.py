"""The batch reducer: an ordered log of system calls to a provenance graph, with windows keyed by build and process or file.

Log columns: build_id, seq, ts, pid, op (entry, exit, stop, exited), syscall, fd, flags, path, abspath, new_path,
new_abspath, hash, new_hash, exec_path, child_pid, cmdline, env, rval. Paths are resolved and contents hashed by whoever
captured the log; `exit` rows carry the call's arguments. Failed calls leave nothing but, for a rename, its source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import access_edges, command_line, format_time
from ..plans.model import Graph
from ..storage import stored
from .events import fd_sessions, incarnation, latest, numbered

LOG = "build_id string, seq long, ts timestamp, pid long, op string, syscall string, fd int, flags int, path string, abspath string, new_path string, new_abspath string, hash string, child_pid long, cmdline array<string>, env array<string>, rval long"
OPENS, EXECS, RENAMES, FORKS = ("open", "openat", "creat"), ("execve", "execveat"), ("rename", "renameat", "renameat2"), ("fork", "vfork", "clone")
WRITE_CREATE = 577  # O_CREAT | O_WRONLY | O_TRUNC, what creat stands for


BY = ["build_id", "pid", "life"]


class Reduction:
    """The graph of each build in a log, made in stages. A stage that several tables are made from is written to the shared
    folder when the first of them asks for it; the log itself is scanned once."""

    def __init__(self, log: DataFrame):
        self.source = log

    @cached_property
    def log(self) -> DataFrame:
        """The log with `life`: a process id belongs to another process once it has exited."""
        return stored(self.source.withColumn("life", incarnation(F.col("op") == "exited", ("build_id", "pid"))), "log")

    @property
    def done(self) -> DataFrame:
        return self.log.where("op = 'exit' and rval >= 0")

    @property
    def execs(self) -> DataFrame:
        return self.done.where(F.col("syscall").isin(*EXECS))

    @property
    def opened(self) -> DataFrame:
        flags = F.when(F.col("syscall") == "creat", F.lit(WRITE_CREATE)).otherwise(F.col("flags"))
        return self.done.where(F.col("syscall").isin(*OPENS)).withColumn("edges", access_edges(flags)).where(F.size("edges") > 0)

    @cached_property
    def born(self) -> DataFrame:
        """Successful forks with the child's life: the one that is on, or begins next, when its parent's call returns."""
        children = self.done.where(F.col("syscall").isin(*FORKS)).select(*BY, "seq", "child_pid", F.lit(False).alias("gone"))
        gone = self.log.where("op = 'exited'").select(*BY, "seq", F.col("pid").alias("child_pid"), F.lit(True).alias("gone"))
        return children.unionByName(gone).withColumn("child_life", incarnation(F.col("gone"), ("build_id", "child_pid"))).where("not gone").drop("gone")

    @cached_property
    def node(self) -> DataFrame:
        """Processes, numbered in the order in which a build's log first mentions them, as parent, child or itself."""
        own = self.log.where("op <> 'exited'").select(*BY, "seq")
        mention = own.unionByName(self.born.select("build_id", F.col("child_pid").alias("pid"), F.col("child_life").alias("life"), "seq"))
        first = mention.groupBy(*BY).agg(F.min("seq").alias("first"))
        node = numbered(first, ("build_id",), ("first", "pid"))
        return stored(node.select(*BY, F.concat(F.lit(":p"), F.col("number").cast("string")).alias("pid_node")), "node")

    @cached_property
    def made(self) -> DataFrame:
        """Openings for writing, each a version of its own; the close that ends it gives the hash and makes it known."""
        write_opens = self.opened.where(F.array_contains("edges", "writes"))
        closes = self.done.where("syscall = 'close'")
        steps = write_opens.select(*BY, "fd", "seq", F.lit(1).alias("d")).unionByName(closes.select(*BY, "fd", "seq", F.lit(-1).alias("d")))
        sessions = fd_sessions(steps, (*BY, "fd")).select("build_id", F.col("open_seq").alias("seq"), "close_seq")
        hashes = closes.select("build_id", F.col("seq").alias("close_seq"), F.col("hash").alias("close_hash"))
        made = write_opens.join(sessions, ["build_id", "seq"], "left").join(hashes, ["build_id", "close_seq"], "left")
        return stored(made.select(*BY, "seq", "edges", "path", "abspath", "close_seq", F.col("close_hash").alias("hash")), "made")

    @cached_property
    def uses(self) -> DataFrame:
        """Uses of a version by its path and content: it is the newest one known by then, or a new one at its first use."""
        uses = (
            self.opened.where(~F.array_contains("edges", "writes")).select(*BY, "seq", F.lit("reads").alias("use"), "path", "abspath", "hash")
            .unionByName(self.execs.select(*BY, "seq", F.lit("executable").alias("use"), "path", "abspath", "hash"))
            .unionByName(self.log.where(F.col("syscall").isin(*RENAMES) & F.expr("op = 'entry' and abspath is not null")).select(*BY, "seq", F.lit("from").alias("use"), "path", "abspath", "hash"))
        )
        known = self.made.where("close_seq is not null").select("build_id", F.col("close_seq").alias("seq"), "abspath", "hash", F.col("seq").alias("origin"))
        asks = uses.withColumn("origin", F.lit(None).cast("long")).unionByName(known, allowMissingColumns=True)
        upto = Window.partitionBy("build_id", "abspath", "hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Before any writer's version is known, the first use is the version.
        first_use = F.min(F.when(F.col("origin").isNull(), F.col("seq"))).over(upto)
        asks = asks.withColumn("version", F.coalesce(F.last("origin", ignorenulls=True).over(upto), first_use))
        return stored(asks.where("origin is null").drop("origin").withColumnRenamed("version", "origin"), "uses")

    @cached_property
    def renamed(self) -> DataFrame:
        """Renames that succeeded: each makes a version of the new path with the old content, known from then on by its edge only."""
        exits = self.done.where(F.col("syscall").isin(*RENAMES))
        sources = self.uses.where("use = 'from'").select(*BY, "seq", F.struct(F.col("origin").alias("from_origin"), F.col("hash").alias("from_hash")).alias("f"))
        both = exits.select(*BY, "seq", "new_path", "new_abspath").unionByName(sources, allowMissingColumns=True)
        both = both.withColumn("done", F.col("f").isNull()).withColumn("f", latest(F.col("f"), tuple(BY)))
        return stored(both.where("done and f is not null").select(*BY, "seq", "new_path", "new_abspath", "f.*"), "renamed")

    @cached_property
    def files(self) -> DataFrame:
        """File versions, numbered in the order in which they come up."""
        named = lambda df, origin, name, abspath, digest: df.select("build_id", F.col(origin).alias("origin"), F.col(name).alias("name"), F.col(abspath).alias("abspath"), F.col(digest).alias("hash"))
        fresh = named(self.made, "seq", "path", "abspath", "hash").unionByName(named(self.uses.where("seq = origin"), "origin", "path", "abspath", "hash"))
        fresh = fresh.unionByName(named(self.renamed, "seq", "new_path", "new_abspath", "from_hash"))
        files = numbered(fresh, ("build_id",), ("origin",))
        return stored(files.withColumn("file_node", F.concat(F.lit(":f"), F.col("number").cast("string"))).drop("number"), "files")

    @property
    def file(self) -> DataFrame:
        return self.files.select("build_id", "file_node", "name", "abspath", "hash")

    @property
    def touches(self) -> DataFrame:
        """build_id, edge (reads, writes or executable), pid_node, file_node."""
        made = self.made.select(*BY, F.col("seq").alias("origin"), F.explode("edges").alias("edge"))
        used = self.uses.where("use <> 'from'").select(*BY, "origin", F.col("use").alias("edge"))
        with_nodes = made.unionByName(used).join(self.node, BY).join(self.files.select("build_id", "origin", "file_node"), ["build_id", "origin"])
        return with_nodes.select("build_id", "edge", "pid_node", "file_node").distinct()

    @property
    def creates(self) -> DataFrame:
        child = self.node.select("build_id", F.col("pid").alias("child_pid"), F.col("life").alias("child_life"), F.col("pid_node").alias("child_node"))
        return self.born.join(self.node, BY).join(child, ["build_id", "child_pid", "child_life"]).select("build_id", "pid_node", "child_node").distinct()

    @property
    def rename(self) -> DataFrame:
        file_of = self.files.select("build_id", "origin", "file_node")
        ends_of = numbered(self.renamed, ("build_id",), ("seq",))
        ends_of = ends_of.withColumn("rename_node", F.concat(F.lit("_:rename"), F.col("number").cast("string"))).join(self.node, BY)
        ends_of = ends_of.join(file_of.withColumnsRenamed({"origin": "from_origin", "file_node": "from_node"}), ["build_id", "from_origin"])
        ends_of = ends_of.join(file_of.withColumnsRenamed({"origin": "seq", "file_node": "to_node"}), ["build_id", "seq"])
        return ends_of.select("build_id", "rename_node", "pid_node", "from_node", "to_node")

    @property
    def process(self) -> DataFrame:
        """One pass over the log for what is known of each life: whether it executed anything, and when it ended."""
        executed = F.col("syscall").isin(*EXECS) & F.expr("op = 'exit' and rval >= 0")
        about = self.log.groupBy(*BY).agg(F.coalesce(F.bool_or(executed), F.lit(False)).alias("typed"), format_time(F.min(F.when(F.col("op") == "exited", F.col("ts")))).alias("end_ts"))
        return self.node.join(about, BY, "left").select("build_id", "pid_node", F.coalesce("typed", F.lit(False)).alias("typed"), "end_ts")


def reduce_log(log: DataFrame) -> Graph:
    """The graph of each build in the log."""
    r = Reduction(log)
    touches = stored(r.touches, "touches")
    edge = lambda name: touches.where(F.col("edge") == name).drop("edge")
    exec_of = r.execs.join(r.node, BY)
    return Graph(
        r.process,
        exec_of.where("cmdline is not null").select("build_id", "pid_node", command_line("cmdline").alias("cmd")).distinct(),
        exec_of.select("build_id", "pid_node", format_time("ts").alias("start_ts")).distinct(),
        r.log.where("env is not null").join(r.node, BY).select("build_id", "pid_node", F.explode("env").alias("entry")).distinct(),
        r.file, edge("reads"), edge("writes"), edge("executable"), r.creates, r.rename,
    )
