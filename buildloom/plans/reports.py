"""The reports as plans from a graph to rows; ties that have no order of their own are ordered by name."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from . import lookups
from .model import Graph

PROC, FILE = ["build_id", "pid_node"], ["build_id", "file_node"]


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _any(*tests: Column) -> Column:
    return reduce(or_, tests)


def _ends(path: str, *suffixes: str) -> Column:
    return _any(*(F.col(path).endswith(s) for s in suffixes))


def _used(g: Graph, edge: DataFrame) -> DataFrame:
    """Edges of processes that executed something, with the files they lead to. Files come first: what a report asks of their
    paths has cut the edges down before these meet the processes."""
    return edge.join(_files(g), FILE).join(g.typed, PROC, "left_semi")


def _files(g: Graph) -> DataFrame:
    return g.file.withColumnRenamed("abspath", "path")


def _external(g: Graph, files: DataFrame, edge: DataFrame) -> DataFrame:
    """Of file versions those that an edge leads to and that nothing in the build wrote: only nodes go through the joins."""
    return files.join(edge.select(FILE), FILE, "left_semi").join(g.writes.select(FILE), FILE, "left_anti")


# Overview


def processes(g: Graph) -> DataFrame:
    return _count(g.typed)


def files(g: Graph) -> DataFrame:
    return _count(g.file)


def reads(g: Graph) -> DataFrame:
    return _count(g.reads)


def writes(g: Graph) -> DataFrame:
    return _count(g.writes)


def renames(g: Graph) -> DataFrame:
    return _count(g.rename)


def creates(g: Graph) -> DataFrame:
    return _count(g.creates)


def overview(g: Graph) -> DataFrame:
    parts = [f(g).select(F.lit(f.__name__).alias("metric"), "n") for f in (processes, files, reads, writes, renames, creates)]
    return reduce(DataFrame.unionByName, parts)


def timeline(g: Graph) -> DataFrame:
    """From the first start to the last end of processes that have both; also the seconds modulo a day, as the console shows them."""
    ended = g.process.where("typed and end_ts is not null").select(*PROC, "end_ts")
    span = ended.join(g.process_start, PROC).agg(F.min("start_ts").alias("begin_ts"), F.max("end_ts").alias("finish_ts"))
    long = fn.seconds_between(F.col("begin_ts"), F.col("finish_ts"))
    return span.select("begin_ts", "finish_ts", long.alias("duration_s"), F.pmod(long, F.lit(86400)).cast("long").alias("duration_mod_day"))


# Programs and languages


def exec_counts(g: Graph) -> DataFrame:
    return _used(g, g.executable).groupBy("path").agg(F.count("pid_node").alias("n"))


def exec_counts_by_name(g: Graph) -> DataFrame:
    """A row for each path, shown by its base name: two paths of one name stay apart."""
    return exec_counts(g).select(fn.basename("path").alias("name"), "path", "n")


def source_reads_by_ext(g: Graph) -> DataFrame:
    """Counts reads, not files."""
    hit = _used(g, g.reads).where(~F.col("path").contains("TryCompile") & _ends("path", *(f".{e}" for e in lookups.SOURCE_EXTENSIONS)))
    return hit.groupBy(fn.suffix("path").alias("ext")).agg(F.count(F.lit(1)).alias("n")).withColumn("lang", lookups.language_of(F.col("ext")))


def tools_detail(g: Graph) -> DataFrame:
    name = fn.basename("path")
    return exec_counts(g).select(name.alias("name"), lookups.package_of(name).alias("pkg"), "n")


def tools_by_package(g: Graph) -> DataFrame:
    return tools_detail(g).groupBy("pkg").agg(F.sum("n").alias("n")).withColumn("role", lookups.role_of(F.col("pkg")))


# What comes from outside, what is made


def external_executables(g: Graph) -> DataFrame:
    return _external(g, _files(g), g.executable).select("path").distinct()


def external_libs(g: Graph) -> DataFrame:
    """The version is what counts: a library read before the build rewrites it is external."""
    libs = _files(g).where(_any(F.col("path").startswith("/usr/lib"), F.col("path").startswith("/lib")) & F.col("path").contains(".so"))
    return _external(g, libs, g.reads).select("path", "hash").distinct().select("path", fn.basename("path").alias("name"), "hash", fn.shorten("hash", 16).alias("hash16"))


def project_sources(g: Graph) -> DataFrame:
    hit = _used(g, g.reads).where(_ends("path", ".c", ".cpp", ".cc"))
    hit = hit.where(~_any(*(F.col("path").contains(x) for x in ("CMakeFiles", "TryCompile", "conftest"))))
    return hit.where(_any(*(F.col("path").contains(x) for x in ("/BUILD/", "/build/src/", "/src/")))).select("path").distinct()


def project_sources_report(g: Graph) -> DataFrame:
    """As the written report has them: only below /BUILD/, configure tests included."""
    hit = _used(g, g.reads).where(_ends("path", ".c", ".cpp", ".cc") & F.col("path").contains("/BUILD/"))
    return hit.where(~_any(*(F.col("path").contains(x) for x in ("CMakeFiles", "TryCompile")))).select("path").distinct()


def relative(sources: DataFrame, checkout: bool = True) -> DataFrame:
    """Paths without the project's folder: that of the first path, in order, that has one, taken out wherever it occurs."""
    based = sources.withColumn("base", F.nullif(fn.project_base("path", checkout), F.lit("")))
    base = based.agg(F.min_by("base", F.when(F.col("base").isNotNull(), F.col("path"))).alias("of_all"))
    return sources.crossJoin(F.broadcast(base)).select("path", F.when(F.col("of_all").isNull(), F.col("path")).otherwise(F.replace("path", "of_all", F.lit(""))).alias("rel_path"))


def project_sources_relative(g: Graph) -> DataFrame:
    return relative(project_sources(g))


def artifacts(g: Graph) -> DataFrame:
    hit = _used(g, g.writes).where(~F.col("path").startswith("/tmp") & (F.col("path") != "/dev/null"))
    return hit.where(~_any(F.col("path").contains("CMakeFiles"), F.col("path").contains("TryCompile"))).select("path").distinct()


def artifacts_by_ext(g: Graph) -> DataFrame:
    """Artifacts of each extension: how many, and the names of the first three paths."""
    named = artifacts(g).select("path", fn.basename("path").alias("name")).withColumn("ext", fn.extension("name"))
    first = F.row_number().over(Window.partitionBy("ext").orderBy("path"))
    total = named.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    shown = named.withColumn("place", first).where("place <= 3").groupBy("ext").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("shown"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" … (+"), (F.col("n") - 3).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return total.join(shown, "ext").select("ext", "n", F.concat("shown", more).alias("sample"))


def built_libs(g: Graph) -> DataFrame:
    hit = _used(g, g.writes).where(_any(F.col("path").contains(".so"), F.col("path").endswith(".a")))
    return hit.where(~F.col("path").startswith("/tmp") & ~F.col("path").contains("TryCompile")).select("path", "hash").distinct()


# The process tree


def _roots(g: Graph) -> DataFrame:
    return g.typed.join(g.creates.select("build_id", F.col("child_node").alias("pid_node")), PROC, "left_anti")


def process_roots(g: Graph, most: int = 5) -> DataFrame:
    """Typed processes that none creates; the first by number."""
    return _roots(g).orderBy(fn.node_number("pid_node"), "build_id").limit(most).select("pid_node")


def _first_roots(g: Graph, most: int = 5) -> DataFrame:
    return _roots(g).orderBy(fn.node_number("pid_node"), "build_id").limit(most)


def root_commands(g: Graph, most: int = 5) -> DataFrame:
    """Each root's least command line; null if it has none."""
    return _first_roots(g, most).join(g.process_cmd, PROC, "left").groupBy(*PROC).agg(F.min("cmd").alias("cmd")).select("pid_node", "cmd")


def root_children(g: Graph, most: int = 5) -> DataFrame:
    """Children of roots with their commands: a row for each command, one without command for a child that has none."""
    born = _first_roots(g, most).join(g.creates, PROC)
    cmds = g.process_cmd.withColumnRenamed("pid_node", "child_node")
    return born.join(cmds, ["build_id", "child_node"], "left").select(F.col("pid_node").alias("root"), F.col("child_node").alias("child"), "cmd")


def tree_two_levels(g: Graph, most: int = 5, shown: int = 6) -> DataFrame:
    """The first rows of each root's children, and how many more there are; rows, not children."""
    rows = root_children(g, most)
    place = F.row_number().over(Window.partitionBy("root").orderBy(fn.node_number("child"), F.col("cmd").asc_nulls_first()))
    total = F.count(F.lit(1)).over(Window.partitionBy("root"))
    return rows.select("root", place.alias("rn"), "child", F.coalesce(fn.shorten("cmd", 65), F.lit("?")).alias("cmd65"), F.greatest(total - shown, F.lit(0)).cast("long").alias("hidden")).where(F.col("rn") <= shown)


def headers_top(g: Graph, most: int = 15) -> DataFrame:
    hit = _used(g, g.reads).where(F.col("path").endswith(".h") & F.col("path").startswith("/usr/")).groupBy("path").agg(F.count("pid_node").alias("n"))
    short = F.col("path")
    for long, put in (("/usr/lib64/gcc/x86_64-alt-linux/13/", "<gcc>/"), ("/usr/include/", "<inc>/")):
        short = F.replace(short, F.lit(long), F.lit(put))
    return hit.orderBy(F.desc("n"), "path").limit(most).select("path", short.alias("short_path"), "n")


def sources_c_only(g: Graph) -> DataFrame:
    return _used(g, g.reads).where(F.col("path").endswith(".c")).select("path").distinct()


# What the vocabulary holds besides


def renames_resolved(g: Graph) -> DataFrame:
    path = lambda side: g.file.select("build_id", F.col("file_node").alias(f"{side}_node"), F.col("abspath").alias(f"{side}_path"))
    return g.rename.join(path("from"), ["build_id", "from_node"]).join(path("to"), ["build_id", "to_node"]).select("pid_node", "from_path", "to_path")


def renamed_external(g: Graph) -> DataFrame:
    """Paths that came about by renaming and are read later: they count as external, as nothing wrote that version."""
    moved = _files(g).join(g.rename.select("build_id", F.col("to_node").alias("file_node")), FILE, "left_semi")
    return _external(g, moved, g.reads).select("path").distinct()


def multi_exec_processes(g: Graph) -> DataFrame:
    return g.executable.groupBy(*PROC).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pid_node", "n")


def untyped_processes(g: Graph) -> DataFrame:
    return g.process.where("not typed").select("pid_node")


def file_versions_per_path(g: Graph) -> DataFrame:
    return g.file.groupBy(F.col("abspath").alias("path")).agg(F.count(F.lit(1)).alias("n_versions"))


def unhashed_files(g: Graph) -> DataFrame:
    return g.file.where("hash is null").select(F.col("abspath").alias("path")).distinct()


def triples_by_predicate(g: Graph) -> DataFrame:
    """Each table is passed over once, whatever properties it holds; a row for each of these goes on."""
    if g.said is not None:
        return g.said.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    rows = F.count(F.lit(1))
    told = {
        "process": {"a": F.count_if("typed"), "b:end": F.count("end_ts")}, "process_cmd": {"b:cmd": rows}, "process_start": {"b:start": rows}, "process_env": {"b:env": rows},
        "file": {"a": rows, "b:name": F.count("name"), "b:abspath": F.count("abspath"), "b:hash": F.count("hash")}, "reads": {"b:reads": rows}, "writes": {"b:writes": rows},
        "executable": {"b:executable": rows}, "creates": {"b:creates": rows}, "rename": {"b:rename": rows, "b:rename-from": rows, "b:rename-to": rows},
    }
    counts = []
    for name, of in told.items():
        one = getattr(g, name).agg(*(n.alias(p) for p, n in of.items()))
        counts.append(one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"`{p}`").alias("n")) for p in of))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, counts).where("n > 0").groupBy("p").agg(F.sum("n").alias("n"))


REPORTS = {
    "stats": overview,
    "timeline": timeline,
    "languages": source_reads_by_ext,
    "tools": tools_by_package,
    "externals": external_libs,
    "sources": project_sources_relative,
    "artifacts": artifacts_by_ext,
    "libs": built_libs,
    "tree": tree_two_levels,
    "headers": headers_top,
}
