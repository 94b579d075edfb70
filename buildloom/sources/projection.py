"""The star-schema test tables seen as one build's graph: orders are processes, line items their file accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import format_time
from ..plans.model import Graph

EXECUTABLES = ("/usr/bin/gcc", "/usr/libexec/gcc/cc1", "/usr/bin/as", "/usr/bin/ld", "/usr/bin/make", "/bin/sh", "/usr/bin/python3", "/usr/bin/mv", "/build/src/tools/gen", "/usr/bin/cmake", "/opt/x/lua5.4")
DIRS = ("/usr/include/", "/usr/lib64/", "/lib64/", "/build/src/src/", "/root/RPM/BUILD/pkg-1.0/src/", "/build/src/CMakeFiles/TryCompile-1/", "/tmp/", "/build/src/lib/")
EXTS = (".c", ".h", ".so", ".so.1", ".a", ".cpp", ".py", "", ".o", ".cc", ".sh")
BUILD = "tables"


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, lineitem, part = table("orders"), table("lineitem"), table("part")
    build = F.lit(BUILD).alias("build_id")
    pid = lambda key: F.concat(F.lit("p"), key.cast("string"))
    version = F.col("l_suppkey") % 3
    fid = lambda key: F.concat(F.lit("f"), key.cast("string"), F.lit("_"), version.cast("string"))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    key, part_key = F.col("o_orderkey"), F.col("l_partkey")

    ends = lineitem.groupBy(pid(F.col("l_orderkey")).alias("pid_node")).agg(format_time(F.max("l_shipdate")).alias("end_ts"))
    made = orders.select(pid(key).alias("pid_node"), (F.col("o_orderstatus") != "P").alias("typed"))
    process = made.join(ends, "pid_node", "left").select(build, "pid_node", "typed", "end_ts")
    typed = orders.where(F.col("o_orderstatus") != "P")
    start = typed.select(build, pid(key).alias("pid_node"), format_time("o_orderdate").alias("start_ts"))
    number = key.cast("string")
    cmds = F.when(key % 10 == 0, F.array(F.concat(F.lit("cc -c "), number), F.concat(F.lit("cc1 "), number))).otherwise(F.array(F.concat(F.lit("cc -c "), number)))
    cmd = typed.select(build, pid(key).alias("pid_node"), F.explode(cmds).alias("cmd"))
    env = spark.createDataFrame([(BUILD, "p0", "HOME=/root"), (BUILD, "p0", "PATH=/usr/bin:/bin")], "build_id string, pid_node string, entry string")

    seen = lineitem.select(part_key, version.alias("v")).distinct().join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    v = F.col("v")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), part_key.cast("string"), pick(EXTS, part_key))
    digest = F.when((part_key + v) % 5 != 0, F.sha1(F.concat(F.lit("blob "), part_key.cast("string"), F.lit("_"), v.cast("string")).cast("binary")))
    sources = seen.select(build, F.concat(F.lit("f"), part_key.cast("string"), F.lit("_"), v.cast("string")).alias("file_node"), name.alias("name"), F.concat(pick(DIRS, part_key), name).alias("abspath"), digest.alias("hash"))
    programs = spark.createDataFrame([(BUILD, f"x{i}", p.rsplit("/", 1)[-1], p, None) for i, p in enumerate(EXECUTABLES)], "build_id string, file_node string, name string, abspath string, hash string")

    edge = lambda df: df.select(build, pid(F.col("l_orderkey")).alias("pid_node"), fid(part_key).alias("file_node")).distinct()
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    reads = edge(lineitem.where(flag.isin("N", "R")))
    written = edge(lineitem.where(((flag == "A") | ((flag == "R") & (status == "F"))) & (part_key % 4 != 1) & (version == 0)))
    writes = written.unionByName(spark.createDataFrame([(BUILD, "p0", "x8")], "build_id string, pid_node string, file_node string")).distinct()
    executable = lineitem.where("l_linenumber <= 2").select(build, pid(F.col("l_orderkey")).alias("pid_node"), F.concat(F.lit("x"), (F.col("l_suppkey") % 11).cast("string")).alias("file_node")).distinct()
    creates = orders.where(key >= 5).select(build, pid(F.expr("o_orderkey div 8")).alias("pid_node"), pid(key).alias("child_node"))
    parts_in_all = lineitem.agg((F.max("l_partkey") + 1).alias("n_parts"))
    moved = lineitem.where("l_linenumber = 7").crossJoin(F.broadcast(parts_in_all))
    ends_of = moved.select(pid(F.col("l_orderkey")).alias("pid_node"), fid(part_key).alias("from_node"), fid((part_key + 1) % F.col("n_parts")).alias("to_node")).distinct()
    rename = ends_of.select(build, F.concat_ws("-", F.lit("_:rename"), "pid_node", "from_node", "to_node").alias("rename_node"), "pid_node", "from_node", "to_node")
    return Graph(process, cmd, start, env, sources.unionByName(programs), reads, writes, executable, creates, rename)


def event_log(e: DataFrame) -> DataFrame:
    """The events table, or a stream of it, as system-call logs of 16 builds, in the reducer's columns. A rename is two rows, its
    entry and exit."""
    n, kind = F.col("event_id"), F.col("event_type")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    syscall = F.when(kind == "view", "open").when(kind == "click", F.when(n % 3 == 0, "rename").otherwise("close")).when(kind == "purchase", F.when(n % 2 == 0, "creat").otherwise("execve")).when(kind == "signup", "fork").otherwise("open")
    gone = (kind == "error") & (n % 3 == 0)
    hash_ = F.when(n % 5 != 0, text("h", n % 4))
    cols = e.select(
        text("b", F.col("user_id") % 16).alias("build_id"), n, F.col("ts"), F.expr("user_id div 16 % 6").alias("pid"), gone.alias("gone"), F.when(~gone, syscall).alias("syscall"),
        (F.lit(3) + n % 3).cast("int").alias("fd"), (n % 4).cast("int").alias("flags"), text("/s/f", n % 11).alias("abspath"), text("/s/g", n % 7).alias("new_abspath"),
        hash_.alias("hash"), (n % 6).alias("child_pid"), F.when(kind == "error", -1).otherwise(0).cast("long").alias("rval"),
    ).withColumn("step", F.explode(F.when(F.col("syscall") == "rename", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    op = F.when(F.col("gone"), "exited").when(F.col("step") == 0, "entry").otherwise("exit")
    return cols.select(
        "build_id", (n * 2 + F.col("step")).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "pid", op.alias("op"), "syscall", "fd", "flags", F.col("abspath").alias("path"), "abspath",
        F.col("new_abspath").alias("new_path"), "new_abspath", "hash", "child_pid", F.array(F.lit("run"), text("f ", n)).alias("cmdline"), F.lit(None).cast("array<string>").alias("env"), "rval",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, pid, fd, kind, event_type of the events table; failed calls (errors) are there, and to be dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type").isin("view", "click"), "open").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "signup", "exec").otherwise("failed")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("pid"), (F.lit(3) + F.col("event_id") % 3).alias("fd"), kind.alias("kind"), "event_type")
