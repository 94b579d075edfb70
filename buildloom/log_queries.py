"""More of the catalogue: what recorders see and do (logs, environments, paths, build plans), with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import auxiliary, paths
from .operators.events import numbered
from .operators.reducer import Reduction
from .plans.lookups import BUILD_SYSTEMS
from .plans.model import TRIPLES
from .sources import files, projection
from .storage import scratch
from .streaming.reducer import reduce_stream


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("key", F.col("p_partkey"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.event_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


# The reducer over the events table, seen as the logs of 16 builds.


def log_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered processes of every build: ids are reused after exit; typed by a successful exec; their last moment."""
    return Reduction(_log(spark, sf_dir)).process


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File versions, numbered as they come up: every opening for writing makes one, a reader finds the newest known."""
    return Reduction(_log(spark, sf_dir)).file


def log_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Reduction(_log(spark, sf_dir))
    created = r.creates.select("build_id", F.lit("creates").alias("edge"), "pid_node", F.col("child_node").alias("node"))
    return r.touches.withColumnRenamed("file_node", "node").unionByName(created)


def log_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reduction(_log(spark, sf_dir)).rename


def log_stream_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online reducer's triples of each predicate: the events table is read as a stream until it ends."""
    at = scratch(spark, "stream")
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _counted(reduce_stream(projection.event_log(spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]"))), at)


def log_stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a log whose events are numbered in each build and dealt to micro-batches by hash: none is in order."""
    at = scratch(spark, "stream")
    log = numbered(_log(spark, sf_dir), ("build_id",), ("seq",)).withColumn("seq", F.col("number")).drop("number")
    log.repartition(6, F.xxhash64("seq")).write.parquet(f"{at}/log")
    return _counted(reduce_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log"), dense=True), at)


def _counted(triples: DataFrame, at: str) -> DataFrame:
    """The stream is run to its end; its triples of each predicate. Its state has two partitions a core at most: each one starts
    Python and commits its state in every batch, whether it has a build's events or not."""
    spark, shuffles = triples.sparkSession, "spark.sql.shuffle.partitions"
    asked = spark.conf.get(shuffles)
    spark.conf.set(shuffles, str(min(int(asked), 2 * spark.sparkContext.defaultParallelism)))
    try:  # a query takes its settings when it starts
        run = triples.writeStream.format("parquet").option("path", f"{at}/triples").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(shuffles, asked)
    run.awaitTermination()
    return spark.read.schema(TRIPLES).parquet(f"{at}/triples").distinct().groupBy("build_id", "p").agg(F.count(F.lit(1)).alias("n"))


# Recording's small parts.


def rendered_cmdline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines are longer than what is recorded."""
    return _parts(spark, sf_dir).select("key", fn.command_line(F.array("p_brand", "p_type", F.repeat(F.concat("p_name", F.lit("/")), (F.col("key") % 60).cast("int")), "p_name")).alias("cmd"))


def guarded_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("key") % 7 != 0, F.col("p_name")).otherwise(F.lit(""))
    return _parts(spark, sf_dir).select("key", fn.file_hash(content, F.col("key") % 5 != 0).alias("hash"))


def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as metrics: customers of the base run against suppliers of the other; some have none."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select("n_nationkey", F.col("n_name").alias("metric"))
    many = lambda t, k: nation.join(read(t), F.col("n_nationkey") == F.col(k), "left").groupBy("metric").agg(F.concat(F.count(F.when(F.col(k) % 7 != 3, F.col(k))).cast("string"), F.lit("%")).alias("value"))
    return auxiliary.compare_metrics(many("customer", "c_nationkey"), many("supplier", "s_nationkey").where("metric not like 'A%'"))


def comment_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(_pick(("# ", "", " #", "#", "x # "), F.col("key")), F.col("p_name"))
    return auxiliary.drop_comments(_parts(spark, sf_dir).select("key", value.alias("value")))


def environment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat("p_brand", _pick(("=", "", "=a=", "=b c"), F.col("key")))
    rows = _parts(spark, sf_dir).select(F.lit("b").alias("build_id"), F.col("key").cast("string").alias("pid_node"), entry.alias("entry"))
    return files.environment(rows).select("pid_node", "var", "value")


def first_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select(F.concat(F.lit("r"), F.expr("p_partkey div 5").cast("string")).alias("repo"), F.concat("p_name", _pick((".spec", ".c", ".spec.in"), F.col("key"))).alias("filename"))
    return files.first_file(rows)


def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("key", fn.repository_name(F.concat(F.lit("https://host.example/a.git/"), F.replace("p_name", F.lit(" "), F.lit("-")), _pick((".git", "", ".git.x"), F.col("key")))).alias("name"))


FOLDERS, STEPS = ("/build/src", "/", "/a/b/../c"), ("x.c", "../x.c", "./y//z.h", "/usr/./lib/../include/q.h", "../../../../up", "a/..", "/..")


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    return _parts(spark, sf_dir).select("key", fn.resolve_path(_pick(FOLDERS, key), _pick(STEPS, key)).alias("path"))


def descriptor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that name paths relative to open folders, to the working folder, or to nothing that is open."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    op = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "signup", "chdir").otherwise("use")
    path = F.when(n % 3 == 0, F.concat(F.lit("/r"), (n % 9).cast("string"))).otherwise(F.concat(F.lit("d"), (n % 5).cast("string")))
    calls = e.select(
        F.lit("b").alias("build_id"), F.col("user_id").alias("pid"), n.alias("seq"), op.alias("op"), F.when(op.isin("open", "close"), 3 + n % 2).cast("int").alias("fd"),
        F.when(n % 4 != 0, 3 + F.expr("event_id div 3 % 2")).cast("int").alias("dirfd"), F.when(op != "close", path).alias("path"),
    )
    return paths.named_paths(calls, "/build").select("pid", "seq", "path")


def linked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to other folders, along chains, upwards and to themselves; paths through one or two of them, which may go up again."""
    key, parts = F.col("key"), _parts(spark, sf_dir)
    name = lambda k: k.cast("string")
    target = F.when(key % 4 == 0, F.concat(F.lit("/opt/x"), name(key))).when(key % 4 == 1, F.concat(F.lit("l"), name(key + 1))).when(key % 4 == 2, F.concat(F.lit("../share/./d"), name(key))).otherwise(F.concat(F.lit("l"), name(key), F.lit("/self")))
    links = parts.select(F.lit("b").alias("build_id"), F.concat(F.lit("/usr/lib/l"), name(key)).alias("link"), target.alias("target"))
    said = parts.select(F.lit("b").alias("build_id"), F.concat(F.lit("/usr/lib/l"), name(key), _pick(("/a/../b.h", "/../y", "", "//./../../usr/lib/l4/z"), F.expr("p_partkey div 4"))).alias("path"))
    return paths.resolved_links(said, links, most=6).select("path", "resolved")


def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that several folders of a search path have, and some that none has."""
    key = F.col("key")
    parts = _parts(spark, sf_dir)
    names = parts.select("key", F.concat(F.lit("tool"), (key % 40).cast("string")).alias("name"), _pick(("/bin:/usr/bin:/opt", "/opt:/bin", "/usr/bin"), key).alias("path"))
    there = parts.where(key <= 60).select(F.concat(_pick(("/bin", "/usr/bin", "/opt"), key), F.lit("/tool"), (key % 35).cast("string")).alias("abspath"))
    return auxiliary.path_search(names, there)


def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a repository, a source package, both, or neither; with and without a command, build system and spec file."""
    key, parts = F.col("key"), _parts(spark, sf_dir)
    request = key.cast("string").alias("request")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    requests = parts.select(
        request, F.when(key % 3 != 0, F.concat(F.lit("https://host.example/"), name, F.lit(".git"))).otherwise(F.when(key % 2 == 0, F.lit(""))).alias("git_url"),
        F.when(key % 5 == 0, F.lit("make all")).when(key % 5 == 1, F.lit("")).alias("git_build_cmd"), F.when(key % 4 != 0, F.lit("p.src.rpm")).alias("srpm"), name.alias("package"), F.when(key % 7 == 0, F.lit("/tmp/out")).alias("output_dir"),
    )
    listing = parts.select(key.cast("string").alias("repo"), F.explode(F.array(_pick(("configure", "main.c", "meson.build"), key), _pick(("Makefile", "README"), key))).alias("filename"))
    specs = parts.where(key % 6 != 1).select(key.cast("string").alias("repo"), F.explode(F.array(F.lit("b.spec"), F.concat(F.lit("a"), key.cast("string"), F.lit(".spec")), F.lit("a.txt"))).alias("filename"))
    return auxiliary.plan_builds(requests, listing, specs)


QUERIES = {f.__name__: f for f in (log_processes, log_files, log_edges, log_renames, log_stream_triples, log_stream_out_of_order, rendered_cmdline, guarded_hash, bench_compare, comment_lines_dropped, environment_entries, first_spec, repository_names, resolved_paths, descriptor_paths, linked_paths, path_search, build_plan)}


# SQL

_LOG = """
WITH e AS (SELECT *, user_id // 16 % 6 AS pid, event_type = 'error' AND event_id % 3 = 0 AS gone FROM events),
k AS (
  SELECT 'b' || (user_id % 16) AS build_id, event_id AS n, ts, pid, gone, CASE WHEN event_type = 'error' THEN -1 ELSE 0 END AS rval, 3 + event_id % 3 AS fd, event_id % 4 AS flags, '/s/f' || (event_id % 11) AS abspath,
         '/s/g' || (event_id % 7) AS new_abspath, CASE WHEN event_id % 5 <> 0 THEN 'h' || (event_id % 4) END AS hash, event_id % 6 AS child_pid,
         CASE WHEN gone THEN NULL WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'rename' ELSE 'close' END WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'creat' ELSE 'execve' END
              WHEN event_type = 'signup' THEN 'fork' ELSE 'open' END AS syscall FROM e),
l AS (SELECT *, 2 * n + step AS seq, CASE WHEN gone THEN 'exited' WHEN step = 0 THEN 'entry' ELSE 'exit' END AS op FROM k, (VALUES (0), (1)) t(step) WHERE step = 1 OR syscall = 'rename'),
log AS (SELECT *, coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY build_id, pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM l),
done AS (SELECT * FROM log WHERE op = 'exit' AND rval >= 0),
born AS (SELECT f.*, (SELECT count(*) FROM log x WHERE x.gone AND x.build_id = f.build_id AND x.pid = f.child_pid AND x.seq < f.seq) AS child_life FROM done f WHERE syscall = 'fork'),
mention AS (SELECT build_id, pid, life, seq FROM log WHERE NOT gone UNION ALL SELECT build_id, child_pid, child_life, seq FROM born),
first AS (SELECT build_id, pid, life, min(seq) AS first FROM mention GROUP BY ALL),
node AS (SELECT build_id, pid, life, ':p' || (row_number() OVER (PARTITION BY build_id ORDER BY first, pid) - 1) AS pid_node FROM first),
opened AS (SELECT *, CASE WHEN syscall = 'creat' THEN 1 ELSE flags & 3 END AS mode FROM done WHERE syscall IN ('open', 'creat')),
steps AS (SELECT build_id, pid, life, fd, seq, 1 AS d FROM opened WHERE mode IN (1, 2) UNION ALL SELECT build_id, pid, life, fd, seq, -1 FROM done WHERE syscall = 'close'),
s1 AS (SELECT *, sum(d) OVER (PARTITION BY build_id, pid, life, fd ORDER BY seq) AS s FROM steps),
s2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY build_id, pid, life, fd ORDER BY seq)) AS lo, coalesce(least(0, min(s) OVER (PARTITION BY build_id, pid, life, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS lo0 FROM s1),
s3 AS (SELECT *, CASE WHEN d = 1 THEN s - lo ELSE s - lo + 1 END AS level FROM s2 WHERE NOT (d = -1 AND s < lo0)),
s4 AS (SELECT *, lead(seq) OVER w AS seq1, lead(d) OVER w AS d1 FROM s3 WINDOW w AS (PARTITION BY build_id, pid, life, fd, level ORDER BY seq)),
made AS (
  SELECT o.build_id, o.pid, o.life, o.seq, o.mode, o.abspath, c.seq AS close_seq, c.hash FROM opened o JOIN s4 ON s4.build_id = o.build_id AND s4.seq = o.seq
  LEFT JOIN done c ON c.build_id = o.build_id AND s4.d1 = -1 AND c.seq = s4.seq1 WHERE o.mode IN (1, 2)),
uses AS (
  SELECT build_id, pid, life, seq, 'reads' AS use, abspath, hash FROM opened WHERE mode = 0 UNION ALL SELECT build_id, pid, life, seq, 'executable', abspath, hash FROM done WHERE syscall = 'execve'
  UNION ALL SELECT build_id, pid, life, seq, 'from', abspath, hash FROM log WHERE syscall = 'rename' AND op = 'entry'),
asks AS (SELECT build_id, seq, abspath, hash, NULL AS origin FROM uses UNION ALL SELECT build_id, close_seq, abspath, hash, seq FROM made WHERE close_seq IS NOT NULL),
a1 AS (SELECT *, last_value(origin IGNORE NULLS) OVER w AS newest, min(CASE WHEN origin IS NULL THEN seq END) OVER w AS first_use FROM asks WINDOW w AS (PARTITION BY build_id, abspath, hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
used AS (SELECT u.*, coalesce(newest, first_use) AS origin FROM uses u JOIN a1 USING (build_id, seq) WHERE a1.origin IS NULL),
renamed AS (
  SELECT r.build_id, r.pid, r.life, r.seq, r.new_abspath, f.origin AS from_origin, f.hash FROM done r ASOF JOIN (SELECT * FROM used WHERE use = 'from') f
  ON r.build_id = f.build_id AND r.pid = f.pid AND r.life = f.life AND r.seq >= f.seq WHERE r.syscall = 'rename'),
fresh AS (SELECT build_id, seq AS origin, abspath, hash FROM made UNION ALL SELECT build_id, origin, abspath, hash FROM used WHERE seq = origin UNION ALL SELECT build_id, seq, new_abspath, hash FROM renamed),
files AS (SELECT build_id, origin, abspath, hash, ':f' || (row_number() OVER (PARTITION BY build_id ORDER BY origin) - 1) AS file_node FROM fresh),
process AS (
  SELECT build_id, pid_node, EXISTS (SELECT 1 FROM done x WHERE x.syscall = 'execve' AND x.build_id = node.build_id AND x.pid = node.pid AND x.life = node.life) AS typed,
         (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') FROM log x WHERE x.gone AND x.build_id = node.build_id AND x.pid = node.pid AND x.life = node.life) AS end_ts FROM node),
touch AS (SELECT build_id, pid, life, use AS edge, origin FROM used WHERE use <> 'from' UNION ALL SELECT build_id, pid, life, 'writes', seq FROM made UNION ALL SELECT build_id, pid, life, 'reads', seq FROM made WHERE mode = 2),
edges AS (
  SELECT DISTINCT build_id, edge, pid_node, file_node AS node FROM touch JOIN node USING (build_id, pid, life) JOIN files USING (build_id, origin)
  UNION ALL SELECT DISTINCT b.build_id, 'creates', p.pid_node, c.pid_node FROM born b JOIN node p USING (build_id, pid, life) JOIN node c ON c.build_id = b.build_id AND c.pid = b.child_pid AND c.life = b.child_life),
renames AS (
  SELECT r.build_id, '_:rename' || (row_number() OVER (PARTITION BY r.build_id ORDER BY r.seq) - 1) AS rename_node, pid_node, a.file_node AS from_node, b.file_node AS to_node
  FROM renamed r JOIN node USING (build_id, pid, life) JOIN files a ON a.build_id = r.build_id AND a.origin = r.from_origin JOIN files b ON b.build_id = r.build_id AND b.origin = r.seq)
"""
_CMD = ("p_brand", "p_type", "repeat(p_name || '/', p_partkey % 60)", "p_name")
_ENDS = [" + ".join(f"strlen({c}) + 1" for c in _CMD[: i + 1]) for i in range(4)]
_QUOTED = ", ".join(f"CASE WHEN {e} <= 1023 THEN CASE WHEN contains({c}, ' ') THEN '''' || {c} || '''' ELSE {c} END END" for c, e in zip(_CMD, _ENDS))
_HELD = "greatest(" + ", ".join(f"CASE WHEN {e} <= 1023 THEN {e} ELSE 0 END" for e in _ENDS) + ")"
_choose = lambda values, n: "(CASE " + n + f" % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"
_systems = " ".join(f"WHEN list_contains(f, '{n}') THEN '{c}'" for n, c in BUILD_SYSTEMS)
_error = "CASE WHEN mode IS NULL THEN '{}' WHEN cmd IS NULL THEN CASE mode WHEN 'git' THEN '{}' ELSE '{}' END END".format(auxiliary.NO_SOURCE, auxiliary.NO_BUILD_SYSTEM, auxiliary.NO_SPEC)

SQL = {
    "log_processes": _LOG + "SELECT * FROM process",
    "log_files": _LOG + "SELECT build_id, file_node, abspath AS name, abspath, hash FROM files",
    "log_edges": _LOG + "SELECT * FROM edges",
    "log_renames": _LOG + "SELECT * FROM renames",
    "log_stream_triples": _LOG
    + """SELECT build_id, p, count(*) AS n FROM (
      SELECT build_id, 'a' AS p, pid_node AS s FROM process WHERE typed UNION ALL SELECT build_id, 'b:end', pid_node FROM process WHERE end_ts IS NOT NULL
      UNION ALL SELECT DISTINCT build_id, unnest(['b:start', 'b:cmd']), pid_node || '/' || CASE WHEN unnest([0, 1]) = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE CAST(n AS VARCHAR) END FROM done JOIN node USING (build_id, pid, life) WHERE syscall = 'execve'
      UNION ALL SELECT build_id, unnest(['a', 'b:name', 'b:abspath']), file_node FROM files UNION ALL SELECT build_id, 'b:hash', file_node FROM files WHERE hash IS NOT NULL
      UNION ALL SELECT build_id, 'b:' || edge, node FROM edges UNION ALL SELECT build_id, unnest(['b:rename', 'b:rename-from', 'b:rename-to']), rename_node FROM renames) GROUP BY ALL""",
    "rendered_cmdline": f"SELECT p_partkey AS key, array_to_string(list_filter([{_QUOTED}], lambda x: x IS NOT NULL), ' ') || CASE WHEN {_ENDS[3]} > 1023 AND {_HELD} BETWEEN 1 AND 1022 THEN ' ' ELSE '' END AS cmd FROM part",
    "guarded_hash": "SELECT p_partkey AS key, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'e69de29bb2d1d6434b8b29ae775ad8c2e48c5391' ELSE sha1('blob '::BLOB || CAST(strlen(p_name) AS VARCHAR)::BLOB || '\\x00'::BLOB || encode(p_name)) END END AS hash FROM part",
    "bench_compare": "SELECT metric, base, run, pct, metric || ': ' || base || ' | ' || coalesce(run, '') || ' | ' || pct AS line FROM (SELECT b.metric, b.n || '%' AS base, r.n || '%' AS run, CASE WHEN b.n = 0 THEN 'N/A' ELSE printf('%.6g', coalesce(r.n, 0)::DOUBLE / b.n * 100.0::DOUBLE) || '%' END AS pct FROM (SELECT n_name AS metric, count(CASE WHEN c_nationkey % 7 <> 3 THEN 1 END) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) b LEFT JOIN (SELECT n_name AS metric, count(CASE WHEN s_nationkey % 7 <> 3 THEN 1 END) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name NOT LIKE 'A%' GROUP BY 1) r USING (metric))",
    "comment_lines_dropped": f"SELECT key, value FROM (SELECT p_partkey AS key, {_choose(('# ', '', ' #', '#', 'x # '), 'p_partkey')} || p_name AS value FROM part) WHERE NOT starts_with(value, '#')",
    "environment_entries": f"SELECT pid_node, regexp_extract(entry, '^[^=]*') AS var, CASE WHEN contains(entry, '=') THEN regexp_extract(entry, '^[^=]*=(.*)$', 1) END AS value FROM (SELECT CAST(p_partkey AS VARCHAR) AS pid_node, p_brand || {_choose(('=', '', '=a=', '=b c'), 'p_partkey')} AS entry FROM part)",
    "first_spec": f"SELECT repo, min(filename) AS filename FROM (SELECT 'r' || (p_partkey // 5) AS repo, p_name || {_choose(('.spec', '.c', '.spec.in'), 'p_partkey')} AS filename FROM part) WHERE filename LIKE '%.spec' GROUP BY repo",
    "repository_names": "SELECT p_partkey AS key, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 2 THEN '.git.x' ELSE '' END AS name FROM part",
    "resolved_paths": f"SELECT key, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM (SELECT key, list_reduce(list_filter(string_split(CASE WHEN starts_with(step, '/') THEN step ELSE cwd || '/' || step END, '/'), lambda s: s NOT IN ('', '.')), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END, '') AS path FROM (SELECT p_partkey AS key, {_choose(FOLDERS, 'p_partkey')} AS cwd, {_choose(STEPS, 'p_partkey')} AS step FROM part))",
    "path_search": f"SELECT key, arg_min(abspath, place) AS abspath FROM (SELECT key, unnest(range(len(d))) AS place, unnest(d) || '/' || name AS abspath FROM (SELECT p_partkey AS key, 'tool' || (p_partkey % 40) AS name, string_split({_choose(('/bin:/usr/bin:/opt', '/opt:/bin', '/usr/bin'), 'p_partkey')}, ':') AS d FROM part)) WHERE abspath IN (SELECT {_choose(('/bin', '/usr/bin', '/opt'), 'p_partkey')} || '/tool' || (p_partkey % 35) FROM part WHERE p_partkey <= 60) GROUP BY key",
    "build_plan": f"""
WITH r AS (
  SELECT p_partkey AS k, replace(p_name, ' ', '-') AS name, p_partkey % 3 <> 0 AS git, p_partkey % 4 <> 0 AS rpm, CASE WHEN p_partkey % 5 = 0 THEN 'make all' END AS given,
         [{_choose(('configure', 'main.c', 'meson.build'), 'p_partkey')}, {_choose(('Makefile', 'README'), 'p_partkey')}] AS f, CASE WHEN p_partkey % 6 <> 1 THEN 'a' || p_partkey || '.spec' END AS spec,
         CASE WHEN p_partkey % 7 = 0 THEN '/tmp/out' ELSE '/output' END AS out FROM part),
m AS (SELECT *, CASE WHEN git THEN 'git' WHEN rpm THEN 'srpm' END AS mode, CASE WHEN git THEN coalesce(given, CASE {_systems} END) WHEN rpm THEN '{auxiliary.RPM_BUILD.replace("'", "''")}' || spec END AS cmd FROM r)
SELECT CAST(k AS VARCHAR) AS request, mode, CASE WHEN mode IS NOT NULL THEN name END AS name, CASE WHEN mode IS NOT NULL THEN out || '/' || name || '-build.out' END AS output_file, cmd AS build_cmd, {_error} AS error FROM m""",
}
SQL["log_stream_out_of_order"] = SQL["log_stream_triples"]
SQL["descriptor_paths"] = """
WITH RECURSIVE c AS (
  SELECT user_id AS pid, event_id AS seq, CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'signup' THEN 'chdir' ELSE 'use' END AS op, 3 + event_id % 2 AS fd,
         CASE WHEN event_id % 4 <> 0 THEN 3 + event_id // 3 % 2 END AS dirfd, CASE WHEN event_id % 3 = 0 THEN '/r' || (event_id % 9) ELSE 'd' || (event_id % 5) END AS path FROM events),
m AS (SELECT pid, fd AS mark, seq, op FROM c WHERE op IN ('open', 'close') UNION ALL SELECT pid, -1, seq, op FROM c WHERE op = 'chdir'),
a AS (SELECT pid, seq, path, coalesce(dirfd, -1) AS mark FROM c WHERE op <> 'close'),
b AS (SELECT a.pid, a.seq, a.path, a.mark, m.seq AS base, m.op FROM a ASOF LEFT JOIN m ON a.pid = m.pid AND a.mark = m.mark AND a.seq > m.seq),
r AS (
  SELECT pid, seq, CASE WHEN starts_with(path, '/') THEN path WHEN base IS NULL AND mark = -1 THEN '/build/' || path END AS path FROM b WHERE starts_with(path, '/') OR base IS NULL OR op = 'close'
  UNION ALL SELECT b.pid, b.seq, r.path || '/' || b.path FROM r JOIN b ON b.pid = r.pid AND b.base = r.seq WHERE NOT starts_with(b.path, '/') AND b.op <> 'close')
SELECT * FROM r"""
SQL["linked_paths"] = f"""
WITH RECURSIVE l AS (
  SELECT map_from_entries(list((('/usr/lib/l' || p_partkey), CASE p_partkey % 4 WHEN 0 THEN '/opt/x' || p_partkey WHEN 1 THEN 'l' || (p_partkey + 1) WHEN 2 THEN '../share/./d' || p_partkey ELSE 'l' || p_partkey || '/self' END))) AS m FROM part),
s AS (SELECT DISTINCT '/usr/lib/l' || p_partkey || {_choose(("/a/../b.h", "/../y", "", "//./../../usr/lib/l4/z"), "(p_partkey // 4)")} AS path FROM part),
r AS (
  SELECT path, '' AS done, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS rest, 0 AS n FROM s
  UNION ALL SELECT path, CASE WHEN rest[1] = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN t IS NULL THEN done || '/' || rest[1] WHEN starts_with(t, '/') THEN '' ELSE done END,
         CASE WHEN t IS NULL THEN rest[2:] ELSE list_concat(list_filter(string_split(t, '/'), lambda x: x NOT IN ('', '.')), rest[2:]) END, n + (t IS NOT NULL)::INTEGER
  FROM (SELECT r.*, CASE WHEN rest[1] <> '..' THEN element_at((SELECT m FROM l), done || '/' || rest[1])[1] END AS t FROM r WHERE len(rest) > 0 AND n <= 6))
SELECT path, CASE WHEN n <= 6 THEN CASE WHEN done = '' THEN '/' ELSE done END END AS resolved FROM r WHERE len(rest) = 0 OR n > 6"""
