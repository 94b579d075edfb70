"""The catalogue of queries over the test tables, each with the same query in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log_queries
from .functions import scalar as fn
from .operators import auxiliary, events
from .plans import reports
from .plans.lookups import BUILD_SYSTEMS, EXT_LANG, PACKAGE_ROLE, PROGRAM_PACKAGE
from .plans.model import Graph, from_triples
from .plans.sparql import compile_query
from .sources import projection, turtle

Query = Callable[[SparkSession, str], DataFrame]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


PRELUDE = f"""
exe_name AS (SELECT * FROM (VALUES {_values(enumerate(projection.EXECUTABLES))}) t(k, path)),
dirs AS (SELECT * FROM (VALUES {_values(enumerate(projection.DIRS))}) t(k, dir)),
exts AS (SELECT * FROM (VALUES {_values(enumerate(projection.EXTS))}) t(k, ext)),
ext_lang AS (SELECT * FROM (VALUES {_values(EXT_LANG.items())}) t(ext, lang)),
pkg_map AS (SELECT * FROM (VALUES {_values(PROGRAM_PACKAGE.items())}) t(name, pkg)),
pkg_role AS (SELECT * FROM (VALUES {_values(PACKAGE_ROLE.items())}) t(pkg, role)),
process AS (SELECT 'p' || o_orderkey AS pid, o_orderstatus <> 'P' AS typed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS start_ts, o_orderkey FROM orders),
typed AS (SELECT pid FROM process WHERE typed),
p_end AS (SELECT 'p' || l_orderkey AS pid, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') AS end_ts FROM lineitem GROUP BY l_orderkey),
cmd AS (SELECT pid, 'cc -c ' || o_orderkey AS cmd FROM process WHERE typed UNION SELECT pid, 'cc1 ' || o_orderkey FROM process WHERE typed AND o_orderkey % 10 = 0),
env AS (SELECT * FROM (VALUES ('p0', 'HOME=/root'), ('p0', 'PATH=/usr/bin:/bin')) t(pid, entry)),
file AS (
  SELECT DISTINCT 'f' || l_partkey || '_' || (l_suppkey % 3) AS fid, replace(p_name, ' ', '_') || l_partkey || e.ext AS name, d.dir || replace(p_name, ' ', '_') || l_partkey || e.ext AS abspath,
         CASE WHEN (l_partkey + l_suppkey % 3) % 5 = 0 THEN NULL ELSE sha1('blob ' || l_partkey || '_' || (l_suppkey % 3)) END AS hash
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN dirs d ON d.k = l_partkey % 8 JOIN exts e ON e.k = l_partkey % 11
  UNION ALL SELECT 'x' || k, regexp_extract(path, '[^/]*$'), path, NULL FROM exe_name),
reads AS (SELECT DISTINCT 'p' || l_orderkey AS pid, 'f' || l_partkey || '_' || (l_suppkey % 3) AS fid FROM lineitem WHERE l_returnflag IN ('N', 'R')),
writes AS (
  SELECT 'p' || l_orderkey AS pid, 'f' || l_partkey || '_' || (l_suppkey % 3) AS fid FROM lineitem
  WHERE (l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F')) AND l_partkey % 4 <> 1 AND l_suppkey % 3 = 0 UNION SELECT 'p0', 'x8'),
executable AS (SELECT DISTINCT 'p' || l_orderkey AS pid, 'x' || (l_suppkey % 11) AS fid FROM lineitem WHERE l_linenumber <= 2),
creates AS (SELECT 'p' || (o_orderkey // 8) AS pid, 'p' || o_orderkey AS cid FROM orders WHERE o_orderkey >= 5),
renames AS (
  SELECT DISTINCT 'p' || l_orderkey AS pid, 'f' || l_partkey || '_' || (l_suppkey % 3) AS from_fid,
         'f' || ((l_partkey + 1) % (SELECT max(l_partkey) + 1 FROM lineitem)) || '_' || (l_suppkey % 3) AS to_fid FROM lineitem WHERE l_linenumber = 7),
rename AS (SELECT '_:rename-' || pid || '-' || from_fid || '-' || to_fid AS rid, * FROM renames),
read_path AS (SELECT pid, fid, abspath AS path, hash FROM reads JOIN file USING (fid)),
write_path AS (SELECT pid, fid, abspath AS path, hash FROM writes JOIN file USING (fid)),
exec_path AS (SELECT pid, fid, abspath AS path FROM executable JOIN file USING (fid)),
exec_counts AS (SELECT path, count(*) AS n FROM exec_path WHERE pid IN (SELECT pid FROM typed) GROUP BY path),
triples AS (
  SELECT pid AS s, 'a' AS p, 'b:process' AS o, 'iri' AS k FROM typed
  UNION ALL SELECT process.pid, 'b:end', end_ts, 'literal' FROM process JOIN p_end USING (pid)
  UNION ALL SELECT pid, 'b:cmd', cmd, 'literal' FROM cmd UNION ALL SELECT pid, 'b:start', start_ts, 'literal' FROM process WHERE typed
  UNION ALL SELECT pid, 'b:env', entry, 'literal' FROM env UNION ALL SELECT fid, 'a', 'b:file', 'iri' FROM file
  UNION ALL SELECT fid, 'b:name', name, 'literal' FROM file UNION ALL SELECT fid, 'b:abspath', abspath, 'literal' FROM file
  UNION ALL SELECT fid, 'b:hash', hash, 'literal' FROM file WHERE hash IS NOT NULL
  UNION ALL SELECT pid, 'b:reads', fid, 'iri' FROM reads UNION ALL SELECT pid, 'b:writes', fid, 'iri' FROM writes
  UNION ALL SELECT pid, 'b:executable', fid, 'iri' FROM executable UNION ALL SELECT pid, 'b:creates', cid, 'iri' FROM creates
  UNION ALL SELECT pid, 'b:rename', rid, 'bnode' FROM rename UNION ALL SELECT rid, 'b:rename-from', from_fid, 'iri' FROM rename
  UNION ALL SELECT rid, 'b:rename-to', to_fid, 'iri' FROM rename),
lines AS (SELECT s || chr(9) || p || chr(9) || CASE k WHEN 'literal' THEN '"' || o || '"' ELSE o END || ' .' AS value FROM triples),
sources AS (
  SELECT DISTINCT path FROM read_path WHERE pid IN (SELECT pid FROM typed) AND (path LIKE '%.c' OR path LIKE '%.cpp' OR path LIKE '%.cc')
  AND NOT contains(path, 'CMakeFiles') AND NOT contains(path, 'TryCompile') AND NOT contains(path, 'conftest')
  AND (contains(path, '/BUILD/') OR contains(path, '/build/src/') OR contains(path, '/src/'))),
artifacts AS (
  SELECT DISTINCT path FROM write_path WHERE pid IN (SELECT pid FROM typed) AND NOT starts_with(path, '/tmp') AND path <> '/dev/null'
  AND NOT contains(path, 'CMakeFiles') AND NOT contains(path, 'TryCompile')),
roots AS (SELECT pid FROM typed WHERE pid NOT IN (SELECT cid FROM creates) ORDER BY CAST(substr(pid, 2) AS BIGINT) LIMIT 5),
root_children AS (SELECT roots.pid AS root, cid AS child, cmd.cmd FROM roots JOIN creates ON creates.pid = roots.pid LEFT JOIN cmd ON cmd.pid = cid),
calls AS (
  SELECT event_id AS seq, user_id AS pid, 3 + event_id % 3 AS fd, event_type,
         CASE WHEN event_type IN ('view', 'click') THEN 'open' WHEN event_type = 'purchase' THEN 'close' WHEN event_type = 'signup' THEN 'exec' ELSE 'failed' END AS kind FROM events)
"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([PRELUDE.strip(), *more]) + "\n" + body


def _graph(report: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: report(projection.graph(spark, sf_dir))


def _sparql(text: str) -> Query:
    return lambda spark, sf_dir: compile_query(projection.graph(spark, sf_dir), text)


def triple_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as statements, their nodes as :name, and parsed again."""
    named, about = _named_triples(spark, sf_dir)
    back = turtle.parse_lines(turtle.statements(named), about=about)
    bare = lambda c: F.when(F.startswith(c, F.lit(":")), F.substring(c, 2, 1 << 30)).otherwise(F.col(c)).alias(c)
    return back.select(bare("s"), "p", bare("o"))


def _named(triples: DataFrame) -> DataFrame:
    """Triples with their nodes as :name."""
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit(":"), c))
    is_node = (F.col("o_kind") != "literal") & (F.col("p") != "a")
    return triples.withColumns({"s": node("s"), "o": F.when(is_node, node("o")).otherwise(F.col("o"))})


def _named_triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The graph's triples with nodes as :name, and about how many there are, by the counts that the tables' files tell."""
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem")}
    return _named(projection.graph(spark, sf_dir).triples()), 8 * rows["orders"] + 4 * rows["lineitem"]


def bound_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_query(from_triples(*_named_triples(spark, sf_dir)), "SELECT ?p ?o WHERE { :p1 ?p ?o }")


def turtle_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with `;` and `,` lists, one for each process that has commands."""
    quoted = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('"'), fn.escape("cmd"), F.lit('"')))), " , ")
    said = projection.graph(spark, sf_dir).process_cmd.groupBy("build_id", "pid_node").agg(quoted.alias("cmds"))
    return turtle.parse_lines(said.select("build_id", F.concat(F.lit(":"), "pid_node", F.lit(" a b:process ; b:cmd "), "cmds", F.lit(" .")).alias("value"))).select("s", "p", "o")


def turtle_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part, its statements over several lines: blank nodes, long and single-quoted texts, numbers, other
    prefixes, and one statement that can't be read."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    text = F.concat(
        F.lit(f"PREFIX v: <{turtle.VOCABULARY}>\n@prefix d: <{turtle.DATA}> .\nd:f"), key, F.lit(" a v:file ;\n  v:name \'\'\'"), name, F.lit("\n. \"q\"\'\'\' ; # . ;\n  v:abspath \'/p/"), key,
        F.lit("\', 7 .\nd:p"), key, F.lit(" v:reads [ a v:file ; v:abspath \"/anon/"), key, F.lit("\" ] ,\n d:f"), key, F.lit(" .\nd:p"), key, F.lit(" v:reads [ d:f"), key, F.lit(" ] .\n"),
    )
    read = turtle.parse_texts(spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("build_id"), text.alias("value")))
    return read.select("build_id", "s", "p", "o", "unread", "line")


def _spelled(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph with texts that are spelled like nodes and names: each command's process has its parent's name as a text too."""
    named, about = _named_triples(spark, sf_dir)
    typed, n = named.where("p = 'a' and o = 'b:process'"), F.substring("s", 3, 20).cast("long")
    texts = typed.select("build_id", "s", F.lit("b:cmd").alias("p"), F.concat(F.lit(":p"), F.expr("cast(substring(s, 3) as long) div 8")).alias("o"), F.lit("literal").alias("o_kind"))
    names = typed.where(n % 7 == 0).select("build_id", "s", F.lit("b:env").alias("p"), F.lit("b:process").alias("o"), F.lit("literal").alias("o_kind"))
    return from_triples(named.unionByName(texts).unionByName(names), about)


def sparql_nodes_not_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_query(_spelled(spark, sf_dir), "SELECT ?s ?x WHERE { ?s ?p ?x . ?x a b:process }")


def sparql_texts_not_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_query(_spelled(spark, sf_dir), 'SELECT ?s ?p WHERE { ?s ?p "b:process" }')


def sparql_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = from_triples(*_named_triples(spark, sf_dir))
    return compile_query(named, 'SELECT ?s ?o WHERE { ?s b:creates ?o . FILTER(STRENDS(STR(?s), "data#p1") || REGEX(STR(?o), "#p1[0-9]$")) }')


def sparql_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file was made from, and what that was made from, and so on."""
    named = from_triples(*_named_triples(spark, sf_dir))
    return compile_query(named, "SELECT DISTINCT ?source WHERE { :f2_0 (^b:writes/b:reads)+ ?source }")


def graph_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's graph is its schema header and its data: statements by predicate."""
    schema = spark.createDataFrame(turtle.schema_triples(), "s string, p string, o string, o_kind string").select("p")
    return projection.graph(spark, sf_dir).triples().select("p").union(schema).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def access_mode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("pid_node"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_node"), (F.col("l_linenumber") % 4).alias("flags"))
    return opened.select("pid_node", "file_node", F.explode(fn.access_edges("flags")).alias("edge")).distinct()


def fd_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = projection.events(spark, sf_dir).where("kind in ('open', 'close')")
    return events.fd_sessions(log.withColumn("d", F.when(F.col("kind") == "open", 1).otherwise(-1)))


def syscall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = projection.events(spark, sf_dir)
    return events.syscall_pairs(log.withColumn("op", F.when(F.col("event_type").isin("view", "click"), "entry").when(F.col("event_type").isin("purchase", "signup"), "exit")))


def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    log = projection.events(spark, sf_dir).where("kind = 'open'").select("seq", F.concat(F.lit("/src/f"), (seq % 17).cast("string")).alias("abspath"), F.when(seq % 5 != 0, F.concat(F.lit("h"), (seq % 7).cast("string"))).alias("hash"), F.concat(F.lit("b"), (F.col("pid") % 8).cast("string")).alias("build_id"))
    return events.file_identity(log, ("build_id",))


def live_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = projection.events(spark, sf_dir).where("event_type in ('signup', 'error')").select((F.col("pid") % 8).alias("build"), "seq", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("delta"))
    return events.running_processes(log, ("build",))


def git_blob_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), fn.blob_hash("p_name").alias("hash"))


def line_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auxiliary.line_counts(turtle.statements(projection.graph(spark, sf_dir).triples()))


def section_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 11
    line = F.when(e == 0, "%check").when(e == 3, "%install").when(e == 7, "%if 1").when(e == 9, "%{macro}").otherwise(F.concat(F.lit("make "), F.col("event_type")))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 64).alias("spec"), F.col("event_id").alias("n"), line.alias("line"))
    return auxiliary.strip_section(lines, ("spec",)).select("n", "line")


def build_system_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, _ in BUILD_SYSTEMS] + ["README", "setup.py", "main.c", "go.mod", "BUILD"]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("r"), F.expr("p_partkey div 3").cast("string")).alias("repo"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 11 + 1).cast("int")).alias("filename"))
    return auxiliary.choose_build_system(part)


# The reports' questions as SPARQL texts, which users may ask as well; names stand as the projection has them.
SPARQL = {
    "sparql_descendants": "SELECT ?ancestor ?process WHERE { ?ancestor b:creates+ ?process }",
    "sparql_optional_join": "SELECT ?f ?h WHERE { ?f b:abspath ?path . OPTIONAL { ?f b:hash ?h } OPTIONAL { ?f b:name ?h } }",
    "sparql_union_join": "SELECT ?p ?f WHERE { { ?p b:executable ?x } UNION { ?p b:reads ?f } ?p b:writes ?f }",
    "sparql_minus_having": "SELECT ?p (COUNT(?f) AS ?n) WHERE { ?p b:reads ?f . MINUS { ?q b:writes ?f } } GROUP BY ?p HAVING (?n > 2)",
    "sparql_exec_counts": "SELECT ?path (COUNT(?proc) AS ?n) WHERE { ?proc a b:process ; b:executable ?exe . ?exe b:abspath ?path . } GROUP BY ?path ORDER BY DESC(?n)",
    "sparql_external_libs": """SELECT DISTINCT ?path ?hash WHERE { ?proc b:reads ?file . ?file b:abspath ?path . OPTIONAL { ?file b:hash ?hash } FILTER NOT EXISTS { ?any b:writes ?file }
        FILTER(STRSTARTS(STR(?path),"/usr/lib") || STRSTARTS(STR(?path),"/lib")) FILTER(CONTAINS(STR(?path),".so")) } ORDER BY ?path""",
    "sparql_timeline": "SELECT (MIN(?s) AS ?begin_ts) (MAX(?e) AS ?finish_ts) WHERE { ?p a b:process ; b:start ?s ; b:end ?e . }",
    "sparql_headers_top15": """SELECT ?path (COUNT(?proc) AS ?n) WHERE { ?proc a b:process ; b:reads ?file . ?file b:abspath ?path . FILTER(STRENDS(STR(?path),".h")) FILTER(STRSTARTS(STR(?path),"/usr/")) }
        GROUP BY ?path ORDER BY DESC(?n) ?path LIMIT 15""",
    "sparql_correlated": "SELECT ?p ?f WHERE { ?p b:writes ?f . FILTER NOT EXISTS { ?q b:writes ?f . FILTER(?q != ?p) } }",
    "sparql_children": "SELECT ?child ?cmd WHERE { ?root b:creates ?child . OPTIONAL { ?child b:cmd ?cmd } FILTER(STR(?root) = \"p1\") }",
}

GRAPH_QUERIES: dict[str, Callable[..., DataFrame]] = {
    "stats_processes": reports.processes,
    "stats_files": reports.files,
    "stats_reads": reports.reads,
    "stats_writes": reports.writes,
    "stats_renames": reports.renames,
    "stats_creates": reports.creates,
    "stats_overview": reports.overview,
    "timeline": reports.timeline,
    "exec_counts": reports.exec_counts,
    "exec_counts_by_name": reports.exec_counts_by_name,
    "source_reads_by_ext": reports.source_reads_by_ext,
    "tools_by_package": reports.tools_by_package,
    "tools_detail": reports.tools_detail,
    "external_executables": reports.external_executables,
    "external_libs": reports.external_libs,
    "project_sources": reports.project_sources,
    "project_sources_report": reports.project_sources_report,
    "project_sources_relative": reports.project_sources_relative,
    "artifacts": reports.artifacts,
    "artifacts_by_ext": reports.artifacts_by_ext,
    "built_libs": reports.built_libs,
    "process_roots": reports.process_roots,
    "root_commands": reports.root_commands,
    "root_children": reports.root_children,
    "tree_two_levels": reports.tree_two_levels,
    "headers_top15": reports.headers_top,
    "sources_c_only": reports.sources_c_only,
    "renames_resolved": reports.renames_resolved,
    "renamed_external": reports.renamed_external,
    "multi_exec_processes": reports.multi_exec_processes,
    "untyped_processes": reports.untyped_processes,
    "file_versions_per_path": reports.file_versions_per_path,
    "unhashed_files": reports.unhashed_files,
    "triples_by_predicate": reports.triples_by_predicate,
}

TABLE_QUERIES: dict[str, Query] = {f.__name__: f for f in (triple_roundtrip, access_mode_edges, fd_sessions, syscall_pairs, file_identity, live_processes, git_blob_hash, line_pattern_counts, section_strip, build_system_choice, bound_subject, turtle_lists, graph_with_schema, turtle_general, sparql_nodes_not_texts, sparql_texts_not_names, sparql_iris, sparql_lineage)}


def queries() -> dict[str, Query]:
    return {n: _graph(r) for n, r in GRAPH_QUERIES.items()} | TABLE_QUERIES | log_queries.QUERIES | {n: _sparql(t) for n, t in SPARQL.items()}


_TYPED = "pid IN (SELECT pid FROM typed)"
_ANY_SOURCE = " OR ".join(f"path LIKE '%.{e}'" for e in ("c", "cpp", "cc", "inl", "lua", "py", "js", "ssjs", "sh"))
_HEADERS = f"SELECT path, replace(replace(path, '/usr/lib64/gcc/x86_64-alt-linux/13/', '<gcc>/'), '/usr/include/', '<inc>/') AS short_path, count(*) AS n FROM read_path WHERE {_TYPED} AND path LIKE '%.h' AND starts_with(path, '/usr/') GROUP BY path ORDER BY n DESC, path LIMIT 15"
_EXTERNAL = "SELECT DISTINCT path, hash FROM read_path WHERE fid NOT IN (SELECT fid FROM writes) AND (starts_with(path, '/usr/lib') OR starts_with(path, '/lib')) AND contains(path, '.so')"
_SPAN = f"SELECT min(start_ts) AS begin_ts, max(end_ts) AS finish_ts FROM process JOIN p_end USING (pid) WHERE typed"
_RELATIVE = """SELECT path, replace(path, coalesce((SELECT regexp_extract(path, '^(.*?(?:/BUILD/[^/]+/|/build/src/))', 1) FROM sources WHERE regexp_matches(path, '/BUILD/[^/]+/|/build/src/') ORDER BY path LIMIT 1), ''), '') AS rel_path FROM sources"""

_BODIES = {
    "sparql_descendants": "SELECT ancestor, process FROM descent",
    "sparql_lineage": "SELECT ':' || fid AS source FROM lineage",
    "sparql_optional_join": "SELECT fid AS f, coalesce(hash, name) AS h FROM file",
    "sparql_union_join": "SELECT pid AS p, w.fid AS f FROM executable JOIN writes w USING (pid) UNION ALL SELECT pid, fid FROM reads JOIN writes USING (pid, fid)",
    "sparql_minus_having": "SELECT pid AS p, count(*) AS n FROM reads WHERE fid NOT IN (SELECT fid FROM writes) GROUP BY pid HAVING count(*) > 2",
    "sparql_nodes_not_texts": "SELECT ':' || pid AS s, ':' || cid AS x FROM creates WHERE cid IN (SELECT pid FROM typed)",
    "sparql_texts_not_names": "SELECT ':' || pid AS s, 'b:env' AS p FROM typed WHERE CAST(substr(pid, 2) AS BIGINT) % 7 = 0",
    "sparql_iris": "SELECT ':' || pid AS s, ':' || cid AS o FROM creates WHERE pid = 'p1' OR regexp_full_match(cid, 'p1[0-9]')",
    "turtle_general": """
SELECT CAST(p_partkey AS VARCHAR) AS build_id, replace(t.s, '#', p_partkey::VARCHAR) AS s, t.p, CASE WHEN t.o = 'NAME' THEN p_name || chr(10) || '. "q"' ELSE replace(t.o, '#', p_partkey::VARCHAR) END AS o, replace(t.unread, '#', p_partkey::VARCHAR) AS unread, t.line
FROM part, (VALUES (':f#', 'a', 'b:file', NULL, NULL), (':f#', 'b:name', 'NAME', NULL, NULL), (':f#', 'b:abspath', '/p/#', NULL, NULL), (':f#', 'b:abspath', '7', NULL, NULL), (':p#', 'b:reads', '_:anon0', NULL, NULL),
  ('_:anon0', 'a', 'b:file', NULL, NULL), ('_:anon0', 'b:abspath', '/anon/#', NULL, NULL), (':p#', 'b:reads', ':f#', NULL, NULL), (NULL, NULL, NULL, 'd:p# v:reads [ d:f# ] .', 9)) t(s, p, o, unread, line)""",
    "stats_processes": "SELECT count(*) AS n FROM typed",
    "stats_files": "SELECT count(*) AS n FROM file",
    "stats_reads": "SELECT count(*) AS n FROM reads",
    "stats_writes": "SELECT count(*) AS n FROM writes",
    "stats_renames": "SELECT count(*) AS n FROM renames",
    "stats_creates": "SELECT count(*) AS n FROM creates",
    "stats_overview": "SELECT 'processes' AS metric, count(*) AS n FROM typed " + " ".join(f"UNION ALL SELECT '{t}', count(*) FROM {v}" for t, v in (("files", "file"), ("reads", "reads"), ("writes", "writes"), ("renames", "renames"), ("creates", "creates"))),
    "timeline": f"SELECT begin_ts, finish_ts, CAST(epoch(strptime(finish_ts, '%Y-%m-%dT%H:%M:%SZ')) - epoch(strptime(begin_ts, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS duration_s, ((CAST(epoch(strptime(finish_ts, '%Y-%m-%dT%H:%M:%SZ')) - epoch(strptime(begin_ts, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) % 86400) + 86400) % 86400 AS duration_mod_day FROM ({_SPAN})",
    "exec_counts": "SELECT path, n FROM exec_counts",
    "exec_counts_by_name": "SELECT regexp_extract(path, '[^/]*$') AS name, path, n FROM exec_counts",
    "source_reads_by_ext": f"SELECT s.ext, n, coalesce(lang, s.ext) AS lang FROM (SELECT regexp_extract(path, '[^.]*$') AS ext, count(*) AS n FROM read_path WHERE {_TYPED} AND NOT contains(path, 'TryCompile') AND ({_ANY_SOURCE}) GROUP BY 1) s LEFT JOIN ext_lang USING (ext)",
    "tools_by_package": "SELECT t.pkg, n, coalesce(role, '—') AS role FROM (SELECT coalesce(m.pkg, e.name) AS pkg, CAST(sum(n) AS BIGINT) AS n FROM (SELECT regexp_extract(path, '[^/]*$') AS name, n FROM exec_counts) e LEFT JOIN pkg_map m ON m.name = e.name GROUP BY 1) t LEFT JOIN pkg_role r ON r.pkg = t.pkg",
    "tools_detail": "SELECT e.name, coalesce(m.pkg, e.name) AS pkg, n FROM (SELECT regexp_extract(path, '[^/]*$') AS name, n FROM exec_counts) e LEFT JOIN pkg_map m ON m.name = e.name",
    "external_executables": "SELECT DISTINCT path FROM exec_path WHERE fid NOT IN (SELECT fid FROM writes)",
    "external_libs": f"SELECT path, regexp_extract(path, '[^/]*$') AS name, hash, left(hash, 16) AS hash16 FROM ({_EXTERNAL})",
    "project_sources": "SELECT path FROM sources",
    "project_sources_report": f"SELECT DISTINCT path FROM read_path WHERE {_TYPED} AND (path LIKE '%.c' OR path LIKE '%.cpp' OR path LIKE '%.cc') AND contains(path, '/BUILD/') AND NOT contains(path, 'CMakeFiles') AND NOT contains(path, 'TryCompile')",
    "project_sources_relative": _RELATIVE,
    "artifacts": "SELECT path FROM artifacts",
    "artifacts_by_ext": "SELECT ext, count(*) AS n, string_agg(name, ', ' ORDER BY path) FILTER (WHERE place <= 3) || CASE WHEN count(*) > 3 THEN ' … (+' || (count(*) - 3) || ')' ELSE '' END AS sample FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path) AS place FROM (SELECT path, name, CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE 'no-ext' END AS ext FROM (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM artifacts))) GROUP BY ext",
    "built_libs": f"SELECT DISTINCT path, hash FROM write_path WHERE {_TYPED} AND (contains(path, '.so') OR path LIKE '%.a') AND NOT starts_with(path, '/tmp') AND NOT contains(path, 'TryCompile')",
    "process_roots": "SELECT pid AS pid_node FROM roots",
    "root_commands": "SELECT roots.pid AS pid_node, min(cmd.cmd) AS cmd FROM roots LEFT JOIN cmd USING (pid) GROUP BY roots.pid",
    "root_children": "SELECT root, child, cmd FROM root_children",
    "tree_two_levels": "SELECT root, CAST(rn AS INTEGER) AS rn, child, cmd65, hidden FROM (SELECT root, row_number() OVER (PARTITION BY root ORDER BY CAST(substr(child, 2) AS BIGINT), cmd NULLS FIRST) AS rn, child, coalesce(left(cmd, 65), '?') AS cmd65, greatest(count(*) OVER (PARTITION BY root) - 6, 0) AS hidden FROM root_children) WHERE rn <= 6",
    "headers_top15": _HEADERS,
    "sources_c_only": f"SELECT DISTINCT path FROM read_path WHERE {_TYPED} AND path LIKE '%.c'",
    "renames_resolved": "SELECT pid AS pid_node, a.abspath AS from_path, b.abspath AS to_path FROM renames JOIN file a ON a.fid = from_fid JOIN file b ON b.fid = to_fid",
    "renamed_external": "SELECT DISTINCT path FROM read_path WHERE fid IN (SELECT to_fid FROM renames) AND fid NOT IN (SELECT fid FROM writes)",
    "multi_exec_processes": "SELECT pid AS pid_node, count(*) AS n FROM executable GROUP BY pid HAVING count(*) > 1",
    "untyped_processes": "SELECT pid AS pid_node FROM process WHERE NOT typed",
    "file_versions_per_path": "SELECT abspath AS path, count(*) AS n_versions FROM file GROUP BY abspath",
    "unhashed_files": "SELECT DISTINCT abspath AS path FROM file WHERE hash IS NULL",
    "triples_by_predicate": "SELECT p, count(*) AS n FROM triples GROUP BY p",
    "triple_roundtrip": "SELECT s, p, o FROM triples",
    "access_mode_edges": "SELECT DISTINCT 'p' || l_orderkey AS pid_node, 'f' || l_partkey AS file_node, unnest(CASE l_linenumber % 4 WHEN 0 THEN ['reads'] WHEN 1 THEN ['writes'] WHEN 2 THEN ['reads', 'writes'] ELSE [] END) AS edge FROM lineitem",
    "syscall_pairs": "SELECT pid, seq0 AS entry_seq, seq AS exit_seq FROM (SELECT *, lag(op) OVER w AS op0, lag(seq) OVER w AS seq0 FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'entry' ELSE 'exit' END AS op FROM calls WHERE event_type IN ('view', 'click', 'purchase', 'signup')) WINDOW w AS (PARTITION BY pid ORDER BY seq)) WHERE op = 'exit' AND op0 = 'entry'",
    "file_identity": "SELECT build_id, abspath, hash, row_number() OVER (PARTITION BY build_id ORDER BY s) - 1 AS node_no FROM (SELECT 'b' || (pid % 8) AS build_id, '/src/f' || (seq % 17) AS abspath, CASE WHEN seq % 5 <> 0 THEN 'h' || (seq % 7) END AS hash, min(seq) AS s FROM calls WHERE kind = 'open' GROUP BY ALL)",
    "live_processes": "SELECT pid % 8 AS build, seq, CAST(1 + sum(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY pid % 8 ORDER BY seq) AS BIGINT) AS running FROM calls WHERE event_type IN ('signup', 'error')",
    "git_blob_hash": "SELECT p_partkey AS key, sha1('blob '::BLOB || CAST(strlen(p_name) AS VARCHAR)::BLOB || '\\x00'::BLOB || encode(p_name)) AS hash FROM part",
    "line_pattern_counts": "SELECT pattern, count(*) FILTER (WHERE regexp_matches(value, pattern)) AS n FROM lines, (VALUES ('\\.'), ('a.*b:process'), ('a.*b:file')) t(pattern) GROUP BY pattern",
    "section_strip": "SELECT n, unnest(CASE WHEN starts_with(line, '%check') THEN ['%check', 'exit 0'] ELSE [line] END) AS line FROM (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^%[a-zA-Z_]') THEN starts_with(line, '%check') END IGNORE NULLS) OVER (PARTITION BY spec ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM (SELECT user_id % 64 AS spec, event_id AS n, CASE event_id % 11 WHEN 0 THEN '%check' WHEN 3 THEN '%install' WHEN 7 THEN '%if 1' WHEN 9 THEN '%{macro}' ELSE 'make ' || event_type END AS line FROM events)) WHERE starts_with(line, '%check') OR NOT inside",
    "build_system_choice": f"SELECT 'r' || (p_partkey // 3) AS repo, (array_agg(cmd ORDER BY rank) FILTER (WHERE cmd IS NOT NULL))[1] AS cmd FROM part LEFT JOIN (VALUES {_values([(i, i, c) for i, (_, c) in enumerate(BUILD_SYSTEMS)])}) t(place, rank, cmd) ON place = p_partkey % 11 GROUP BY 1",
    "sparql_exec_counts": "SELECT path, n FROM exec_counts",
    "sparql_external_libs": _EXTERNAL,
    "sparql_timeline": _SPAN,
    "sparql_headers_top15": f"SELECT path, n FROM ({_HEADERS})",
    "sparql_correlated": "SELECT min(pid) AS p, fid AS f FROM writes GROUP BY fid HAVING count(*) = 1",
    "bound_subject": "SELECT p, CASE WHEN k <> 'literal' AND p <> 'a' AND NOT starts_with(o, '_:') THEN ':' || o ELSE o END AS o FROM triples WHERE s = 'p1'",
    "turtle_lists": "SELECT ':' || pid AS s, 'b:cmd' AS p, cmd AS o FROM cmd UNION ALL SELECT DISTINCT ':' || pid, 'a', 'b:process' FROM cmd",
    "graph_with_schema": "SELECT p, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p, count(*) AS n FROM triples GROUP BY p UNION ALL SELECT * FROM (VALUES ('a', 15), ('rdfs:label', 15), ('rdfs:comment', 15), ('rdfs:domain', 13), ('rdfs:range', 13)) t(p, n)) GROUP BY p",
    "sparql_children": "SELECT cid AS child, cmd.cmd FROM creates LEFT JOIN cmd ON cmd.pid = cid WHERE creates.pid = 'p1'",
}

_FD_SESSIONS = """
WITH ev AS (SELECT event_id AS seq, user_id AS pid, 3 + event_id % 3 AS fd, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS d FROM events WHERE event_type IN ('view', 'click', 'purchase')),
r AS (SELECT *, sum(d) OVER (PARTITION BY pid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM ev),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY pid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lo,
             coalesce(least(0, min(s) OVER (PARTITION BY pid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS lo_prev FROM r),
k AS (SELECT *, CASE WHEN d = 1 THEN s - lo ELSE s - lo + 1 END AS lvl FROM m WHERE NOT (d = -1 AND s < lo_prev)),
p AS (SELECT *, lead(seq) OVER (PARTITION BY pid, fd, lvl ORDER BY seq) AS nseq, lead(d) OVER (PARTITION BY pid, fd, lvl ORDER BY seq) AS nd FROM k)
SELECT pid, fd, seq AS open_seq, CASE WHEN nd = -1 THEN nseq END AS close_seq FROM p WHERE d = 1
"""


#: What recursive queries are made from; their WITH is a WITH RECURSIVE.
_RECURSIVE = {
    "sparql_descendants": "descent AS (SELECT pid AS ancestor, cid AS process FROM creates UNION SELECT ancestor, cid FROM descent JOIN creates ON creates.pid = process)",
    "sparql_lineage": "lineage AS (SELECT r.fid FROM writes w JOIN reads r USING (pid) WHERE w.fid = 'f2_0' UNION SELECT r.fid FROM lineage l JOIN writes w ON w.fid = l.fid JOIN reads r USING (pid))",
}


def oracle_sql() -> dict[str, str]:
    return {n: "WITH RECURSIVE " + _sql(b, _RECURSIVE[n]).removeprefix("WITH ") if n in _RECURSIVE else _sql(b) for n, b in _BODIES.items()} | {"fd_sessions": _FD_SESSIONS} | log_queries.SQL
