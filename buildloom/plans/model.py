"""The provenance graph as property tables, and its triples as a derived view."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "process": "build_id string, pid_node string, typed boolean, end_ts string",
    "process_cmd": "build_id string, pid_node string, cmd string",
    "process_start": "build_id string, pid_node string, start_ts string",
    "process_env": "build_id string, pid_node string, entry string",
    "file": "build_id string, file_node string, name string, abspath string, hash string",
    "reads": "build_id string, pid_node string, file_node string",
    "writes": "build_id string, pid_node string, file_node string",
    "executable": "build_id string, pid_node string, file_node string",
    "creates": "build_id string, pid_node string, child_node string",
    "rename": "build_id string, rename_node string, pid_node string, from_node string, to_node string",
}
TRIPLES = "build_id string, s string, p string, o string, o_kind string"


@dataclass(frozen=True)
class Graph:
    """Tables are sets: an edge that is recorded twice is one row. A process without a successful exec isn't typed and has
    no command or start. A file node is a version of a path: every opening for writing makes a new one."""

    process: DataFrame
    process_cmd: DataFrame
    process_start: DataFrame
    process_env: DataFrame
    file: DataFrame
    reads: DataFrame
    writes: DataFrame
    executable: DataFrame
    creates: DataFrame
    rename: DataFrame
    #: All triples that the tables were made from, where they were: also those that no table has a place for.
    said: DataFrame | None = None

    @property
    def parts(self) -> int | None:
        """Tasks over which triples are dealt to make a set of them and to join them; None: as many as the session has."""
        return None

    @property
    def typed(self) -> DataFrame:
        return self.process.where("typed").select("build_id", "pid_node")

    def only(self, build_id: str) -> Graph:
        of = {n: getattr(self, n) for n in (*SCHEMAS, "said")}
        return replace(self, **{n: t.where(F.col("build_id") == build_id) for n, t in of.items() if t is not None})

    def triples(self) -> DataFrame:
        if self.said is not None:
            return self.said

        def rows(df: DataFrame, s: Column | str, p: str, o: Column | str, kind: str) -> DataFrame:
            put = lambda x: F.col(x) if isinstance(x, str) else x
            return df.select("build_id", put(s).alias("s"), F.lit(p).alias("p"), put(o).alias("o"), F.lit(kind).alias("o_kind"))

        parts = [
            rows(self.process.where("typed"), "pid_node", "a", F.lit("b:process"), "iri"),
            rows(self.process.where("end_ts is not null"), "pid_node", "b:end", "end_ts", "literal"),
            rows(self.process_cmd, "pid_node", "b:cmd", "cmd", "literal"),
            rows(self.process_start, "pid_node", "b:start", "start_ts", "literal"),
            rows(self.process_env, "pid_node", "b:env", "entry", "literal"),
            rows(self.file, "file_node", "a", F.lit("b:file"), "iri"),
            rows(self.file.where("name is not null"), "file_node", "b:name", "name", "literal"),
            rows(self.file.where("abspath is not null"), "file_node", "b:abspath", "abspath", "literal"),
            rows(self.file.where("hash is not null"), "file_node", "b:hash", "hash", "literal"),
            rows(self.reads, "pid_node", "b:reads", "file_node", "iri"),
            rows(self.writes, "pid_node", "b:writes", "file_node", "iri"),
            rows(self.executable, "pid_node", "b:executable", "file_node", "iri"),
            rows(self.creates, "pid_node", "b:creates", "child_node", "iri"),
            rows(self.rename, "pid_node", "b:rename", "rename_node", "bnode"),
            rows(self.rename, "rename_node", "b:rename-from", "from_node", "iri"),
            rows(self.rename, "rename_node", "b:rename-to", "to_node", "iri"),
        ]
        return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Counted(Graph):
    """A graph of about a known number of triples, so of a known number of tasks. A graph itself has tables alone."""

    parts: int = 1


#: Triples of a task.
PART = 1_000_000


def tasks(spark: SparkSession, about: int | None) -> int | None:
    """Tasks for about as many triples; None if their number isn't known."""
    return None if about is None else max(spark.sparkContext.defaultParallelism, -(-about // PART))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, *keys)


def from_triples(triples: DataFrame, about: int | None = None) -> Graph:
    """Property tables of a set of triples. A second value of a single-valued property isn't expected; the least one counts.
    Texts where a node belongs, nodes where a text belongs, and properties that no table has are in `said` alone. about: how many
    triples there are, if that is known; then tasks over them don't grow with their number."""
    parts = tasks(triples.sparkSession, about)
    texts = F.col("p").isin("b:cmd", "b:start", "b:end", "b:env", "b:name", "b:abspath", "b:hash")
    t = triples.where(texts == (F.col("o_kind") == "literal")).select("build_id", "s", "p", "o").distinct()

    def edge(p: str, s: str, o: str) -> DataFrame:
        return t.where(F.col("p") == p).select("build_id", F.col("s").alias(s), F.col("o").alias(o))

    is_process = (F.col("p") == "a") & (F.col("o") == "b:process")
    acts = F.col("p").isin("b:cmd", "b:start", "b:end", "b:env", "b:reads", "b:writes", "b:executable", "b:creates", "b:rename")
    own = t.where(is_process | acts).select("build_id", F.col("s").alias("pid_node"), is_process.alias("typed"), F.when(F.col("p") == "b:end", F.col("o")).alias("end_ts"))
    born = edge("b:creates", "s", "pid_node").select("build_id", "pid_node", F.lit(False).alias("typed"), F.lit(None).cast("string").alias("end_ts"))
    process = own.unionByName(born).groupBy("build_id", "pid_node").agg(F.max("typed").alias("typed"), F.min("end_ts").alias("end_ts"))
    value = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    described = t.where(F.col("p").isin("b:name", "b:abspath", "b:hash") | ((F.col("p") == "a") & (F.col("o") == "b:file")))
    file = described.groupBy("build_id", F.col("s").alias("file_node")).agg(value("b:name").alias("name"), value("b:abspath").alias("abspath"), value("b:hash").alias("hash"))
    ends = t.where(F.col("p").isin("b:rename-from", "b:rename-to")).groupBy("build_id", F.col("s").alias("rename_node")).agg(value("b:rename-from").alias("from_node"), value("b:rename-to").alias("to_node"))
    rename = edge("b:rename", "pid_node", "rename_node").join(ends, ["build_id", "rename_node"]).select("build_id", "rename_node", "pid_node", "from_node", "to_node")
    tables = (
        process, edge("b:cmd", "pid_node", "cmd"), edge("b:start", "pid_node", "start_ts"), edge("b:env", "pid_node", "entry"), file,
        edge("b:reads", "pid_node", "file_node"), edge("b:writes", "pid_node", "file_node"), edge("b:executable", "pid_node", "file_node"), edge("b:creates", "pid_node", "child_node"), rename,
        dealt(triples.select("build_id", "s", "p", "o", "o_kind"), parts, "build_id", "s").distinct(),
    )
    return Graph(*tables) if parts is None else Counted(*tables, parts)


def empty(spark: SparkSession) -> Graph:
    return Graph(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def save(graph: Graph, path: str) -> None:
    """Parquet, a folder for each table."""
    for name in SCHEMAS:
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})
