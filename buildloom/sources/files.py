"""File and log inputs: contents to hash, numbered lines, environment lists, event logs in batch and stream."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import env_split
from ..operators.reducer import LOG
from ..storage import ship, stored

#: The hash of empty content.
EMPTY_HASH = "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


#: Bytes of a file that are in memory at once.
BLOCK_BYTES = 4_000_000


def _store(uri: str):
    """A store and the path in it. uri has its characters as they are."""
    from pyarrow import fs

    scheme, _, path = uri.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(path)}")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """uri, size of every regular file below path, empty ones too. Folders are listed level by level, those of a level by
    tasks, so no list of paths passes the driver. A path that is a file is listed by itself."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                store, at = _store(uri)
                head = uri[: len(uri) - len(at)] if uri.endswith(at) else ""
                here = store.get_file_info(at)
                found = store.get_file_info(fs.FileSelector(at)) if here.type == fs.FileType.Directory else [here]
                found = [f for f in found if f.type in (fs.FileType.Directory, fs.FileType.File)]
                cols = [pa.array([head + f.path for f in found], pa.string()), pa.array([f.size for f in found], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["uri", "size", "folder"])

    start = path if "://" in path else "file://" + os.path.abspath(path)
    level = spark.createDataFrame([(start.rstrip("/"),)], "uri string")
    found = []
    while not level.isEmpty():
        here = stored(level.repartition(F.col("uri")).mapInArrow(run, "uri string, size long, folder boolean"), "listing")
        found.append(here.where("not folder").select("uri", "size"))
        level = here.where("folder").select("uri")
    return reduce(DataFrame.unionByName, found)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """abspath, size, hash of every regular file below path: each file is read in blocks by the task that has it, however
    large it is. Files go to tasks by hash of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = _store(uri)
                digest = hashlib.sha1(b"blob %d\x00" % size)
                with store.open_input_stream(at) as f:
                    while block := f.read(BLOCK_BYTES):
                        digest.update(block)
                yield pa.RecordBatch.from_pydict({"uri": [uri], "size": [size], "hash": [digest.hexdigest()]})

    hashed = listed_files(spark, path).repartition(F.col("uri")).mapInArrow(run, "uri string, size long, hash string")
    return hashed.select(F.regexp_replace("uri", "^file:/*", "/").alias("abspath"), "size", "hash")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 1), line of text files, each read whole: for specifications, not for data."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("n", "line"))
    return lines.select("file", (F.col("n") + 1).alias("n"), "line")


def first_file(listing: DataFrame, suffix: str = ".spec") -> DataFrame:
    """repo, filename: the first file, by name, with a suffix in each listing."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("filename"))
    return listing.where(F.col("filename").endswith(suffix)).withColumn("place", place).where("place = 1").select("repo", "filename")


def environment(entries: DataFrame) -> DataFrame:
    """build_id, pid_node, var, value of NAME=value entries; no sign: a null value."""
    name, value = env_split("entry")
    return entries.select("build_id", "pid_node", name.alias("var"), value.alias("value"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A system-call log in JSON lines, in the reducer's schema."""
    return spark.read.schema(LOG).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same, as files arrive in a folder."""
    return spark.readStream.schema(LOG).json(path)
