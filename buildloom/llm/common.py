"""Session plumbing shared by the corpus operators: shared folder, cut points, code shipping, safe broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java/RE2 character class body, and its complement: a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only below this many rows; beyond it, Spark shuffles (and AQE splits skewed keys).
BROADCAST_ROWS = 100_000

_SHIPPED: set[str] = set()
#: Tables that cut() wrote and nothing deleted so far, in the order of writing.
_WRITTEN: list[DataFrame] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode,
    where driver and executors are one process; a cluster must name one, as no machine's own folder is seen by others."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpus-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._corpus_path = at
    _WRITTEN.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in tables:
        at = getattr(df, "_corpus_path", None)
        if at:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            _WRITTEN[:] = [x for x in _WRITTEN if x is not df]


def written() -> int:
    """A mark for release: the number of tables that stand now."""
    return len(_WRITTEN)


def release(since: int, *keep: DataFrame) -> None:
    """Delete the tables written since the mark, but for those to keep: when all that was made from them is written itself.
    A caller who has stored an operator's result may release(0)."""
    drop(*[x for x in _WRITTEN[since:] if all(x is not k for k in keep)])


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once for each application, so Python stages need no installation there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{root.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
